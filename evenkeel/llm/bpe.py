"""Byte-level BPE encoding and decoding over Arrow batches.

The rank file maps byte strings to ids. ``encoder`` turns it into a ``tokenizers`` model: bytes become printable
characters by the byte table, and the merge list is recovered from the ranks (the two parts of a token are what is
left of it when only lower ranks may merge). Texts are cut into pre-tokens by the pattern; the library encodes each
distinct one once, as long as ``Pieces`` remembers it. Where offsets are asked for, it encodes whole texts.
``ByteDecoder`` reverses the byte table; characters whose bytes are
split over tokens come out whole because bytes are joined before they are decoded.

Defined cases: a null text is an empty text; no tokens give an empty list; a null id column stays null; repeated rows
are kept; empty tables give empty results. Input columns other than the two named ones are not carried along, so that
their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.storage import lean

#: Characters of text that one call of the library gets; bounds the memory of its results.
SLICE_CHARS = 1 << 20
#: Pre-tokens that are remembered, and the length up to which they are.
REMEMBERED, LENGTH = 1 << 19, 64

TYPES = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "offsets": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "decoded": T.BinaryType(),
}


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The byte table: bytes that print stand for themselves, the others for code points from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


def recovered_merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Pairs in order of rank. Each token longer than a byte is merged from bytes by lower ranks until two parts remain."""
    never, pairs = len(ranks) + (1 << 40), []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            order = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
            at = order.index(min(order))
            if order[at] >= rank:
                raise ValueError(f"rank {rank} can't be reached by merges of lower ranks")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pairs.append((parts[0], parts[1]))
    return pairs


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The ``tokenizers`` model of a rank file; built once in each Python worker."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    shown = lambda token: "".join(map(table.__getitem__, token))
    ranks = load_ranks(path)
    model = models.BPE(
        vocab={shown(token): rank for token, rank in ranks.items()},
        merges=[(shown(a), shown(b)) for a, b in recovered_merges(ranks)],
    )
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return out


class Pieces:
    """Texts to ids, pre-token by pre-token: a piece is encoded by the library's model without any further splitting."""

    def __init__(self, model, pattern: str, most: int = REMEMBERED) -> None:
        import regex

        self.split, self.model = regex.compile(pattern).findall, model
        self.shown = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}
        self.most = most

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = list(map(self.split, texts))
        new = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set(chain.from_iterable(cut))
        for piece in new:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
            self.known[piece] = array("I", [t.id for t in tokens]).tobytes()
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for piece in new:
            if len(piece) > LENGTH:
                del self.known[piece]
        return out


@lru_cache(maxsize=4)
def pieces(path: str, pattern: str) -> Pieces:
    return Pieces(encoder(path, pattern).model, pattern)


class ByteDecoder:
    """ids → bytes by the model's own vocabulary, read through the reversed byte table."""

    def __init__(self, model) -> None:
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = model.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for shown, rank in vocabulary.items():
            tokens[rank] = bytes(map(back.__getitem__, shown))
        self.tokens = tokens

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def pieces(self, ids) -> Iterator[str]:
        """Text as ids arrive; the bytes of a character that isn't complete wait for the next id."""
        import codecs

        held = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield held.decode(self.tokens[i])
        yield held.decode(b"", True)


@lru_cache(maxsize=4)
def decoder(path: str, pattern: str) -> ByteDecoder:
    return ByteDecoder(encoder(path, pattern))


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` characters."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode(
    df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "n_tokens")
) -> DataFrame:
    """``id_col`` and the wanted outputs for every row.

    ``outputs``: ``ids``; ``offsets`` (the character at which each token starts); ``n_tokens``; ``decoded`` (bytes,
    from the ids); ``ids_sha256`` (ids as little-endian unsigned 32-bit integers); ``decoded_sha256``.
    """
    unknown = set(outputs) - set(TYPES)
    if unknown:
        raise ValueError(f"no such outputs: {sorted(unknown)}")
    source = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_to_encode"))
    schema = T.StructType([source.schema[id_col], *(T.StructField(o, TYPES[o]) for o in outputs)])
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "offsets": pa.list_(pa.int32()), "decoded": pa.binary()}
    decodes = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model, cut, back = encoder(path, pattern), pieces(path, pattern), decoder(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in slices(texts):
                found: dict[str, list] = {o: [] for o in outputs}
                if "offsets" in outputs:
                    ones = model.encode_batch(texts[start:end], add_special_tokens=False)
                    found["offsets"] = [[a for a, _ in one.offsets] for one in ones]
                    packed = [array("I", one.ids).tobytes() for one in ones]
                else:
                    packed = cut.encoded(texts[start:end])
                for data in packed:
                    ids = np.frombuffer(data, "<u4")
                    whole = back.bytes(ids) if decodes else b""
                    for o, values in found.items():
                        if o == "n_tokens":
                            values.append(len(ids))
                        elif o == "ids":
                            values.append(ids)
                        elif o == "decoded":
                            values.append(whole)
                        elif o == "ids_sha256":
                            values.append(hashlib.sha256(data).hexdigest())
                        elif o == "decoded_sha256":
                            values.append(hashlib.sha256(whole).hexdigest())
                arrays = [pa.array(found[o], kinds.get(o, pa.string())) for o in outputs]
                yield pa.RecordBatch.from_arrays([keys.slice(start, end - start), *arrays], names=[id_col, *outputs])

    return source.mapInArrow(lean(run), schema)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str, pattern: str) -> DataFrame:
    """``id_col``, ``decoded`` (bytes) and ``text`` (with U+FFFD for what isn't UTF-8) of lists of ids; null for null."""
    source = df.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids_to_decode"))
    schema = T.StructType([source.schema[id_col], T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path, pattern)
        for batch in batches:
            whole = [None if ids is None else back.bytes(ids) for ids in batch.column(1).to_pylist()]
            shown = [None if x is None else x.decode("utf-8", "replace") for x in whole]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole, pa.binary()), pa.array(shown, pa.string())], names=[id_col, "decoded", "text"]
            )

    return source.mapInArrow(run, schema)
