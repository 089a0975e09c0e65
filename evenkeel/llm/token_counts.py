"""Token counts with overlap resynchronisation.

A huge document is encoded in overlapping chunks. Two neighbouring chunks are spliced at a boundary that both have and
that is proven stable: a place where a pre-token starts. Pre-tokens are found by matching from left to right, so what
follows such a place depends on the text after it only; and a chunk's own pre-tokens are those of the whole text as far
as its end is further away than any look-ahead and than the longest special string. If the overlap holds no common
boundary, it is widened (in the end to the rest of the document), never guessed.

Whole documents are counted by pre-tokens too: the library encodes each distinct one once, as long as it is remembered.
The proof needs a byte-level pre-tokenizer without a normaliser. Other ``.json`` tokenizers and ``.model`` files encode
every document whole.

Defined cases: null texts count as empty (0 tokens, 0 bytes); repeated rows are kept; empty tables give empty results;
other input columns are not carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.bpe import Pieces as Remembered
from evenkeel.llm.bpe import slices

#: Characters of a chunk, of the first overlap, and the look-ahead of the pre-token pattern (a contraction of three characters).
CHUNK_CHARS, OVERLAP_CHARS, LOOK_AHEAD = 1 << 15, 1 << 8, 4
#: Fixed value: the pattern by which a byte-level pre-tokenizer cuts texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Json:
    """A tokenizers file, as its library counts: special strings inside texts are special tokens, as by default."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.splits = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.special = [t["content"] for t in added]
        self.cut = Remembered(self.model.model, BYTE_LEVEL) if self.splits and pre.get("use_regex", True) else None
        self.margin = LOOK_AHEAD + max((len(t["content"]) for t in added), default=0)

    def many(self, texts: list[str]) -> list[int]:
        plain = [self.cut is not None and not any(s in t for s in self.special) for t in texts]
        own = iter(self.cut.encoded([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        rest = iter(self.model.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [len(next(own)) // 4 if p else len(next(rest).ids) for p in plain]

    def starts(self, text: str) -> tuple[list[int], list[int]]:
        """Where pre-tokens start, and how many tokens come before each. A special token starts one too."""
        e = self.model.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        places, before, last = [], [], object()
        for i, w in enumerate(words):
            if w is None or w != last:
                # offsets leave out a leading space; it belongs to the pre-token
                at = offsets[i][0]
                end = offsets[i - 1][1] if i else 0
                places.append(min(at, end) if i else 0)
                before.append(i)
            last = w if w is not None else object()
        return places, before

    def total(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


def spliced(one: Json, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a whole text from overlapping chunks; equal to ``one.total(text)``."""
    margin = one.margin
    chunk = max(chunk, 4 * margin)
    overlap = min(max(overlap, 2 * margin), chunk // 2)
    at, counted = 0, 0  # a pre-token of the whole text starts at ``at``; counted: tokens before it
    size = chunk
    while len(text) - at > size:
        places, before = one.starts(text[at : at + size])
        sure = {at + p: n for p, n in zip(places, before, strict=True) if 0 < p <= size - margin}
        met, wide = None, overlap
        while met is None:
            start = max(at, at + size - margin - wide)
            if start == at:
                break  # the overlap is the whole chunk
            again, _ = one.starts(text[start : start + wide + margin])
            # a start that only the cut makes is not one: the chunk's own first place is left out
            common = [start + p for p in again if p > 0 and start + p in sure]
            met = common[-1] if common else None
            wide *= 2
        if met is None:
            size *= 2  # no boundary in the chunk: it is widened
            continue
        counted += sure[met]
        at, size = met, chunk
    return counted + one.total(text[at:])


class Pieces:
    """A sentencepiece file."""

    splits = False

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def many(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]


@lru_cache(maxsize=4)
def counter(path: str):
    return Pieces(path) if path.endswith(".model") else Json(path)


def counts(texts: list[str], path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    one = counter(path)
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if not (one.splits and len(t) > 2 * chunk)]
    own = [texts[i] for i in short]
    for start, end in slices(own):
        for i, n in zip(short[start:end], one.many(own[start:end]), strict=True):
            out[i] = n
    for i in set(range(len(texts))) - set(short):
        out[i] = spliced(one, texts[i], chunk, overlap)
    return out


def count_tokens(
    df: DataFrame, id_col: str, text_col: str, path: str, limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text_to_count"))
    schema = T.StructType([source.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            n = counts(batch.column(2).to_pylist(), path, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
