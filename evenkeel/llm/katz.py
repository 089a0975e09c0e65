"""Katz backoff n-gram model, learnt and applied by request and answer between blocks of documents and tables of counts.

A *block* holds some hundred documents as indices into its own list of distinct words (64-bit hashes). Blocks ask
partitions of the word table for counts and ids, then, level by level, partitions of the n-gram tables; a partition
merges what all blocks ask, so each distinct n-gram crosses the network once per block, however often it occurs, and a
frequent one is no more work than a rare one. The level below tells how often a history occurs (in rows that train, and
in others): if all that is in one block, its followers are settled there and nothing is asked. One that makes up much of the corpus is split by
the word that follows, and what is needed of its followers as a whole is summed up in a table of its own. So what is
asked is at most the distinct n-grams of every block, however many blocks and partitions there are.

The model, for ``order`` words (each level is evaluated on the one below, down to single words):

    p(w | h) = d(c(h w)) c(h w) / c'(h)       if the n-gram is known
             = a(h) p(w | h without its first word)      otherwise
    p(w)     = d(c(w)) c(w) / N,   p(unknown) = what is left

with Good-Turing discounts ``d`` for counts up to ``K``, of each level its own. The mass they free backs off, with
weights ``a`` that make every conditional distribution sum to exactly one over the known words and one unknown word.
``c'(h)`` is the history's count, plus one where no follower is discounted, so that something is always left. A text's
first word has the history of a start; longer histories reach back to it and not further.

Tables (Parquet, below the shared folder): blocks; words by partition and, for each level, n-grams by partition, with
the answers to each block. ``keep_tables`` keeps them, with the counts as rows of kind ``model`` (words: hash, id, count;
n-grams: history, word id, count; a history is a word's id, from three words on a 64-bit hash of ids); ``ngrams`` gives a
level as plain rows. Otherwise they go when the scores are written.

Defined cases: null texts are empty (one token, the end); a null id trains unless ``train`` says no; repeated rows are
documents of their own; a text longer than a block is cut at white space, with the words before the cut as context;
with nothing to learn from, every word is the unknown one, with probability one; other input columns are not carried.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.storage import release, remove, written

#: Counts up to K are discounted.
K = 5
#: Bytes of a block; distinct n-grams that one partition merges, roughly.
BLOCK_BYTES, MERGED = 1 << 22, 1 << 21
#: A history is split if it has more than 1/(HOT * partitions) of all tokens.
HOT = 4
END, START, NONE = b"", 0, -1
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: What is counted of a block: distinct words, tokens, starts of rows that train and of others.
COUNTED = ("n_words", "n_tokens", "n_learnt", "n_rest")

TABLE = "kind string, part long, block long, size long, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    import struct

    import zstandard

    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.empty(0, np.uint8)
        data = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        out.append(struct.pack("<3sQQ", a.dtype.str[1:].encode().ljust(3), len(a), len(data)) + data)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    import struct

    import zstandard

    (n,), at, out = struct.unpack_from("<H", data), 2, []
    for _ in range(n):
        kind, length, size = struct.unpack_from("<3sQQ", data, at)
        at += struct.calcsize("<3sQQ")
        dtype = np.dtype("<" + kind.decode().strip())
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, length * dtype.itemsize))
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, length) if length else np.empty((dtype.itemsize, 0), np.uint8)
        own = np.ascontiguousarray(planes.T).view(dtype).reshape(length)
        out.append(own if own.flags.writeable else own.copy())
        at += size
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of ids."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def discounts(n: np.ndarray) -> np.ndarray:
    """``d`` for counts 0 to K from ``n[r]``, how many types have count r (1 to K + 1).

    Good-Turing as Katz has it; where the counts of counts don't allow that, an absolute discount estimated from them.
    """
    n = np.asarray(n, float)
    d = np.ones(K + 1)
    r = np.arange(1, K + 1)
    with np.errstate(all="ignore"):
        a = (K + 1) * n[K + 1] / n[1]
        d[1:] = ((r + 1) * n[2 : K + 2] / (r * n[1 : K + 1]) - a) / (1 - a)
    if not (np.isfinite(d).all() and (d[1:] > 0).all() and (d[1:] < 1).all()):
        off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.5
        d[1:] = (r - min(max(off, 0.05), 0.95)) / r
    return d


class Words:
    """Unigram probabilities by count."""

    def __init__(self, total: int, types: int, n: list[int]) -> None:
        self.total, self.types = total, types
        self.d = discounts(np.array([0, *n]))
        small = np.arange(1, K + 1)
        self.unknown = 1.0 if not total else float(((1 - self.d[1:]) * small * np.array(n[:K])).sum()) / total or 1.0 / (total + 1)
        known = 1.0 - self.unknown
        # where no count is small enough to be discounted, all share what the unknown word gets
        self.scale = known / (float(total - ((1 - self.d[1:]) * small * np.array(n[:K])).sum()) / total) if total else 0.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        d = self.d[np.minimum(counts, K)]
        d = np.where(counts > K, 1.0, d)
        return np.where(counts > 0, self.scale * d * counts / self.total, self.unknown)


# blocks


def cuts(data: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes, cut at white space."""
    at = 0
    while len(data) - at > most and (m := SPACE.search(data, at + most)):
        yield data[at : m.start()]
        at = m.end()
    yield data[at:] if at else data


class Builder:
    """Rows of a block while it fills."""

    def __init__(self) -> None:
        self.local: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.local[END]
        self.runs: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, key: int, id_: pa.Scalar, words: list[bytes], lead: list[bytes], start: bool, train: bool, whole: bool, size: int) -> None:
        self.runs.append(np.fromiter(map(self.local.__getitem__, chain(lead, words)), np.int32, len(lead) + len(words)))
        self.rows.append((key, id_, len(lead), start, train, whole))
        self.size += size

    def batch(self, block: int, id_type: pa.DataType) -> pa.RecordBatch:
        import xxhash

        keys, ids, lead, start, train, whole = zip(*self.rows, strict=True)
        lengths, lead = np.array([len(x) for x in self.runs], np.int64), np.array(lead, np.uint8)
        flags = [np.array(x, np.uint8) for x in (start, train, whole)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.local), np.uint64, len(self.local))
        words, place = np.unique(hashes, return_inverse=True)
        tokens = place.astype(np.int32)[np.concatenate(self.runs)]
        own = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= np.repeat(lead, lengths)
        learnt = own & np.repeat(flags[1] > 0, lengths)
        counts, rest = (np.bincount(tokens[x], minlength=len(words)).astype(np.int64) for x in (learnt, ~learnt))
        starts = [int(x.sum()) for x in (flags[0] & flags[1] & (lead == 0), flags[0] & ((1 - flags[1]) | (lead > 0)))]
        binary = lambda *x: pa.array([packed(*x)], pa.binary())
        listed = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        columns = {
            "kind": pa.array(["block"]),
            "block": pa.array([block], pa.int64()),
            "keys": listed(keys, pa.int64()),
            "ids": listed([x.as_py() for x in ids], id_type),
            "words": pa.nulls(1, pa.binary()),
            "docs": binary(lengths, lead, *flags),
            "tokens": binary(tokens),
        }
        columns |= {c: pa.array([n], pa.int64()) for c, n in zip(COUNTED, (len(words), int(own.sum()), *starts), strict=True)}
        row = pa.RecordBatch.from_pydict(columns)
        asked = {"kind": pa.array(["words"]), "block": columns["block"], "words": binary(words, counts, rest)}
        asked = pa.RecordBatch.from_arrays([asked.get(c, pa.nulls(1, row.schema.field(c).type)) for c in row.schema.names], schema=row.schema)
        return pa.Table.from_batches([row, asked]).combine_chunks().to_batches()[0]


def blocks(df: DataFrame, id_col: str, text_col: str, train: Column, order: int, block_bytes: int) -> DataFrame:
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(source.schema["id"].dataType)),
            *(T.StructField(c, T.BinaryType()) for c in ("words", "docs", "tokens")),
            *(T.StructField(c, T.LongType()) for c in COUNTED),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = key = TaskContext.get().partitionId() << 40
        held = Builder()
        for batch in batches:
            id_type = batch.column(0).type
            for id_, text, learn in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                before, n = [], 0
                pieces = list(cuts(text.as_py().encode().lower(), block_bytes))
                for i, piece in enumerate(pieces):
                    words = piece.split()
                    if i == len(pieces) - 1:
                        words.append(END)
                    if not words:
                        continue
                    held.add(key, id_, words, before, n == len(before), learn.as_py(), len(pieces) == 1, len(piece))
                    n += len(words)
                    before = (before + words)[len(before) + len(words) - min(n, order - 1) :]
                    if held.size >= block_bytes:
                        yield held.batch(block, id_type)
                        held, block = Builder(), block + 1
                key += 1
        if held.rows:
            yield held.batch(block, id_type)

    return source.mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "part", "block", "size", "data"])


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].astype(np.int64)


# words


def word_requests(table: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, counts, rest = unpacked(data.as_py())
                # words are in order, and partitions are ranges: answers come back in the order of the block's words
                part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cut = _runs(part)
                slices = [slice(a, b) for a, b in zip(cut, [*cut[1:], len(words)], strict=True)]
                out = [("ask", int(part[at.start]), block, at.stop - at.start, packed(words[at], counts[at], rest[at])) for at in slices]
                yield from _rows(out).to_batches()

    return table.select("block", "words").mapInArrow(run, TABLE)


def word_answers(asked: DataFrame, parts: int, keep_tables: bool) -> DataFrame:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        named = table.column("block").to_pylist()
        got = [unpacked(x.as_py()) for x in table.column("data")]
        words, place = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        counts, rest = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for sums, i in ((counts, 1), (rest, 2)):
            np.add.at(sums, place, np.concatenate([g[i] for g in got]))
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-counts - rest, kind="stable")] = 1 + np.arange(len(words), dtype=np.int64) * parts + part  # frequent words get small ids
        out = [("model", part, -1, len(words), packed(words, ids, counts))] if keep_tables else []
        out.append(("sums", part, -1, 0, packed(np.r_[counts.sum(), (counts > 0).sum(), _counts_of_counts(counts)].astype(np.int64))))
        at = 0
        for block, (asked_words, *_) in zip(named, got, strict=True):
            own = place[at : at + len(asked_words)]
            out.append(("answer", part, block, len(own), packed(ids[own], counts[own], rest[own])))
            at += len(own)
        return _rows(out)

    return asked.groupBy("part").applyInArrow(merge, TABLE)


def _sums(table: DataFrame) -> np.ndarray:
    """The sum of all small ``sums`` rows, added up by Spark."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                values = unpacked(data.as_py())[0]
                yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(values)), pa.int32()), "n": pa.array(values, pa.int64())})

    found = table.where("kind = 'sums'").select("data").mapInArrow(numbers, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(K + 3, np.int64)
    for row in found:
        out[row["at"]] = row["n"]
    return out


# n-grams, level by level


def backoff(total: np.ndarray, mass: np.ndarray, small: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of histories, from their counts, their followers' lower mass and small counts."""
    freed = ((1 - d[1:])[:, None] * np.arange(1, K + 1)[:, None] * small).sum(axis=0)
    below = np.where(small.sum(axis=0) > 0, total, total + 1).astype(float)
    left = np.where(small.sum(axis=0) > 0, freed, 1.0) / np.maximum(below, 1.0)
    known = total > 0
    return below, np.where(known, left / np.maximum(1.0 - np.where(known, mass, 0.0), 1e-300), 1.0)


def _small(c: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """How many followers of each history have each count up to K."""
    if not len(heads):
        return np.zeros((K, 0), np.int64)
    return np.stack([np.add.reduceat((c == r).astype(np.int64), heads) for r in range(1, K + 1)])


class Grams:
    """A block's distinct n-grams of one level: ``keys``, ``counts`` in training, in the ``rest``, probabilities ``p`` of
    each, and ``of``, the n-gram that ends at each position. ``extend`` lists those of the next level, ``settle`` makes it this one.
    """

    def __init__(self, row: dict, answers: list[dict], words: Words, starts: tuple[int, int]) -> None:
        told = [unpacked(a["data"]) for a in sorted(answers, key=lambda a: a["part"])]
        self.ids, self.counts, self.rest = (np.concatenate(x) for x in zip(*told, strict=True))
        self.lengths, self.lead, self.start, self.train, self.whole = unpacked(row["docs"])
        (self.tokens,) = unpacked(row["tokens"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.scored = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths) >= np.repeat(self.lead, self.lengths)
        self.learnt = self.scored & np.repeat(self.train > 0, self.lengths)
        self.word_counts = self.counts
        self.level, self.of, self.keys, self.p, self.n_starts = 1, self.tokens, self.ids, words.p(self.counts), starts

    def extend(self) -> None:
        n, width = len(self.keys), len(self.ids)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.of[:-1]
        before[self.starts] = np.where((self.start > 0) & (self.level == 1), n, n + 1)
        code, of = np.unique(before * width + self.tokens, return_inverse=True)
        del before
        self.next_of = of.astype(np.int32)
        self.lower = np.empty(len(code), np.int32)
        self.lower[self.next_of] = self.of
        history, self.word = code // width, (code % width).astype(np.int32)
        self.own, self.own_rest = (np.bincount(self.next_of[x], minlength=len(code)).astype(np.int64) for x in (self.learnt, ~self.learnt))
        self.heads = _runs(history)
        self.head_of = (np.cumsum(np.r_[False, history[1:] != history[:-1]]) if len(history) else history).astype(np.int32)
        first = history[self.heads]
        self.head_keys = np.append(self.keys, [START, NONE])[first]
        self.totals, rest = (np.append(x, [n, 0])[first] for x, n in zip((self.counts, self.rest), self.n_starts, strict=True))
        for own, of_history in ((self.own, self.totals), (self.own_rest, rest)):
            own[of_history[self.head_of] == 0] = 0  # no history, as before a text's second word at level three
        #: histories whose followers are all in this block, or that are unknown
        self.local = (self.totals == 0) | (np.add.reduceat(self.own, self.heads) == self.totals) & (np.add.reduceat(self.own_rest, self.heads) == rest)

    def asks(self, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each partition, the n-grams asked of it (by history and word), their histories, and which of those are split."""
        shared = np.flatnonzero(~self.local[self.head_of])
        head = self.head_of[shared]
        parts = plan.parts
        times = np.minimum(1 + (self.totals * (plan.hot * parts / max(plan.tokens, 1))).astype(np.int64), parts).astype(np.uint64)
        h, w = self.head_keys[head], self.ids[self.word[shared]]
        to = mixed(h)
        is_split = times[head] > 1
        to[is_split] += mixed(w[is_split]) % times[head[is_split]]
        to = (to % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((w, h, to))
        shared, to = shared[order], to[order]
        for at, p in zip(np.split(shared, _runs(to)[1:]), to[_runs(to)], strict=True) if len(shared) else ():
            heads = self.head_of[at][_runs(self.head_of[at])]
            yield int(p), at, heads, times[heads] > 1

    def settled_sums(self) -> np.ndarray:
        return _counts_of_counts(self.own[self.local[self.head_of]])

    def settled_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.local[self.head_of] & (self.own > 0))
        return self.head_keys[self.head_of[at]], self.ids[self.word[at]], self.own[at]

    def settle(self, answers: dict[int, bytes], hot: list[bytes], d: np.ndarray, plan: Plan) -> None:
        c, rest = self.own.copy(), self.own_rest.copy()
        mass = np.add.reduceat(np.where(c > 0, self.p[self.lower], 0.0), self.heads)
        small = _small(c, self.heads)
        for part, at, heads, _ in self.asks(plan):
            c[at], rest[at], mass[heads], *counts = unpacked(answers[part])
            small[:, heads] = counts
        if hot:
            order = np.argsort(self.head_keys, kind="stable")
            for data in hot:
                keys, masses, *counts = unpacked(data)
                at = order[np.searchsorted(self.head_keys, keys, sorter=order)]
                mass[at], small[:, at] = masses, counts
        below, weight = backoff(self.totals.astype(float), mass, small, d)
        known = np.where(c > K, 1.0, d[np.minimum(c, K)]) * c / below[self.head_of]
        self.p = np.where(c > 0, known, weight[self.head_of] * self.p[self.lower])
        self.keys = mixed(mixed(self.head_keys)[self.head_of] + self.ids[self.word].astype(np.uint64)).view(np.int64)
        self.counts, self.rest, self.of, self.level = c, rest, self.next_of, self.level + 1


class Plan:
    """What every block needs to know to ask and to read its answers: a few numbers and one list of discounts per level."""

    def __init__(self, words: Words, starts: tuple[int, int], parts: int, tokens: int, keep_tables: bool) -> None:
        self.words, self.starts, self.parts, self.tokens, self.keep_tables, self.hot = words, starts, parts, tokens, keep_tables, HOT
        self.d: list[np.ndarray] = []

    def grams(self, rows: list[dict]) -> tuple[dict, Grams]:
        """The block among ``rows`` at the highest level that all is known of."""
        by_kind = defaultdict(list)
        for r in rows:
            by_kind[r["kind"]].append(r)
        (row,) = by_kind["block"]
        out = Grams(row, by_kind["1"], self.words, self.starts)
        for level, d in enumerate(self.d, 2):
            out.extend()
            out.settle({a["part"]: a["data"] for a in by_kind[str(level)]}, [a["data"] for a in by_kind[f"hot {level}"]], d, self)
        return row, out


def gathered(held: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Blocks together with what they were answered, level by level."""
    out = held.select("kind", "block", "keys", "ids", "docs", "tokens")
    for level, rows in enumerate(levels, 1):
        answers = rows.where("kind = 'answer'").select(F.lit(str(level)).alias("kind"), "part", "block", "data")
        out = out.unionByName(answers, allowMissingColumns=True)
        if level > 1:
            out = out.unionByName(hot_totals(rows).select(F.lit(f"hot {level}").alias("kind"), "block", "data"), allowMissingColumns=True)
    return out


def requests(rows: DataFrame, plan: Plan) -> DataFrame:
    def ask(table: pa.Table) -> pa.Table:
        row, grams = plan.grams(table.to_pylist())
        grams.extend()
        out = [("sums", row["block"] % plan.parts, row["block"], 0, packed(grams.settled_sums()))]
        if plan.keep_tables:
            out.append(("model", row["block"] % plan.parts, row["block"], 0, packed(*grams.settled_rows())))
        for part, at, heads, split in grams.asks(plan):
            runs = np.diff(np.r_[_runs(grams.head_of[at]), len(at)]).astype(np.int32)
            lower = grams.lower[at]
            below = grams.counts[lower] if grams.level == 1 else grams.p[lower]
            keys = np.diff(grams.head_keys[heads], prepend=0)  # in order
            out.append(("ask", part, row["block"], len(at), packed(keys, runs, split.astype(np.uint8), grams.ids[grams.word[at]], grams.own[at].astype(np.int32), grams.own_rest[at].astype(np.int32), below)))
        return _rows(out)

    return rows.groupBy("block").applyInArrow(ask, TABLE)


def answers(asked: DataFrame, plan: Plan) -> DataFrame:
    words, level = plan.words, len(plan.d) + 2

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        is_ask = np.array([k == "ask" for k in table.column("kind").to_pylist()])
        asks, others = table.filter(pa.array(is_ask)), table.filter(pa.array(~is_ask))
        out = [tuple(r[c] for c in ("kind", "part", "block", "size", "data")) for r in others.to_pylist()]
        if not asks.num_rows:
            return _rows(out)
        named = asks.column("block").to_pylist()
        got = [unpacked(x.as_py()) for x in asks.column("data")]
        keys = [np.cumsum(g[0]) for g in got]
        h = np.concatenate([np.repeat(k, g[1]) for k, g in zip(keys, got, strict=True)])
        w, own, own_rest, below = (np.concatenate([g[i] for g in got]) for i in (3, 4, 5, 6))
        order = np.lexsort((w, h))
        sh, sw = h[order], w[order]
        new = np.r_[True, (sh[1:] != sh[:-1]) | (sw[1:] != sw[:-1])]
        starts = np.flatnonzero(new)
        c, rest = (np.add.reduceat(x[order].astype(np.int64), starts) for x in (own, own_rest))
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        ph, pw = sh[starts], sw[starts]
        lower = words.p(below[order][starts]) if level == 2 else below[order][starts]
        del order, sh, sw, new, h, w, own, own_rest, below
        heads = _runs(ph)
        seen = c > 0
        mass, small = np.add.reduceat(np.where(seen, lower, 0.0), heads), _small(c, heads)
        if plan.keep_tables:
            out.append(("model", part, -1, int(seen.sum()), packed(ph[seen], pw[seen], c[seen])))
        out.append(("sums", part, -1, 0, packed(_counts_of_counts(c))))
        group_of = np.searchsorted(heads, np.arange(len(ph)), "right") - 1
        split, at = np.zeros(len(heads), bool), 0
        for block, k, g in zip(named, keys, got, strict=True):
            mine = place[at : at + len(g[3])]
            of = group_of[mine[np.cumsum(g[1]) - g[1]]]
            out.append(("answer", part, block, len(mine), packed(c[mine], rest[mine], mass[of], *small[:, of])))
            if g[2].any():
                split[of[g[2] > 0]] = True
                out.append(("need", part, block, int(g[2].sum()), packed(k[g[2] > 0])))
            at += len(mine)
        if split.any():
            out.append(("hot", part, -1, int(split.sum()), packed(ph[heads[split]], mass[split], *small[:, split])))
        return _rows(out)

    return asked.groupBy("part").applyInArrow(merge, TABLE)


def hot_totals(table: DataFrame) -> DataFrame:
    """``block, data``: mass and small followers of each split history over all its partitions, for blocks that need it."""
    small = [f"n{r}" for r in range(1, K + 1)]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpacked(data.as_py())], names=["head", "mass", *small])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (heads,) = unpacked(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), block)), pa.array(heads)], names=["block", "head"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(block, kind="stable")
            for at in np.split(order, _runs(block[order])[1:]) if len(block) else ():
                yield pa.RecordBatch.from_pydict({"block": pa.array(block[at[:1]]), "data": pa.array([packed(*(c[at] for c in columns))], pa.binary())})

    totals = table.where("kind = 'hot'").select("data").mapInArrow(parts, "head long, mass double, " + ", ".join(f"{n} long" for n in small))
    totals = totals.groupBy("head").agg(F.sum("mass").alias("mass"), *(F.sum(n).alias(n) for n in small))
    wanted = table.where("kind = 'need'").select("block", "data").mapInArrow(needed, "block long, head long").distinct()
    return wanted.join(totals, "head").select("block", "head", "mass", *small).mapInArrow(told, "block long, data binary")


def scores(rows: DataFrame, plan: Plan, id_type: T.DataType) -> DataFrame:
    """A row per document and block that has a part of it."""
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("id", id_type),
            *(T.StructField(c, T.BooleanType()) for c in ("train", "whole")),
            *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")),
            *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score")),
        ]
    )
    words = plan.words

    def score(table: pa.Table) -> pa.Table:
        row, grams = plan.grams(table.to_pylist())
        sums = lambda x: np.add.reduceat(np.where(grams.scored, x, 0), grams.starts)
        counts = grams.word_counts[grams.tokens]
        return pa.table(
            {
                "key": pa.array(row["keys"], pa.int64()),
                "id": pa.array(row["ids"], table.schema.field("ids").type.value_type),
                "train": pa.array(grams.train > 0),
                "whole": pa.array(grams.whole > 0),
                "n_tokens": pa.array(grams.lengths - grams.lead),
                "n_known": pa.array(sums((counts > 0).astype(np.int64))),
                "base_score": pa.array(sums(np.log10((counts + 1) / (words.total + 1 * (words.types + 1))))),
                "score": pa.array(sums(np.log10(grams.p)[grams.of])),
            }
        )

    return rows.groupBy("block").applyInArrow(score, schema)


def ngrams(table: DataFrame) -> DataFrame:
    """``history, word, n``: the counts of a level's table as plain rows."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in unpacked(data.as_py())], names=["history", "word", "n"])

    return table.where("kind = 'model'").select("data").mapInArrow(plain, "history long, word long, n long")


def katz_scores(
    df: DataFrame, id_col: str, text_col: str, train: Column, order: int = 2, block_bytes: int = BLOCK_BYTES, keep_tables: list[DataFrame] | None = None
) -> DataFrame:
    """``id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train``: which rows the model learns from. Tokens are words, A-Z in lower case, and one end per row. ``order``:
    words of the longest n-grams. ``keep_tables``: a list that gets the tables of the levels, from words on.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = df.sparkSession
    keep = keep_tables is not None
    made, held_path = written(blocks(df, id_col, text_col, train, order, block_bytes), "lm-blocks", by=("kind",))
    sizes = made.where("kind = 'block'").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED)).first()
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_parts, parts = (max(least, -(-sizes[c] // MERGED)) for c in ("n_words", "n_tokens"))
    word_table, word_path = written(word_answers(word_requests(made.where("kind = 'words'"), word_parts), word_parts, keep), "lm-words")
    remove(spark, f"{held_path}/kind=words")
    held = spark.read.schema(made.schema).parquet(held_path)
    total, types, *n = _sums(word_table).tolist()
    plan = Plan(Words(total, types, n), (sizes["n_learnt"], sizes["n_rest"]), parts, sizes["n_tokens"], keep)
    levels, paths = [word_table], [held_path, word_path]
    release(spark)
    for level in range(2, order + 1):
        table, path = written(answers(requests(gathered(held, levels), plan), plan), f"lm-{level}-grams")
        levels.append(table)
        paths.append(path)
        plan.d.append(discounts(np.array([0, *_sums(table)[: K + 1]])))
        release(spark)
    found, _ = written(scores(gathered(held, levels), plan, df.schema[id_col].dataType), "lm-scores")
    if keep:
        keep_tables += levels
    else:
        remove(spark, *paths)
    release(spark)
    columns = ("id", "train", "n_tokens", "n_known", "base_score", "score")
    cut = found.where("not whole").groupBy("key").agg(F.first("id").alias("id"), F.first("train").alias("train"), *(F.sum(c).alias(c) for c in columns[2:]))
    return found.where("whole").select(*columns).unionByName(cut.select(*columns)).withColumn("train_tokens", F.lit(total).cast("long"))
