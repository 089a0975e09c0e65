"""Training-order materialisation: token sequences in shards of fixed stride, in a keyed pseudo-random order.

1. Documents are encoded, an end id after each, and cut into sequences of fixed length along each input partition
   (the last is filled up with end ids). The sequences are written once, numbered within their partition.
2. Counts per partition give every sequence a global number below N. A keyed Feistel network on the next even number
   of bits, walked along its cycle until it is below N, is a permutation: the sequence's slot. Nothing is sorted or
   drawn to get it, and it can be inverted.
3. Sequences are exchanged in compressed pieces by ranges of slots, so that each task has some successive shards, one
   after another, and puts them in order in a buffer of one shard's size: a header, then one sequence after another, so
   that slot s is at a known byte. A shard gets its name when it is complete; a task that is run again writes the same
   bytes. Numbers follow the rows of each input partition and the partitions' order, so an input that is dealt out
   otherwise has another order.

``read`` starts at any slot, without reading shards before it.

Defined cases: null and empty texts are an end id; repeated rows are encoded again; an empty table has no shards; other
columns are not carried along.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.bpe import load_ranks
from evenkeel.llm.storage import new_path, qualified, release, remove, written

MAGIC, HEADER = b"TORDER01", "<8sIIQQ"  # magic, bytes of an id, ids of a sequence, first slot, sequences
ROUNDS = 6
#: Sequences in a row of the written table: what a shard gets of them is compressed together.
CHUNK = 4096


def _mix(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    z = x + np.uint64((key * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of ``0 … n - 1``."""

    n: int
    key: int

    def _halves(self) -> tuple[np.uint64, np.uint64]:
        half = max(1, ((max(self.n - 1, 1)).bit_length() + 1) // 2)
        return np.uint64(half), np.uint64((1 << half) - 1)

    def _turned(self, x: np.ndarray, turns) -> np.ndarray:
        half, low = self._halves()
        a, b = x >> half, x & low
        for turn in turns:
            a, b = b, a ^ (_mix(b, self.key, turn) & low)
        return (a << half) | b

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(x.astype(np.uint64))
        while (over := out >= np.uint64(self.n)).any():
            out[over] = step(out[over])
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, lambda x: self._turned(x, range(ROUNDS))) if len(numbers) else numbers

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        half, low = self._halves()
        swap = lambda x: ((x & low) << half) | (x >> half)
        back = lambda x: swap(self._turned(swap(x), reversed(range(ROUNDS))))
        return self._walk(slots, back) if len(slots) else slots


def sequences(df: DataFrame, text_col: str, path: str, pattern: str, length: int) -> DataFrame:
    """``part, first, n, data``: runs of sequences of each input partition, as compressed ids."""
    ranks = load_ranks(path)
    end = max(ranks.values()) + 1
    dtype = np.dtype("<u2" if end < 1 << 16 else "<u4")
    source = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        packer = zstandard.ZstdCompressor(level=6)
        held: list[np.ndarray] = []
        n_held = 0

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, first
            ids = np.concatenate(held) if held else np.empty(0, dtype)
            if last and len(ids) % length:
                ids = np.concatenate([ids, np.full(-len(ids) % length, end, dtype)])
            whole = len(ids) // length
            for i in range(0, whole, CHUNK):
                some = ids[i * length : min(i + CHUNK, whole) * length]
                n = len(some) // length
                data = packer.compress(some.tobytes())
                values = {"part": [part], "first": [first], "n": [n], "data": [data]}
                yield pa.RecordBatch.from_pydict(values, schema=pa.schema([("part", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))
                first += n
            held = [ids[whole * length :]]
            n_held = len(held[0])

        for batch in batches:
            for text in batch.column(0):
                ids = np.array([*encoding.encode_ordinary(text.as_py()), end], dtype)
                held.append(ids)
                n_held += len(ids)
                if n_held >= CHUNK * length:
                    yield from rows(False)
        yield from rows(True)

    return source.mapInArrow(run, "part long, first long, n long, data binary")


def materialise(
    df: DataFrame, text_col: str, path: str, pattern: str, length: int = 512, per_shard: int = 8192, key: int = 1
) -> tuple[str, DataFrame, int]:
    """Write the shards; the folder, their manifest (``shard, first_slot, n, file``) and the number of sequences."""
    spark = df.sparkSession
    end = max(load_ranks(path).values()) + 1
    dtype = np.dtype("<u2" if end < 1 << 16 else "<u4")
    held, held_path = written(sequences(df, text_col, path, pattern, length), "sequences")
    counts = {r["part"]: r["n"] for r in held.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()}  # one row per input partition
    offsets, total = {}, 0
    for part, n in counts.items():
        offsets[part], total = total, total + n
    order = Permutation(total, key)
    folder = qualified(spark, new_path(spark, "shards"))
    shards = -(-total // per_shard)
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, unpacker = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                ids = np.frombuffer(unpacker.decompress(row["data"]), dtype).reshape(n, length)
                slots = order.slots(offsets[row["part"]] + row["first"] + np.arange(n))
                by_shard = np.argsort(slots // per_shard, kind="stable")
                shards = (slots // per_shard)[by_shard]
                groups = np.split(by_shard, np.flatnonzero(np.diff(shards)) + 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([int(slots[g[0]] // per_shard) for g in groups], pa.int64()),
                        "slots": pa.array([slots[g].astype("<i8").tobytes() for g in groups], pa.binary()),
                        "data": pa.array([packer.compress(ids[g].tobytes()) for g in groups], pa.binary()),
                    }
                )

    def written_shard(shard: int, whole: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        from pyarrow import fs
        from pyspark import TaskContext

        first, n = shard * per_shard, len(whole)
        if not seen.all():
            raise ValueError(f"shard {shard} lacks {int((~seen).sum())} sequences")
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"shard-{shard:08d}.bin"
        hidden = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(hidden) as stream:
            stream.write(struct.pack(HEADER, MAGIC, dtype.itemsize, length, first, n))
            stream.write(memoryview(whole).cast("B"))
        if files.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:  # of a task that was run before
            files.delete_file(f"{base}/{name}")
        files.move(hidden, f"{base}/{name}")
        return pa.RecordBatch.from_pydict({"shard": [shard], "first_slot": [first], "n": [n], "file": [name]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards one after another, from pieces in their order."""
        import zstandard

        unpacker, shard, whole, seen = zstandard.ZstdDecompressor(), -1, np.empty((0, length), dtype), np.ones(0, bool)
        for batch in batches:
            for at, slots, data in zip(*(batch.column(c) for c in ("shard", "slots", "data")), strict=True):
                if at.as_py() != shard:
                    if shard >= 0:
                        yield written_shard(shard, whole, seen)
                    shard = at.as_py()
                    n = min(per_shard, total - shard * per_shard)
                    whole, seen = np.empty((n, length), dtype), np.zeros(n, bool)
                own = np.frombuffer(slots.as_py(), "<i8") - shard * per_shard
                whole[own] = np.frombuffer(unpacker.decompress(data.as_py()), dtype).reshape(len(own), length)
                if seen[own].any():
                    raise ValueError(f"a slot of shard {shard} is taken twice")
                seen[own] = True
        if shard >= 0:
            yield written_shard(shard, whole, seen)

    pieces = held.mapInArrow(placed, "shard long, slots binary, data binary")
    ranges = pieces.repartitionById(tasks, F.floor(F.col("shard") * tasks / max(shards, 1)).cast("int"))
    manifest = ranges.sortWithinPartitions("shard").mapInArrow(write, "shard long, first_slot long, n long, file string")
    manifest, _ = written(manifest, "shard-manifest")
    remove(spark, held_path)
    release(spark)
    return folder, manifest, total


def read(spark: SparkSession, folder: str, start: int = 0) -> DataFrame:
    """``slot, shard, data`` of every sequence from slot ``start`` on. Shards are cut up by Spark itself."""
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="shard-*.bin")
    head = F.substring("content", 1, struct.calcsize(HEADER)).alias("head")
    first = spark.read.format("binaryFile").load(folder, pathGlobFilter="shard-00000000.bin").select(head).first()
    if first is None:
        return spark.createDataFrame([], "slot long, shard long, data binary")
    magic, size, length, _, per_shard = struct.unpack(HEADER, bytes(first["head"]))
    stride, header = size * length, struct.calcsize(HEADER)
    files = files.select(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"), "content").where(F.col("shard") >= start // per_shard)
    whole = (F.substring("content", 1, len(magic)) == F.lit(magic)) & (F.pmod(F.length("content") - header, F.lit(stride)) == 0)
    n = F.when(whole, F.floor((F.length("content") - header) / stride).cast("int")).otherwise(F.raise_error(F.lit("not a whole shard")).cast("int"))
    skip = F.greatest(F.lit(start) - F.col("shard") * per_shard, F.lit(0)).cast("int")
    rows = files.select("shard", "content", F.explode(F.sequence(skip, n - 1)).alias("i"))
    return rows.select((F.col("shard") * per_shard + F.col("i")).alias("slot"), "shard", F.substring("content", F.lit(header + 1) + F.col("i") * stride, F.lit(stride)).alias("data"))
