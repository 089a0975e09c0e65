"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, set where more than half of the shingles' hashes are set. Two fingerprints at most three
bits apart are at most one bit apart in one of their 32-bit halves. In each half the anchors are the words of a perfect
covering code: the Hamming code of length 31 (every word is within one bit of one code word), with the last bit as it
is. A half's *home* is its nearest anchor; it is *replicated* to every anchor within the covering radius plus the
half's threshold that can be the home of a half one bit away: 17 anchors at most. So linked fingerprints meet at an
anchor, where they are compared in full; no link is lost, and no bucket is capped.

Equal fingerprints are one node, so copies cost nothing. At an anchor only its homes are held in memory; everything
else streams by in sorted order, and links leave a task as a spanning forest, so that a group of near copies gives as
many rows as it has members, not pairs.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; repeated rows and ids are
kept; null ids are never a component's id unless it has no other; other input columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.components import components, forest, spanning
from evenkeel.llm.storage import lean, release, remove, written

BITS, HALF, CODE = 64, 32, 31
#: Bits that linked fingerprints may differ in. The covering is made for this threshold.
THRESHOLD = 3
#: Hashes whose bits are counted at a time, links and pairs held before they are reduced.
HASHES, LINKS = 1 << 15, 1 << 20


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = hashes[i : i + HASHES].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    import xxhash

    words = text.encode().lower().split()  # on bytes: A-Z only, and exactly space and 9 to 13
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit number."""
    source = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_to_hash"))
    schema = T.StructType([source.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(lean(run), schema)


def _patterns() -> list[list[int]]:
    """Syndrome → what to add to a half to get its home (first) and the other anchors it is replicated to."""
    last = 1 << CODE
    bit = lambda place: 1 << (place - 1) if place else 0
    out = []
    for s in range(HALF):
        pairs = [bit(i) | bit(i ^ s) for i in range(1, HALF) if s and i < i ^ s]
        out.append([bit(s), bit(s) | last, *pairs])
    return out


def anchored(fps: DataFrame) -> DataFrame:
    """``fps (fp)`` at its anchors: ``anchor`` (half and code word), ``home``, ``fp``."""
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    rows = fps.select("fp", half)
    value = F.when(F.col("half") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", HALF)).bitwiseAND(F.lit((1 << HALF) - 1))
    rows = rows.select("fp", "half", value.alias("v"))
    syndrome: Column = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, HALF) if i >> j & 1)
        syndrome = syndrome + F.pmod(F.bit_count(F.col("v").bitwiseAND(F.lit(mask))), F.lit(2)) * (1 << j)
    table = F.array(*(F.array(*(F.lit(x).cast("long") for x in p)) for p in _patterns()))
    rows = rows.select("fp", "half", "v", F.posexplode(F.get(table, syndrome)).alias("at", "added"))
    anchor = (F.col("half").cast("long") * (1 << HALF)) + F.col("v").bitwiseXOR(F.col("added"))
    return rows.select(anchor.alias("anchor"), (F.col("at") == 0).alias("home"), "fp")


class Comparer:
    """Links among rows sorted by anchor with homes first. Holds the homes of one anchor between batches.

    ``fps`` has a row of 64-bit words per fingerprint; distances are over all of them. ``reduced`` keeps fewer links of
    the same components.
    """

    def __init__(self, threshold: int, reduced: Callable = forest) -> None:
        self.threshold, self.reduced = threshold, reduced
        self.anchor = self.homes = self.home_ids = None
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def _keep(self, ids: np.ndarray, fps: np.ndarray, to_ids: np.ndarray, to_fps: np.ndarray) -> None:
        near = (ids != to_ids) & (np.bitwise_count(fps ^ to_fps).sum(axis=1, dtype=np.int64) <= self.threshold)
        if near.any():
            self.links.append((ids[near], to_ids[near]))
            self.held += int(near.sum())
            if self.held > LINKS:
                self.links = [self.reduced(*(np.concatenate(x) for x in zip(*self.links, strict=True)))]
                self.held = len(self.links[0][0])

    def _against(self, ids: np.ndarray, fps: np.ndarray) -> None:
        step = max(1, LINKS // max(1, len(self.homes)))
        for i in range(0, len(ids), step):
            part = np.arange(i, min(i + step, len(ids)))
            for j in range(0, len(self.homes), LINKS):
                homes = np.arange(j, min(j + LINKS, len(self.homes)))
                left, right = np.repeat(part, len(homes)), np.tile(homes, len(part))
                self._keep(ids[left], fps[left], self.home_ids[right], self.homes[right])

    def add(self, anchor: np.ndarray, home: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        ends = np.r_[starts[1:], len(anchor)]
        first, last = 0, len(starts) - 1
        if self.anchor is not None and anchor[0] == self.anchor:  # the group goes on
            at = slice(0, ends[0])
            self.homes = np.concatenate([self.homes, fps[at][home[at]]])
            self.home_ids = np.concatenate([self.home_ids, ids[at][home[at]]])
            self._against(ids[at], fps[at])
            first = 1
        if last >= first:
            n_homes = np.add.reduceat(home.astype(np.int64), starts)
            # groups that end in this batch: every row against the homes of its group, in pieces of bounded size
            inner = np.arange(first, last)
            sizes = ends - starts
            inner = inner[(n_homes[inner] > 0) & (sizes[inner] > 1)]
            small = inner[sizes[inner] * n_homes[inner] <= LINKS]
            if len(small):
                cost = np.cumsum(sizes[small] * n_homes[small])
                for part in np.split(small, np.flatnonzero(np.diff(cost // LINKS)) + 1):
                    rows = np.concatenate([np.arange(starts[g], ends[g]) for g in part])
                    group = np.repeat(part, sizes[part])
                    times = n_homes[group]
                    left = np.repeat(rows, times)
                    right = np.repeat(starts[group], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
                    self._keep(ids[left], fps[left], ids[right], fps[right])
            for g in [*np.setdiff1d(inner, small), last]:
                at = slice(starts[g], ends[g])
                self.homes, self.home_ids = fps[at][home[at]], ids[at][home[at]]
                self._against(ids[at], fps[at])
            self.anchor = anchor[starts[last]]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.links:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return self.reduced(*(np.concatenate(x) for x in zip(*self.links, strict=True)))


def compared(rows: DataFrame, threshold: int, reduced: Callable = forest) -> DataFrame:
    """Links ``a, b`` among ``rows (anchor, home, id, fp…)`` that meet at an anchor: a forest per task."""
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", F.desc("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(threshold, reduced)
        for batch in batches:
            if batch.num_rows:
                anchor, home, ids, *fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                comparer.add(anchor, home, ids, np.stack(fps, axis=1).view(np.uint64))
        a, b = comparer.result()
        for i in range(0, len(a), HASHES):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + HASHES]) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def links(fps: DataFrame, threshold: int = THRESHOLD, reduced: Callable = forest) -> DataFrame:
    """Links ``a, b`` that join what is within ``threshold`` bits among distinct ``fps (fp)``: a forest per task.

    With ``spanning`` as ``reduced`` both ends of each link are within the threshold of one another.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the covering is for thresholds up to {THRESHOLD}")
    rows = anchored(fps)
    return compared(rows.select("anchor", "home", F.col("fp").alias("id"), "fp"), threshold, reduced)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD, seed: int = 42
) -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row; the component's id is its smallest id."""
    spark = df.sparkSession
    rows, _ = written(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    nodes, nodes_path = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), threshold)).withColumnRenamed("node", "fp")
    release(spark)
    found = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found, _ = written(found.join(ids, "root").select("fp", "component_id"), "classes")
    remove(spark, nodes_path)
    return rows.join(found, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts rather than nearly equal fingerprints


#: Counters by which shingles are ordered, and the share of texts (one in so many) that they are counted in.
COUNTERS, COUNTED = 1 << 20, 8
#: Nodes up to which those to be verified are broadcast, so that no other set is exchanged; beyond, the join shuffles.
BROADCAST_NODES = 2_000_000


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of a shorter text, of the whole; none without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        found = (found ^ each[i : len(each) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return np.unique(found)


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes())).view(np.int64))


def _prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in an order common to all sets: sets at least this similar share one of them."""
    if not len(shingles):
        return shingles
    least = int(np.ceil(similarity * len(shingles) - 1e-9))  # of the set's shingles that a similar one has too
    order = np.lexsort((shingles, counts[(shingles % np.uint64(COUNTERS)).astype(np.int64)]))
    return shingles[order[: len(shingles) - least + 1]]


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 2**k equal ranges of hashes, four in a range as the mean; empty if one has 255."""
    k = max(4, len(shingles).bit_length() - 3)
    counts = np.bincount((shingles >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 255 else b""


def _most_common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The most shingles that two sets can have in common, by their sketches: no range shares more than its lesser count."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for left, right in np.unique(sizes, axis=0):
        if left and right:
            at = np.flatnonzero((sizes == (left, right)).all(axis=1))
            least = min(left, right)
            for part in np.split(at, range(LINKS // least, len(at), max(1, LINKS // least))):
                sides = (np.frombuffer(b"".join(x[i] for i in part), np.uint8).reshape(len(part), least, -1).sum(axis=2, dtype=np.int64) for x in (a, b))
                out[part] = np.minimum(*sides).sum(axis=1)
    return out


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs (a, b)`` that may be this similar by ``sketches (node, n, sketch)``; it loses no similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            common = np.minimum(_most_common(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()), np.minimum(n_a, n_b))
            near = common >= (similarity - 1e-9) * (n_a + n_b - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lean(run), "a long, b long")


def _counts(source: DataFrame, shingle: int) -> np.ndarray:
    """How common shingles are, by a counter of their hash; the order made of it bears on costs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(counts, (shingle_set(x.as_py(), shingle) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), HASHES):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + HASHES]), pa.array(counts[at[i : i + HASHES]])], names=["at", "n"])

    texts = source.select("text_to_hash").where(F.pmod(F.xxhash64("text_to_hash"), F.lit(COUNTED)) == 0)
    found = texts.mapInArrow(lean(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def _near_prints(prints: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes whose SimHash fingerprints link, of ``prints (node, fp)``: equal ones, and those that meet
    at an anchor of the covering code and differ in three bits at most; fewer than nodes and tasks' fingerprints."""
    first = prints.groupBy("fp").agg(F.min("node").alias("first"))
    equal = prints.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda x: first.select(F.col("fp").alias(x), F.col("first").alias(f"node_{x}"))
    near = links(first.select("fp"), reduced=spanning).distinct().join(side("a"), "a").join(side("b"), "b")
    near = near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return equal.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, prints: DataFrame, source: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs (a, b)`` of nodes whose shingle sets have this Jaccard similarity, computed in full.

    ``prints`` has the hash of a text of each node, so that only such texts are read into sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), shingle) for x in batch.column("text_to_hash")]
            arrays = [pa.array([_node(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "shingles"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(prints.select("node", "text_hash"), "node")
    wanted, wanted_path = written(wanted, "wanted")
    sent = F.broadcast if wanted.count() <= BROADCAST_NODES else lambda x: x
    texts = source.withColumn("text_hash", F.xxhash64("text_to_hash")).join(sent(wanted.select("text_hash")), "text_hash", "left_semi")
    sets = texts.select("text_to_hash").mapInArrow(lean(run), "node long, shingles array<long>").join(sent(wanted.select("node")), "node", "left_semi")
    sets, path = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    near = both.where(common / (F.size("set_a") + F.size("set_b") - common) >= similarity).select("a", "b")
    near, _ = written(near, "similar")
    remove(pairs.sparkSession, path, wanted_path)
    return near


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col, component_id`` of every row: components of texts whose shingle sets have this Jaccard similarity.

    SimHash comes first: sets whose fingerprints (of the distinct shingles) are equal or meet at an anchor and differ in
    three bits at most are linked if their exact similarity holds. At the least similarity about ten bits in 64 differ, so
    an exact path follows for texts that these links do not join: in an order common to all, sets this similar share one of
    their first shingles, whatever the edit. Common shingles come last, so few texts
    that are not similar meet. Of the smaller set fewer of the first shingles count, and what comes before a shingle in
    both sets bounds what they can share from there on; both hold at the first shingle that two similar sets share. A
    sketch of each set tells what those that meet can have in common at most; most pairs that are not similar go by that,
    the others are verified by their exact similarity: first neighbours and what is central to a shingle, then all that
    meet and are not yet in one component. Equal sets are one node, named by its hash. Rows without an id are not linked;
    if no row of a component has one, its id is null.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_to_hash"))
    hashed = source.withColumn("text_hash", F.xxhash64("text_to_hash"))
    counts = spark.sparkContext.broadcast(_counts(source, shingle))
    schema = T.StructType([source.schema[id_col], T.StructField("text_hash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            prefixes = [_prefix(x, counts.value, similarity).view(np.int64) for x in found]
            arrays = [pa.array([_node(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64())]
            arrays += [pa.array(np.fromiter(map(majority, found), np.uint64, len(found)).view(np.int64))]
            arrays += [pa.array([_sketch(x) for x in found], pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=schema.fieldNames())

    rows, rows_path = written(hashed.mapInArrow(lean(run), schema), "prefixes")
    own = rows.where(F.col(id_col).isNotNull())
    prints, prints_path = written(own.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp")), "fingerprints")
    linked, linked_path = written(_near_prints(prints), "linked")
    near = _verified(linked, prints, source, shingle, similarity)
    roots = components(near)
    release(spark)
    nodes = own.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    share = similarity / (1 + similarity)  # of both sizes together
    placed = nodes.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    placed = placed.withColumn("early", F.col("at") <= F.col("n") - F.ceil(2 * share * F.col("n") - 1e-9))
    by_shingle = Window.partitionBy("shingle")
    by_size = by_shingle.orderBy("n", "node")
    before = [F.lag(c).over(by_size).alias(f"{c}_before") for c in ("node", "n", "at", "early")]
    placed = placed.select("shingle", "node", "n", "at", "early", *before, F.count(F.lit(1)).over(by_shingle).alias("meet"), F.max("early").over(by_shingle).alias("any"))
    shared, shared_path = written(placed.where("meet > 1 and any").drop("meet", "any"), "shared-shingles")
    meeting = shared.select("node").distinct()
    sketches, sketches_path = written(own.join(meeting, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    rows, _ = written(rows.select(id_col, "node"), "node-ids")
    remove(spark, rows_path)
    release(spark)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def may_share(one: str, other: str) -> Column:
        """Whether two rows of a shingle, ``one`` of the set that isn't larger, can be those of the first that is shared."""
        n, m, at, to = F.col(f"n{one}"), F.col(f"n{other}"), F.col(f"at{one}"), F.col(f"at{other}")
        return F.col(f"early{one}") & (F.least(n - at, m - to) >= F.ceil(share * (n + m) - 1e-9))

    by_hash = by_shingle.orderBy(F.xxhash64("node"), "node")
    facts = ("node", "n", "at", "early")
    mixed = shared.select(*facts, *(F.lag(c).over(by_hash).alias(f"{c}_before") for c in facts))
    # the set with the least before the shingle: if the others are copies with changes, it is what they are copies of
    centre = F.first(F.struct(*facts)).over(by_shingle.orderBy("at", "n", "node"))
    central = shared.select(*facts, centre.alias("c")).select(*facts, *(F.col("c")[c].alias(f"{c}_before") for c in facts)).where("node <> node_before")
    neighbours = shared.drop("shingle").unionByName(mixed).unionByName(central).where("node_before is not null")
    smaller, larger = F.col("n_before") <= F.col("n"), F.col("n") <= F.col("n_before")
    neighbours = neighbours.where(smaller & may_share("_before", "") | larger & may_share("", "_before"))
    apart = neighbours.select(*pair("node", "node_before")).distinct()
    for end in ("a", "b"):
        apart = apart.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    apart = apart.where("not root_a <=> root_b or root_a is null").select("a", "b")  # the others are in one component already
    pairs, pairs_path = written(apart, "neighbours")
    near = near.unionByName(_verified(written(_possible(pairs, sketches, similarity), "possible")[0], prints, source, shingle, similarity))
    roots = components(near)
    release(spark)
    # all others that meet, unless they are in one component already
    at = shared.select("shingle", "node", "n", "at", "early").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = at.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("early").alias("any")).where("low < high and any").select("shingle")
    at, at_path = written(at.join(several, "shingle", "left_semi"), "open-shingles")
    to = at.select("shingle", *(F.col(c).alias(f"{c}_to") for c in ("node", "n", "at", "root")))
    others = at.where("early").join(to, "shingle").where((F.col("n") <= F.col("n_to")) & (F.col("root") != F.col("root_to")) & may_share("", "_to"))
    others, others_path = written(others.select(*pair("node", "node_to")).distinct().join(pairs, ["a", "b"], "left_anti"), "others")
    more = _verified(written(_possible(others, sketches, similarity), "possible")[0], prints, source, shingle, similarity)
    if not more.isEmpty():
        roots = components(near.unionByName(more))
    release(spark)
    nodes = rows.groupBy("node").agg(F.min(id_col).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    found, _ = written(nodes.join(ids, "root").select("node", "component_id"), "classes")
    remove(spark, shared_path, sketches_path, prints_path, linked_path, pairs_path, at_path, others_path)
    return rows.select(id_col, "node").join(found, "node").select(id_col, "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=similar_documents, **settings) -> DataFrame:
    """The row of each component whose id is the least, once; rows without an id stay.

    Rows are told apart by id and text, so different texts of one id are rows of their own.
    """
    own = F.col(id_col).isNotNull()
    keyed = df.withColumn("_row", F.when(own, F.xxhash64(id_col, text_col)))
    found = find(keyed.select("_row", text_col), "_row", text_col, **settings).where("_row is not null").select("_row", "component_id").distinct()
    ids = keyed.where(own).select("_row", F.col(id_col).alias("_id")).distinct()
    best = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("_id", "_row")).alias("best"))
    kept = best.select(F.col("best._id").alias("_kept_id"), F.col("best._row").alias("_kept"))
    chosen = keyed.join(kept, (F.col("_row") == F.col("_kept")) & (F.col(id_col) == F.col("_kept_id")), "left").where(F.col("_kept").isNotNull() | ~own)
    repeated = df.where(own).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        chosen = chosen.where(own).dropDuplicates([id_col, "_row"]).unionByName(chosen.where(~own))
    return chosen.select(*df.columns)
