"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network, calibrated.

Random indexing: every word has a fixed sparse random index vector; a word's vector is the sum of the index vectors of
its neighbours, over all documents: tasks add up their own, Spark adds up the tasks'. Sums are whole numbers, so that the
order doesn't matter. Words are hashed to a table of fixed size, so the model is a few megabytes whatever the corpus is. A
document is the mean of its words' vectors, with a few shares of marks (capitals, repetitions, symbols) that are words
of their own. The network's probabilities are calibrated by a temperature fitted on a part of the labelled sample that
it didn't learn from.

The network is fitted on a bounded sample of labelled rows: ``most`` documents with the least hashes of their ids, and of
these, in that order, whole texts as long as they fit into ``most_chars`` characters together (a text that doesn't fit is
left out, those after it are not). Every document is scored over its whole text.

Defined cases: null and empty texts are documents without words and get a probability too; several labels of an id
count as the highest; without labels of both classes every score is the share of label 1 (one half without any); other
input columns are not carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.storage import lean

#: Documents and characters of the sample that the network is fitted on, unless told otherwise.
SAMPLE, SAMPLE_CHARS = 6000, 40_000_000
#: Score from which a document counts as good.
CUT = 0.3
BUCKETS, SIZE, HIDDEN, NEAR, SEED = 1 << 14, 48, 24, 2, 20
#: Tokens whose neighbours are added up at a time.
TOKENS = 1 << 19
MARKS = ("<capitals>", "<again>", "<symbols>", "<digits>", "<line>", "<long>")
TOKEN = re.compile(r"\n|[^\W\d_]+|\d+|[^\w\s]+|_+")


class Buckets(dict):
    """Token → its buckets (the word's, then those of its marks). Forgets all when it is full."""

    most = 1 << 17

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        at = [len(MARKS) + zlib.crc32(token.lower().encode()) % (BUCKETS - len(MARKS))]
        if token == "\n":
            at = [4]
        elif token[0].isalpha():
            if len(token) > 1 and token.isupper():
                at.append(0)
            if len(token) > 24:
                at.append(5)
        else:
            at.append(3 if token[0].isdigit() else 2)
        self[token] = out = tuple(at)
        return out


def indices(text: str, buckets: Buckets) -> np.ndarray:
    """Buckets of a text's words in order, marks after the word they belong to."""
    out: list[int] = []
    extend, last = out.extend, None
    for token in TOKEN.findall(text):
        extend(buckets[token])
        if token == last:
            out.append(1)
        last = token
    return np.array(out, np.int32)


def index_entries(size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the four entries of every sparse random vector."""
    random = np.random.default_rng(seed)
    drawn = [(random.integers(0, size, BUCKETS), random.choice(np.array([-1, 1], np.float32), BUCKETS)) for _ in range(4)]
    return np.stack([at for at, _ in drawn], axis=1).astype(np.int32), np.stack([sign for _, sign in drawn], axis=1)


def index_vectors(size: int = SIZE, seed: int = SEED) -> np.ndarray:
    """Sparse random vectors: four entries of +1 or -1 in each."""
    at, sign = index_entries(size, seed)
    out = np.zeros((BUCKETS, size), np.float32)
    np.add.at(out, (np.arange(BUCKETS)[:, None], at), sign)
    return out


class Contexts:
    """Sums of the neighbours' index vectors of every bucket."""

    def __init__(self) -> None:
        self.at, self.sign = index_entries()
        self.sums = np.zeros(BUCKETS * SIZE)  # whole numbers
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, at: np.ndarray) -> None:
        self.held.append(at)
        self.size += len(at)
        if self.size > TOKENS:
            self.reduce()

    def reduce(self) -> None:
        if not self.size:
            return
        seq, doc = np.concatenate(self.held), np.repeat(np.arange(len(self.held)), [len(x) for x in self.held])
        self.held, self.size = [], 0
        for off in range(1, NEAR + 1):
            together = np.flatnonzero(doc[off:] == doc[:-off])
            left, right = seq[together], seq[together + off]
            for word, near in ((left, right), (right, left)):
                first = word * SIZE
                for j in range(4):
                    self.sums += np.bincount(first + self.at[near, j], self.sign[near, j], BUCKETS * SIZE)


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """Vectors of unit length of all buckets, learnt from the texts of all ``docs``."""
    names = [f"v{i}" for i in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, buckets = Contexts(), Buckets()
        for batch in batches:
            for text in batch.column(0):
                contexts.add(indices(text.as_py(), buckets))
        contexts.reduce()
        sums = contexts.sums.reshape(BUCKETS, SIZE)
        at = np.flatnonzero(sums.any(axis=1))
        for i in range(0, len(at), 1024):
            part = at[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part), *map(pa.array, sums[part].astype(np.int64).T)], names=["bucket", *names])

    texts = docs.select(F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    found = texts.mapInArrow(lean(run), "bucket long, " + ", ".join(f"{n} long" for n in names))
    found = found.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # BUCKETS rows at most
    sums = np.zeros((BUCKETS, SIZE))
    sums[found["bucket"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    # a bucket that was never seen is its index vector: still a fixed point of its own
    return np.where(length > 0, sums / np.maximum(length, 1e-9), index_vectors() / 2).astype(np.float32)


def pooled(at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document: its mean word vector, the share of each mark, and how varied its words are."""
    n = len(at)
    if not n:
        return np.zeros(vectors.shape[1] + len(MARKS) + 2, np.float32)
    counts = np.bincount(at, minlength=len(MARKS))
    words = np.flatnonzero(counts)
    mean = counts[words].astype(np.float32) @ vectors[words] / n
    return np.concatenate([mean, counts[: len(MARKS)] / n, [len(words) / n, np.log1p(n) / 10]]).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _network(x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 128) -> tuple:
    """Adam on the cross-entropy of a tanh layer and a logistic one; classes weigh as they are."""
    random = np.random.default_rng(SEED)
    p = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(rounds):
        order = random.permutation(len(x))
        for i in range(0, len(x), batch):
            at = order[i : i + batch]
            h = np.tanh(x[at] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            back = np.outer(error, p[2]) * (1 - h**2)
            grads = [x[at].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], error.sum()]
            t += 1
            rate = 3e-3 * (1 - epoch / rounds) + 1e-4
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3])


def fit(texts: list[str], labels: list[int], vectors: np.ndarray) -> Model:
    """The model of labelled texts and word vectors, in an order that doesn't depend on how the texts came."""
    buckets = Buckets()
    rows = sorted(zip(texts, labels, strict=True), key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[1]))
    at = [indices(text, buckets) for text, _ in rows]
    y = np.array([label for _, label in rows], float)
    x = np.stack([pooled(a, vectors) for a in at]) if rows else np.zeros((0, SIZE + len(MARKS) + 2), np.float32)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        width = SIZE + len(MARKS) + 2
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[~aside].tolist())) < 2 or not aside.any():
        aside[:] = False
    centre, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
    net = _network((x[~aside] - centre) / scale, y[~aside])
    model = Model(vectors, centre, scale, *net, 1.0)
    check = aside if aside.any() else ~aside
    logits, truth = model.logits(x[check]), y[check]
    tried = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in tried]
    model.temperature = float(tried[int(np.argmin(loss))])
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, most: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Whole texts and labels of a bounded sample: the rows with the least hashes of their ids."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col)
    texts, found, held = [], [], 0
    rows = rows.where(F.length("_text") <= most_chars).orderBy(F.xxhash64(id_col), id_col, "_text").limit(most)
    for row in rows.select("_text", "_label").toLocalIterator():
        if held + len(row["_text"]) > most_chars:
            continue
        held += len(row["_text"])
        texts.append(row["_text"])
        found.append(int(row["_label"]))
    return texts, found


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a column of texts to their probabilities."""
    held = spark.sparkContext.broadcast(model)  # BUCKETS * SIZE numbers, whatever the corpus

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, buckets = held.value, Buckets()
        for texts in parts:
            if len(texts):
                yield pd.Series(model.probabilities(np.stack([pooled(indices(t, buckets), model.vectors) for t in texts])))
            else:
                yield pd.Series([], dtype=float)

    @F.pandas_udf(T.DoubleType())
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(run)(parts)

    return lambda text: probability(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``score`` of every row."""
    return docs.select(F.col(id_col), scorer(docs.sparkSession, model)(F.col(text_col)).alias("score"))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, most: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Model:
    found = sample(docs, labels, id_col, text_col, label_col, F.lit(True) if learn is None else learn, most, most_chars)
    return fit(*found, word_vectors(docs, text_col))
