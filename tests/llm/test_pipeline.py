from __future__ import annotations

import hashlib
import os
import random
from pathlib import Path

import pyarrow as pa

import corpus_pipeline
from evenkeel.llm import quality_rules, storage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus() -> tuple[list, list, list]:
    rng = random.Random(6)
    words = [a + b + c for a in ("th", "er", "on", "re") for b in ("an", "in", "or", "ti") for c in ("", "es", "ed", "ly")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(j, say(30)) for j in range(5)]
    docs, labels = [], []
    for i in range(300):
        text = say(rng.randint(80, 200))
        if i % 10 == 3:
            text = " ".join(w + "###" for w in text.split())
        if i % 10 == 4 and i > 10:
            text = docs[i - 4][1]
        if i % 10 == 6 and i > 10:
            text = f"{docs[i - 5][1]} {say(rng.randint(1, 40))}"
        if i % 10 == 8 and i > 10:
            words_of = docs[i - 6][1].split()
            words_of[rng.randrange(len(words_of))] = "changed"
            text = " ".join(words_of)
        if i % 25 == 7:
            text = f"{text}\n{items[i % 5][1]}\n{say(20)}"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if "###" in text else 1, 0))
    return docs + [(400, None, None, None, None), (401, "", "en", "s", 0), (402, "too short", "en", "s", 9)], labels, items


def groups(texts: dict[int, str]) -> dict[int, int]:
    """The least id that a text is chained to by five-word shingle sets of similarity 0.8 or more, all pairs compared."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_are_sent_bounded_batches(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    none, name = spark.read.parquet(f"{tmp_path}/documents.parquet"), "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(5000, numPartitions=1).selectExpr("repeat(cast(id % 10 as string), 2000) as text")
    sizes = lambda: [r["n"] for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    try:
        for stage in (corpus_pipeline.classified, corpus_pipeline.deduplicated, corpus_pipeline.encoded):
            spark.conf.unset(name)
            stage(spark, none, str(tmp_path))
            got = sizes()
            assert max(got) <= storage.SENT + 10_000 and sum(got) >= 10_000_000
        spark.conf.set(name, "100k")
        storage.bounded(spark)
        assert max(sizes()) <= 110_000
    finally:
        spark.conf.unset(name)


def test_workers_give_freed_memory_back():
    held = []

    def run(batches):
        parts = [bytes(50_000) for _ in range(4000)]
        held.append(bytes(50_000))  # stands above what is freed
        yield from batches
        del parts

    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    before = resident()
    assert list(storage.lean(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 50_000_000


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [{r["doc_id"] for r in rows.collect()}]
    texts = {d[0]: d[1] for d in docs}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == COLUMNS
        got = rows.collect()
        assert all((r["doc_id"], r["text"]) == (r["doc_id"], texts[r["doc_id"]]) for r in got)
        rows = spark.createDataFrame(got, rows.schema)
        kept.append({r["doc_id"] for r in got})
    bad = {i for i, q, _ in labels if q == 0}
    assert len(kept[1] & bad) <= 1 and len(({i for i, q, _ in labels if q == 1}) - kept[1]) <= 3
    ledger = quality_rules.apply_policy(quality_rules.ledger(spark.createDataFrame([(i, texts[i]) for i in kept[1]], "doc_id long, text string")))
    assert kept[2] == {r["doc_id"] for r in ledger.where("kept").collect()}
    root = groups({i: texts[i] for i in kept[2]})
    assert kept[3] == {i for i in kept[2] if root[i] == i} and len(kept[3]) < len({texts[i] for i in kept[2]}) - 20
    assert kept[4] == {i for i in kept[3] if not any(t in texts[i] for _, t in items)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept[4]
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
