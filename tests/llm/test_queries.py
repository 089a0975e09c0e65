"""The registered text queries on the smallest tables: SQL where there is any, brute force or contracts elsewhere."""

from __future__ import annotations

import hashlib
import math
import os
import zlib

import numpy as np
import pytest

from evenkeel.llm import components, queries, simhash, token_counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels", "pages"):
        connection.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    wanted = connection.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[i] for i in order) for r in wanted.fetchall())


def test_tokens(spark, documents):
    import public_tokenizers
    import tiktoken

    from evenkeel.llm.bpe import load_ranks

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = queries.op1_byte_bpe(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = reference.encode_ordinary(documents[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(documents[r["doc_id"]].encode()).hexdigest()
    one = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.op3_token_counts(spark, SF).collect():
        text = documents[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), one.total(text)) and r["over_limit"] == (r["n_tokens"] > 512)


def test_base_of_the_language_model(spark, documents):
    from collections import Counter

    words = {i: [*t.encode().lower().split(), b""] for i, t in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, types = sum(counts.values()), len(counts)
    rows = queries.op5_katz(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ws = words[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(counts[w] > 0 for w in ws))
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws)) < 1e-6
        assert r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_fingerprints(spark, documents):
    rows = {r["doc_id"]: r for r in queries.op7_simhash(spark, SF).collect()}
    ids = sorted(documents)
    x = np.array([simhash.fingerprint(documents[i]) for i in ids], np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    nodes, roots = components.forest(a, b)
    root = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    for k, i in enumerate(ids):
        assert rows[i]["fingerprint"] == f"{int(x[k]):016x}" and rows[i]["component_id"] == ids[root.get(k, k)]


def test_pages(spark):
    from evenkeel.llm.html_blocks import blocks

    html = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op2_html_text(spark, SF).collect()
    assert len(rows) == len(html)
    wanted = {i: "\n\n".join(b.text for b in blocks(h) if any(e.split()[0] == "article" for e in b.path)) for i, h in html.items()}
    assert np.mean([r["text"] == wanted[r["page_id"]] for r in rows]) > 0.97 and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_classifier(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op10_quality_classifier(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    known = [(r["predicted"] == labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert np.mean(known) > 0.9


def test_shards(spark):
    rows = queries.op8_training_order(spark, SF).collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == list(range(n)) == sorted(r["number"] for r in rows) and {r["n_bytes"] for r in rows} == {1024}
