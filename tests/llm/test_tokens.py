from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from evenkeel.llm import bpe, token_counts, training_order  # noqa: E402
from evenkeel.llm.bpe import ByteDecoder  # noqa: E402

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
TEXTS = ["", None, "a", "The cat's  hat\n\n 12345 £€ 日本語 👩‍👩‍👧 \t x", "<|endoftext|> <s>", "ab" * 3000, " " * 500 + "z", "The cat's  hat\n\n 12345 £€ 日本語 👩‍👩‍👧 \t x", "\x00\x01 é"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def table(spark, texts, extra=True):
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>")


def test_encoding_equals_the_rank_library(spark, reference):
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    found = {r["doc_id"]: r for r in bpe.encode(table(spark, TEXTS), "doc_id", "text", RANKS, PATTERN, outputs).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = reference.encode_ordinary(text or "")
        assert found[i]["ids"] == ids and found[i]["n_tokens"] == len(ids)
        assert bytes(found[i]["decoded"]) == (text or "").encode()
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_offsets_and_decoding_of_split_characters(spark):
    df = table(spark, ["a 日本 b"])
    row = bpe.encode(df, "doc_id", "text", RANKS, PATTERN, ("ids", "offsets")).first()
    assert row["offsets"][0] == 0 and len(row["offsets"]) == len(row["ids"])
    back = ByteDecoder(bpe.encoder(RANKS, PATTERN))
    pieces = list(back.pieces(row["ids"]))
    assert "".join(pieces) == "a 日本 b" and not any("�" in p for p in pieces)
    ids = spark.createDataFrame([(1, row["ids"]), (2, None), (3, row["ids"][:2]), (4, [])], "doc_id long, ids array<int>")
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(ids, "doc_id", "ids", RANKS, PATTERN).collect()}
    assert texts[1] == "a 日本 b" and texts[2] is None and texts[4] == ""


def test_empty_tables(spark):
    empty = table(spark, ["a"]).where("false")
    assert bpe.encode(empty, "doc_id", "text", RANKS, PATTERN).count() == 0
    assert token_counts.count_tokens(empty, "doc_id", "text", JSON).count() == 0


def test_unknown_output(spark):
    with pytest.raises(ValueError):
        bpe.encode(table(spark, ["a"]), "doc_id", "text", RANKS, PATTERN, ("nothing",))


WORDS = st.sampled_from(["a", "'re", " ", "  ", "\n", "<|endoftext|>", "é", "1", "!!", "'", "日本", " word", "\t", "'l", "l", "<|endof"])


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=400), st.integers(20, 300), st.integers(1, 80))
def test_spliced_counts_equal_whole_ones(parts, chunk, overlap):
    one, text = token_counts.counter(JSON), "".join(parts)
    assert token_counts.spliced(one, text, chunk, overlap) == one.total(text)


@pytest.mark.parametrize("text", ["a" * 20_000 + " b", " " * 20_000 + "b", "x\n" * 9000, "word " * 9000])
def test_splicing_widens_where_nothing_agrees(text):
    one = token_counts.counter(JSON)
    assert token_counts.spliced(one, text, 256, 16) == one.total(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_each_library(spark, name):
    path = public_tokenizers.path(name)
    texts = [*TEXTS, "long text. " * 20_000]
    found = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, texts), "doc_id", "text", path).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        if name.endswith(".model"):
            n = len(token_counts.counter(path).model.encode(text))
        else:
            n = len(token_counts.counter(path).model.encode(text, add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len(text.encode()), n > 512)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000, 4097])
def test_permutations(n):
    order = training_order.Permutation(n, 5)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.numbers(slots) == np.arange(n)).all()
    if n > 60:
        assert not (slots == training_order.Permutation(n, 6).slots(np.arange(n))).all()


def test_shards_hold_every_token_once_and_resume(spark, reference):
    texts = [*TEXTS, *(f"document {i} " * (i % 50) for i in range(200))]
    df = table(spark, texts).repartition(3)
    folder, manifest, total = training_order.materialise(df, "text", RANKS, PATTERN, length=32, per_shard=16, key=3)
    assert manifest.agg({"n": "sum"}).first()[0] == total
    rows = {r["slot"]: bytes(r["data"]) for r in training_order.read(spark, folder).collect()}
    assert sorted(rows) == list(range(total))
    order = training_order.Permutation(total, 3)
    by_number = np.concatenate([np.frombuffer(rows[int(s)], "<u2") for s in order.slots(np.arange(total))])
    end = 50256
    docs: list[tuple[int, ...]] = []
    at: list[int] = []
    for i in by_number.tolist():
        if i == end:
            docs.append(tuple(at))
            at = []
        else:
            at.append(i)
    got = sorted(d for d in docs if d)
    assert got == sorted(t for t in (tuple(reference.encode_ordinary(x or "")) for x in texts) if t)
    later = {r["slot"] for r in training_order.read(spark, folder, start=21).collect()}
    assert later == set(range(21, total))


def test_no_documents_no_shards(spark):
    _, manifest, total = training_order.materialise(table(spark, ["a"]).where("false"), "text", RANKS, PATTERN, length=8)
    assert total == 0 and manifest.count() == 0


def test_every_code_point_is_cut_as_the_rank_library_cuts():
    import numpy as np
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rank_library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}{c}1" for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    own = bpe.Pieces(bpe.encoder(path, public_tokenizers.PATTERN).model, public_tokenizers.PATTERN)
    for text, data in zip(texts, own.encoded(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == rank_library.encode_ordinary(text)


def test_pieces_forget_what_is_too_much_or_too_long():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = bpe.encoder(path, public_tokenizers.PATTERN).model
    few, many = bpe.Pieces(model, public_tokenizers.PATTERN, 50), bpe.Pieces(model, public_tokenizers.PATTERN)
    texts = [f"word{i} {i * i} " + "x" * (i % 90) for i in range(400)]
    for i in range(0, 400, 7):
        assert few.encoded(texts[i : i + 7]) == many.encoded(texts[i : i + 7])
        assert len(few.known) <= 50 + 7 * 6 and max(map(len, many.known)) <= bpe.LENGTH


def test_texts_longer_than_a_slice(spark):
    import hashlib

    text = "some words, and ümläuts 123  \n" * (bpe.SLICE_CHARS // 25)
    df = spark.createDataFrame([(1, text), (2, text[:10]), (3, None)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = {r["doc_id"]: r for r in bpe.encode(df, "doc_id", "text", path, public_tokenizers.PATTERN, ("n_tokens", "decoded_sha256")).collect()}
    assert found[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and found[3]["n_tokens"] == 0
    counted = token_counts.count_tokens(df, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r["doc_id"]: r["n_bytes"] for r in counted} == {1: len(text.encode()), 2: 10, 3: 0}
