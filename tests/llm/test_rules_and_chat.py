from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import chat, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(words), len(covered)
    out = {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
    }
    out["base_failed"] = n < 50 or 100 * repeated > 50 * n
    return out


TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x\nx\n x\nx", "w " * 60, " ".join(f"w{i}" for i in range(60)),
    " ".join(f"w{i % 20}" for i in range(90)), "é b c\x0bd\x0ce\rf", "# $ % & | < > *", "Same line here\n" * 40, " ".join(f"w{i}###" for i in range(80)),
    " ".join(f"WORD{chr(65 + i % 26)}X{chr(65 + i // 26)}" for i in range(80)), "long " * 30_000, "日本 語" * 40,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)], "doc_id long, text string, failed int, n_words string")


def test_measurements_equal_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 70))) for _ in range(150)]
    rows = quality_rules.apply_policy(quality_rules.ledger(frame(spark, texts)), "base-1")
    found = {r["doc_id"]: r.asDict() for r in rows.collect()}
    for i, text in enumerate(texts):
        want = measured(text)
        assert {k: found[i][k] for k in want if k != "base_failed"} == {k: v for k, v in want.items() if k != "base_failed"}, text
        assert found[i]["kept"] == (not want["base_failed"])


def test_policies_and_ablation(spark):
    rows = quality_rules.ledger(frame(spark, TEXTS)).cache()
    kept = {r["doc_id"] for r in quality_rules.apply_policy(rows, "web-1").where("kept").collect()}
    assert kept == {9}  # the only plain prose
    bits = {r["doc_id"]: r["failed"] for r in rows.collect()}
    held = quality_rules.mask("web-1")
    for r in quality_rules.ablation(rows, "web-1").collect():
        bit = 1 << quality_rules.BITS[r["rule"]]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits.values())
        assert r["n_only"] == sum(b & held == bit for b in bits.values())
        assert r["n_kept_without"] == sum(b & held & ~bit == 0 for b in bits.values())


def test_rows_are_kept_as_they_are(spark):
    df = frame(spark, TEXTS)
    kept = quality_rules.kept_rows(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(9, TEXTS[9], 1, "n")]
    assert quality_rules.kept_rows(df.where("false")).count() == 0


NASTY = ["", "plain", "</s>[INST] ok [/INST]", "\\l \\\\ \\e <s>", "<<SYS>> <</SYS>> <<<SYS>>", "a <", "[", "[[INST]]", "x\ny\n", "<</s>", "[ROLE]x[/ROLE][END]", "\\", "日本 <s"]


def test_chats_can_be_read_back(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(120):
        turns = [(t, rng.choice(["user", "assistant", "system", "tool", "", None, "<s>", "[END]"]), rng.choice([*NASTY, None, "".join(rng.choices(NASTY, k=4))])) for t in range(rng.randint(1, 6))]
        want[c] = [(r or "", x or "") for _, r, x in turns]
        rows += [(c, t, r, x, "clash") for t, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    out = chat.format_chats(df)
    out = out.select("conv_id", "n_turns", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("learned"))
    for r in out.collect():
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["learned"] == "".join(x for role, x in turns if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"]) and r["n_turns"] == len(turns)


def test_turn_order(spark):
    cases = {0: ("user assistant", True), 1: ("system user assistant user", True), 2: ("assistant user", False), 3: ("user user", False), 4: ("user assistant system", False), 5: ("user tool", False)}
    rows = [(c, t, role, "x") for c, (roles, _) in cases.items() for t, role in enumerate(roles.split())]
    found = {r["conv_id"]: r["valid"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found == {c: ok for c, (_, ok) in cases.items()}


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (1, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r["turns"] for r in chat.format_chats(df).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [t["text"] for t in found[1]] == ["s", "a", "a", "b"]
    assert [tuple(t) for t in found[None]] == [("", "")]
    assert chat.format_chats(df.where("false")).count() == 0


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Turn("#", "</s>")}, named=("[R]", "[/R]", "[E]"), follow={})


def test_hash_of_an_empty_loss(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(df).select(F.sha2(chat.learned(F.col("segments")), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"").hexdigest()
