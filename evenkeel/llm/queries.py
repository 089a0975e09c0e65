"""The queries of this subpackage: thin digests of what the operators give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import bpe, chat, decontaminate, html_blocks, katz, quality_classifier, quality_rules, simhash, token_counts, training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(
        _table(spark, sf_dir, "documents"),
        "doc_id",
        "text",
        tokenizer_path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"), ("page_id", "url"), "html")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("byte_bpe_50k.json"), limit=512)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "web-1")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask("base-1"))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept"
    )


OP4_SQL = (
    quality_rules.LEDGER_SQL.replace("{documents}", "documents")
    + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from ledger"
)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    rows = katz.katz_scores(_table(spark, sf_dir, "documents"), "doc_id", "text", train=remainder != 2)
    return rows.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, threshold=3, seed=42)


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as it is read back from the shards, with the number it had before it was given its slot."""
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    folder, manifest, total = training_order.materialise(
        _table(spark, sf_dir, "documents"), "text", ranks, public_tokenizers.PATTERN, length=512, per_shard=8192, key=20
    )
    if manifest.isEmpty():
        return spark.createDataFrame([], "slot long, shard long, number long, n_bytes long, ids_sha256 string")

    order = training_order.Permutation(total, 20)

    @F.pandas_udf("long")
    def number(slots: pd.Series) -> pd.Series:
        return pd.Series(order.numbers(slots.to_numpy(np.int64)), dtype="int64")

    rows = training_order.read(spark, folder)
    return rows.select(
        "slot", "shard", number("slot").alias("number"), F.length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("ids_sha256")
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
                    for i, r in enumerate(("user", "assistant"))
                )
            )
        ),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_chats(rows)
    turns = F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", "formatted", "segments", turns.alias("turns"), F.size(chat.read_back(F.col("formatted"))).cast("long").alias("n_turns"))
    loss = chat.learned(F.col("segments"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(text) + (length(text) - length(replace(text, '\', '')))
    + length(regexp_replace(text, '<(s>|/s>|<SYS>>|</SYS>>)|\[(INST\]|/INST\]|ROLE\]|/ROLE\]|END\])', '\0' || chr(1), 'g')) - length(text) as n
  from rows),
f as (select *, n + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 18 + length(role) end as m from e)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(m)::bigint as formatted_chars
from f group by conv_id
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality_classifier.trained(docs, labels, learn=remainder != 0)
    rows = quality_classifier.score(docs, model, "doc_id", "text")
    return rows.select(
        "doc_id",
        F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality_classifier.CUT, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_text": op2_html_text,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_katz": op5_katz,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_training_order": op8_training_order,
    "op9_chat_format": op9_chat_format,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLE_SQL = {"op4_quality_rules": OP4_SQL, "op6_decontamination": decontaminate.sql(), "op9_chat_format": OP9_SQL}
