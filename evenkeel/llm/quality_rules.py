"""Rule bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and keeps the measurements and one bit per failed rule. Policies are versioned
sets of rules, applied to the bits without reading texts again; ``ablation`` compares what a policy keeps with what it
would keep without each of its rules, from counts per distinct bitmask.

Words are runs of characters other than space and the ASCII controls 9 to 13. Windows of three words are compared by
64-bit hashes of the three words.

Defined cases: null texts have no words and fail ``few_words``; repeated rows are kept; empty tables give empty results;
only ``id_col`` is carried along, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Rule → bit. Bits are never given a new meaning; new rules get new bits.
BITS = {
    "few_words": 0,
    "repeated_windows": 1,
    "short_or_long_words": 2,
    "many_symbols": 3,
    "repeated_lines": 4,
    "mostly_capitals": 5,
    "many_exclamations": 6,
}
#: Version of a policy → its rules.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "short_or_long_words", "many_symbols", "repeated_lines", "mostly_capitals"),
    "web-2": tuple(BITS),
}


def _failing() -> dict[str, Column]:
    """Each rule over the measurements; whole numbers only, so that every engine agrees."""
    words = F.col("n_words")
    return {
        "few_words": words < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * words,
        "short_or_long_words": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words),
        "many_symbols": 10 * F.col("n_symbols") > 4 * words,
        "repeated_lines": 100 * F.col("n_dup_lines") > 60 * F.col("n_lines"),
        "mostly_capitals": 100 * F.col("n_capitals") > 50 * F.col("word_chars"),
        "many_exclamations": 100 * F.col("n_exclamations") > 50 * words,
    }


def mask(policy: str) -> int:
    return sum(1 << BITS[rule] for rule in POLICIES[policy])


def _covered(starts: Column) -> Column:
    """Words in the three-word windows that start at ``starts`` (ascending)."""
    steps = F.transform(starts, lambda d, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1), d + 3) - d))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements and ``failed``, the bits of failed rules. ``id_col`` may be a struct of a whole row."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    without = lambda some: F.length(F.col("_text")) - F.length(F.translate(F.col("_text"), some, ""))
    rows = rows.select(
        F.col(id_col),
        F.filter(F.split("_text", SPACE, -1), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without("!").cast("long").alias("n_exclamations"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )
    measured = ("n_symbols", "n_exclamations", "word_chars", "n_capitals")
    rows = rows.select(
        id_col,
        *measured,
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_words") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("at")
                    ),
                )
            ),
        ).alias("_windows"),
    )
    measured += ("n_words", "n_lines", "n_dup_lines")
    windows = F.col("_windows")
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    twice = F.filter(windows, lambda x, i: same(x, F.get(windows, i - 1)) | same(x, F.get(windows, i + 1)))
    rows = rows.select(id_col, *measured, F.sort_array(F.transform(twice, lambda x: x["at"])).alias("_starts"))
    # a filter on the bits must not be pushed below and evaluate all this again; it can't pass a row number
    rows = rows.select(
        id_col,
        *measured,
        F.coalesce(_covered(F.col("_starts")), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("_row"),
    )
    bits = [F.when(fails, F.lit(1 << BITS[rule])).otherwise(F.lit(0)) for rule, fails in _failing().items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", F.when(F.col("_row") >= 0, failed.cast("long"))).drop("_row")


def apply_policy(rows: DataFrame, policy: str = "web-1", into: str = "kept") -> DataFrame:
    """A ledger with ``into``: no rule of the policy failed."""
    return rows.withColumn(into, F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def kept_rows(df: DataFrame, text_col: str = "text", policy: str = "web-1") -> DataFrame:
    """The rows of ``df`` that a policy keeps, as they are."""
    rows = ledger(df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text")), "row", "text")
    return apply_policy(rows, policy).where("kept").select("row.*")


def ablation(rows: DataFrame, policy: str = "web-1") -> DataFrame:
    """A row per rule of a policy: ``rule, n_failed, n_only`` (rows that this rule alone rejects), ``n_kept_without``."""
    held = F.lit(mask(policy))
    counts = rows.groupBy(F.col("failed").bitwiseAND(held).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("r.bit")).alias("n_only"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("n_kept_without"),
    )


#: The same rows in DuckDB.
LEDGER_SQL = r"""
with docs as (select row_number() over () as k, doc_id, coalesce(text, '') as t from {documents}),
m as (select k, doc_id, t,
    regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from docs),
win as (select k, unnest(range(1, len(w) - 1)) as i, w from m where len(w) >= 3),
keyed as (select k, i, count(*) over (partition by k, w[i], w[i + 1], w[i + 2]) as c from win),
covered as (select k, count(distinct i + d) as n from keyed, (values (0), (1), (2)) as o(d) where c >= 2 group by k),
f as (select doc_id, len(w)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(t) - length(replace(t, '!', '')))::bigint as n_exclamations,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::bigint as n_capitals,
    len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words
  from m left join covered using (k)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
ledger as (select *, not (base_failed
    or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_symbols > 4 * n_words
    or 100 * n_dup_lines > 60 * n_lines or 100 * n_capitals > 50 * word_chars) as kept from v)
"""
