"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks choose some words of a window and ignore the others, so that a seed still hits where an ignored word was
replaced. Seeds of documents are joined with those of the benchmark; around each hit the document is compared with the
whole item, word by word on the hit's diagonal, and a window of ``WINDOW`` words (or the item, if shorter) has to agree
in a stated share of its words.

Words are lower-cased and compared without anything but letters and digits. With ``short_items``, items below
``WINDOW`` words, where masks miss some changes, meet by pieces instead: as many as words may differ and one more, so
that one is left whole. Items with fewer words than a mask's span match whole and unchanged only; less than that
can't be told from chance. Without it, items below the span never match.

Defined cases: null texts have no words; null ids are ids like others, on both sides; rows of documents or items that
share an id are told apart by their words, and give one pair of ids, the best; empty tables give empty results; other
columns are not carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which words of a window of ten are hashed.
MASKS = ("1101100101", "1011010011", "1100101101")
SPAN = len(MASKS[0])
WINDOW, SHARE = 13, 0.8
#: Words of the benchmark up to which its seeds are broadcast (three seeds of 50 bytes each); beyond, the join shuffles.
BROADCAST_WORDS = 200_000


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def hashed(df: DataFrame, id_col: str, text_col: str, names: tuple[str, str], least: int = SPAN) -> DataFrame:
    """The id and the words' 64-bit hashes of what has ``least`` words, enough for a seed."""
    rows = df.select(F.col(id_col).alias(names[0]), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias(names[1]))
    return rows.where(F.size(names[1]) >= least)


def _rows_of(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a key of id and words, each once."""
    return rows.withColumn(f"{name}_row", F.xxhash64(name, f"{name}_hashes")).dropDuplicates([f"{name}_row"])


def seeds(rows: DataFrame, array: str, at: str) -> DataFrame:
    """A row per window and mask: ``at`` and ``seed``."""
    placed = rows.withColumn(at, F.explode(F.sequence(F.lit(0), F.size(array) - SPAN)))
    each = [F.xxhash64(F.lit(m), *(F.get(array, F.col(at) + i) for i, on in enumerate(mask) if on == "1")) for m, mask in enumerate(MASKS)]
    return placed.withColumn("seed", F.explode(F.array(*each)))


def pieces(n: int, share: float) -> list[tuple[int, int]]:
    """Start and length of the pieces of an item of ``n`` words, one of which every match has whole."""
    k = 1 if n < SPAN else n - math.ceil(share * n - 1e-9) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _piece_hits(own: DataFrame, items: DataFrame, sizes: list[int], share: float) -> DataFrame:
    """``doc, doc_hashes, item_row, doc_at, item_at, item_words`` where a piece of an item of one of ``sizes`` stands."""
    seed = lambda array, at, n: F.xxhash64(F.lit(-n), *(F.get(array, at + i) for i in range(n))).alias("seed")
    known = None
    for n in sizes:
        each = [F.struct(F.lit(a).alias("item_at"), seed("item_hashes", F.lit(a), k)) for a, k in pieces(n, share)]
        part = items.where(F.size("item_hashes") == n).select("item_row", F.lit(n).alias("item_words"), F.inline(F.array(*each)))
        known = part if known is None else known.unionByName(part)
    none = F.array().cast("array<struct<doc_at:int,seed:bigint>>")
    size = F.size("doc_hashes")
    at = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(i.alias("doc_at"), seed("doc_hashes", i, n)))).otherwise(none)
    lengths = sorted({k for n in sizes for _, k in pieces(n, share)})
    found = own.select("doc", "doc_hashes", F.inline(F.flatten(F.array(*map(at, lengths)))))
    return found.join(known, "seed")


def _best_window(equal: Column, width: Column) -> Column:
    """The most equal words in any window of ``width``."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    return F.array_max(F.transform(F.sequence(F.lit(1), F.size(equal) - width + 1), lambda s: total(F.slice(equal, s, width))))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: float = SHARE,
    short_items: bool = False,
) -> DataFrame:
    """``doc_id, item_id, n_matched, best_window, item_words``: a row per document and item whose passage it holds.

    ``n_matched``: equal words over the whole item on the best diagonal; ``best_window``: in its best window.
    """
    items = _rows_of(hashed(benchmark, item_id, item_text, ("item", "item_hashes")), "item")
    known = seeds(items, "item_hashes", "item_at").select("seed", "item_row", "item_at", F.size("item_hashes").alias("item_words"))
    size = items.agg(F.coalesce(F.sum(F.size("item_hashes")), F.lit(0)).alias("n")).first()["n"]
    own = hashed(docs, doc_id, doc_text, ("doc", "doc_hashes"))
    at = seeds(own, "doc_hashes", "doc_at")
    diagonal = (F.col("doc_at") - F.col("item_at")).alias("diagonal")
    first = F.greatest(F.col("diagonal"), F.lit(0))
    passage = F.slice("doc_hashes", first + 1, F.col("item_words") + F.least(F.col("diagonal"), F.lit(0))).alias("passage")
    if size <= BROADCAST_WORDS:
        # no exchange between a document and its hits: its words are at hand
        items = F.broadcast(items)
        hits = at.join(F.broadcast(known), "seed").select("doc", "item_row", diagonal, "item_words", "doc_hashes")
        hits = hits.select("doc", "item_row", "diagonal", passage).distinct()
    else:
        # seeds are exchanged alone; the words of documents with hits are fetched afterwards
        own = _rows_of(own, "doc")
        hits = seeds(own, "doc_hashes", "doc_at").select("doc_row", "doc_at", "seed").join(known, "seed").select("doc_row", "item_row", diagonal, "item_words").distinct()
        hits = hits.join(own, "doc_row").select("doc", "item_row", "diagonal", passage).distinct()
    if short_items:
        every = _rows_of(hashed(benchmark, item_id, item_text, ("item", "item_hashes"), 1), "item")
        sizes = sorted(r["n"] for r in every.select(F.size("item_hashes").alias("n")).where(F.col("n") < window).distinct().collect())
        if sizes:
            every_own = hashed(docs, doc_id, doc_text, ("doc", "doc_hashes"), 1)
            short = _piece_hits(every_own, every.where(F.size("item_hashes") < window), sizes, share)
            short = short.select("doc", "item_row", diagonal, "item_words", "doc_hashes").select("doc", "item_row", "diagonal", passage)
            hits, items = hits.unionByName(short).distinct(), every
    found = hits.join(items, "item_row")
    # the item's words before the document's start, or after its end, are not there
    padded = F.concat(F.array_repeat(F.lit(None).cast("long"), F.greatest(-F.col("diagonal"), F.lit(0))), F.col("passage"))
    found = found.withColumn(
        "equal", F.zip_with("item_hashes", padded, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    )
    width = F.least(F.lit(window), F.size("item_hashes"))
    found = found.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        F.aggregate("equal", F.lit(0), lambda a, x: a + x).cast("long").alias("n_matched"),
        _best_window(F.col("equal"), width).cast("long").alias("best_window"),
        F.size("item_hashes").cast("long").alias("item_words"),
    )
    enough = F.when(F.col("item_words") < SPAN, F.col("item_words")).otherwise(F.ceil(F.lit(share) * F.least(F.lit(window), F.col("item_words"))))
    return (
        found.where(F.col("best_window") >= enough)
        .groupBy(doc_id, item_id)
        .agg(F.max("n_matched").alias("n_matched"), F.max("best_window").alias("best_window"), F.max("item_words").alias("item_words"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark."""
    bad = leaks(docs, benchmark, doc_id=doc_id, **settings).select(F.col(doc_id).alias("_leaked")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_leaked"]), "left_anti")


def sql(window: int = WINDOW, share: float = SHARE) -> str:
    """The same rows in DuckDB."""
    plain = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    key = lambda m, mask: f"['{m}', " + ", ".join(f"w[i + {j}]" for j, on in enumerate(mask, 1) if on == "1") + "]"
    seeds_of = lambda t: " union all ".join(
        f"select k, n, i, {key(m, mask)} as s from (select k, n, w, unnest(range(0, n - {SPAN} + 1)) as i from {t})" for m, mask in enumerate(MASKS)
    )
    return f"""
with d as (select *, len(w) as n from (select doc_id as k, {plain} as w from documents) where len(w) >= {SPAN}),
b as (select *, len(w) as n from (select item_id as k, {plain} as w from benchmark) where len(w) >= {SPAN}),
hits as (select distinct x.k as doc_id, y.k as item_id, x.i - y.i as g from ({seeds_of("d")}) x join ({seeds_of("b")}) y on x.s = y.s),
eq as (select doc_id, item_id, b.n, [case when i + g >= 0 and i + g < d.n and coalesce(d.w[i + g + 1] = b.w[i + 1], false) then 1 else 0 end for i in range(b.n)] as e
  from hits join d on d.k = doc_id join b on b.k = item_id),
best as (select *, list_sum(e)::bigint as n_matched,
    list_max([list_sum(e[s + 1:s + least({window}, n)]) for s in range(n - least({window}, n) + 1)])::bigint as best_window from eq)
select doc_id, item_id, max(n_matched) as n_matched, max(best_window) as best_window, max(n)::bigint as item_words
from best where best_window >= ceil({share} * least({window}, n)) group by all
"""
