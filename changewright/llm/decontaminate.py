"""Benchmark decontamination: test n-grams as a broadcast set, found by scanning token windows, then verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import KEY, cut, key_columns, lower_ascii, unpack, with_row

N = 13
SHARE = 20
#: Most distinct n-grams in one broadcast set; a larger benchmark is scanned in as many passes as it needs.
MAX_SET = 100_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def item_ngrams(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: gram (words joined by space), size, anchor (its longest word), off, items.

    Every occurrence of a gram in a document shows its anchor ``off`` words behind its start, so a scan needs to
    look at anchors only.  Items without words have none; items without an id hit but are not listed.
    """
    w = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    cuts = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("g"))
    longest = F.array_max(F.transform("g", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    grams = cuts.groupBy("g").agg(F.collect_set("item").alias("items"))
    return grams.select(
        F.array_join("g", " ").alias("gram"), F.size("g").alias("size"), longest.alias("anchor"),
        (F.array_position("g", longest) - 1).cast("int").alias("off"), "items",
    )


def _pass(docs: DataFrame, grams: DataFrame, n: int, first: bool) -> DataFrame:
    """Scan with one bounded set of n-grams: a row per verified hit and, in the first pass, one per document row."""
    anchors = [r[0] for r in grams.select("anchor").distinct().collect()]  # bounded like the set itself
    member = (lambda i: F.get("w", i).isin(anchors)) if anchors else (lambda i: F.lit(False))
    at = F.when(F.size("w") > 0, F.filter(F.sequence(F.lit(0), F.size("w") - 1), member)).otherwise(F.array().cast("array<int>"))
    low = lambda i: F.greatest(i - (n - 1), F.lit(0))
    seen = F.transform(at, lambda i: F.struct(i.alias("i"), low(i).alias("low"), F.slice("w", low(i) + 1, 2 * n - 1).alias("near")))
    head = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("low"), F.array().cast("array<string>").alias("near")))
    rows = docs.select(*KEY, "doc_id", F.size("w").alias("n_words"), F.explode(F.concat(head, seen) if first else seen).alias("c"))
    found = rows.select(*KEY, "doc_id", "n_words", "c.*", F.get("c.near", F.col("c.i") - F.col("c.low")).alias("anchor"))
    places = grams.groupBy("anchor").agg(F.collect_set(F.struct("off", "size")).alias("p"))
    met = found.join(F.broadcast(places), "anchor", "left").select(*KEY, "doc_id", "n_words", "i", "low", "near", F.explode_outer("p").alias("p"))
    start = F.col("i") - F.col("p.off")
    inside = (start >= F.col("low")) & (start - F.col("low") + F.col("p.size") <= F.size("near"))
    windows = met.where((F.col("i") < 0) | inside).select(
        *KEY, "doc_id", "n_words", "i", start.alias("start"), F.col("p.size").alias("size"),
        F.array_join(F.slice("near", start - F.col("low") + 1, F.col("p.size")), " ").alias("text"))
    known = grams.select("gram", "items", F.xxhash64("gram").alias("h"))
    named = windows.withColumn("h", F.xxhash64("text")).join(F.broadcast(known), "h", "left")
    hit = F.col("text") == F.col("gram")
    return named.where((F.col("i") < 0) | hit).select(
        *KEY, "doc_id", "n_words", (F.col("i") < 0).cast("long").alias("head"), F.when(hit, F.struct("start", "size")).alias("span"), F.when(hit, F.col("items")).alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE, max_set: int = MAX_SET, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: keys, doc_id, n_words, n_hit, n_items, items (sorted strings), spans, contaminated.

    A word inside any occurrence of a window of ``n`` item words (of a shorter item: all its words) is hit; a
    document is contaminated if ``share`` times its hit words reach its words.  Null and wordless texts have no
    words and are clean.  Repeated rows get one row each.  Without items nothing is hit.  The set of one pass is
    counted before it is broadcast: a benchmark of more than ``max_set`` n-grams is scanned in hash slices.
    """
    base = docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    grams = cut(item_ngrams(benchmark, n))
    passes = -(-grams.count() // max_set) or 1
    sliced = [grams.where(F.pmod(F.xxhash64("gram"), F.lit(passes)) == k) if passes > 1 else grams for k in range(passes)]
    rows = reduce(DataFrame.unionByName, [_pass(base, g, n, k == 0) for k, g in enumerate(sliced)])
    each = rows.groupBy(*KEY).agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("head").alias("copies"),
        F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    out = each.select(
        *KEY, "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"), F.array_sort("spans").alias("spans"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.drop("_copy").withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows; all other rows stay as they are."""
    bad = contamination(docs, benchmark, n, share, id_col=id_col, text_col=text_col).where("contaminated").select(*KEY).distinct()
    return unpack(with_row(docs, id_col, text_col).join(bad, KEY, "left_anti"), docs.columns)
