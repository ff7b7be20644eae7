"""Benchmark decontamination: a broadcast hash set of the normalised n-grams of test items.

Every word position of every document is looked up by the hash of the words that follow; a hit is
verified word for word. One pass reads the texts: besides its hits each document keeps the row of its
last word, which tells its length, so that no second read or join is needed. Windows too many to broadcast
meet the texts' keys in a shuffle of keys and places; words are compared where keys have met.

Defined results: null and word-free texts have no words, no hits and no items; items without words have
no windows; shorter items than n are one window each; repeated rows are documents of their own; without
items nothing is hit; an item whose id is null marks words but is named nowhere; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._io import saved, table
from lectorium.llm._text import word_count, words

N = 10
#: Up to so many different windows are broadcast (about 300 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """The different windows of items(item_id, text): size, gram (array of words), items (their ids as strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(word_count(F.col("w")) > 0)
    size = F.least(F.lit(n), F.size("w"))
    at = w.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    return at.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("gram")).groupBy("size", "gram").agg(F.collect_set("item").alias("items"))


def _keyed(words_: str, sizes: list[int], get) -> list:
    """For each size the hash of so many words from a place on; null where the text ends before."""
    return [F.xxhash64(F.lit(size), *[get(words_, i) for i in range(size)]) for size in sizes]


def scan(docs: DataFrame, items: DataFrame, n: int = N, most_broadcast: int | None = None) -> DataFrame:
    """For every row of docs(doc_id, text): row (a number of its own), doc_id, n_words, hits (array of struct of
    the word position and size of each window found) and items (the ids of the items found, as sorted strings)."""
    return _scan(docs.withColumn("row", F.monotonically_increasing_id()), items, n, MOST_BROADCAST if most_broadcast is None else most_broadcast)


def _scan(docs: DataFrame, items: DataFrame, n: int, most_broadcast: int) -> DataFrame:
    grams = saved(windows(items, n), "windows")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # n different values at most
    few = grams.count() <= most_broadcast
    key = None
    for size, hashed in zip(sizes, _keyed("gram", sizes, lambda w, i: F.get(w, F.lit(i))), strict=True):
        one = F.when(F.col("size") == size, hashed)
        key = one if key is None else F.coalesce(key, one)
    grams = grams.withColumn("key", key if sizes else F.lit(None).cast("long"))
    if not few:  # the texts are read twice: once for the keys, once for the words behind the hits
        docs = saved(docs.select("row", "doc_id", "text"), "scanned")
    d = docs.select("doc_id", "row", words(F.col("text")).alias("w"))
    at = d.select("doc_id", "row", "w", F.posexplode("w").alias("at", "word"))
    keys = _keyed("w", sizes, lambda w, i: F.get(w, F.col("at") + i)) or [F.lit(None).cast("long")]
    same = lambda: F.slice("w", F.col("at") + 1, F.coalesce("size", F.lit(1))) == F.col("gram")
    if not few:
        # Only (row, place, key) is shuffled; the words of a text are fetched where keys have met.
        listed = at.select("row", "at", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")
        met = listed.join(grams, "key").groupBy("row").agg(F.collect_list(F.struct("at", "size", "gram", "items")).alias("met"))
        true = F.filter("met", lambda m: F.slice(F.col("w"), m["at"] + 1, m["size"]) == m["gram"])
        found = d.join(met, "row", "left").withColumn("true", F.coalesce(true, F.array().cast("array<struct<at:int,size:int,gram:array<string>,items:array<string>>>")))
        hits = F.transform("true", lambda m: F.struct(m["at"].alias("at"), m["size"].alias("size")))
        return found.select("row", "doc_id", word_count(F.col("w")).cast("long").alias("n_words"), hits.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda m: m["items"])))).alias("items"))
    if len(keys) == 1:
        at = at.withColumn("key", keys[0])
    else:  # one more row for each length of short items; key number 0 also carries the last word
        at = at.select("*", F.posexplode(F.array(*keys)).alias("kind", "key"))
    last = (F.col("at") == F.size("w") - 1) & (F.col("kind") == 0 if len(keys) > 1 else F.lit(True))
    found = at.join(F.broadcast(grams), "key", "left")
    good = F.col("gram").isNotNull() & same()
    kept = found.filter(last | good).select(
        "doc_id", "row", F.when(last, word_count(F.col("w"))).alias("n"), F.when(good, F.struct("at", "size")).alias("hit"), F.when(good, F.col("items")).alias("items")
    )
    per = kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n").alias("n"), F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per.select("row", "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_words"), "hits", "items")


def hit_words(hits) -> F.Column:
    """How many word positions the windows cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))).cast("long")


def clean_spans(docs: DataFrame, items: DataFrame, n: int = N, mask: str = "") -> DataFrame:
    """docs(doc_id, text) with text rebuilt from the words that no window covers, mask standing for each
    covered run. Words are the normalised ones, parted by single spaces."""
    d = saved(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    marks = _scan(d, items, n, MOST_BROADCAST).filter(F.size("hits") > 0).select("row", covered.alias("covered"))
    kept = F.array_join(F.filter(F.transform(words(F.col("text")), lambda w, i: F.when(~F.array_contains("covered", i), w).when(~F.array_contains("covered", i - 1), F.lit(mask))), lambda w: w.isNotNull() & (w != "")), " ")
    return d.join(marks, "row", "left").withColumn("text", F.when(F.col("covered").isNull(), F.col("text")).otherwise(kept)).drop("row", "covered")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in a window of a benchmark item."""
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = hit_words(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: doc_id, n_words, n_hit, items of every document.
SCAN_SQL = f"""
i AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark),
g AS (
  SELECT item, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS gram, least(10, len(w)) AS size
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), sz AS (SELECT DISTINCT size FROM g),
dw AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS w FROM documents),
p AS (SELECT doc_id, r, w, unnest(range(1, len(w) + 1)) AS k FROM dw WHERE len(w) > 0),
m AS (
  SELECT x.r, x.k, x.size, g.item FROM (SELECT p.r, p.k, sz.size, array_to_string(p.w[p.k:p.k + sz.size - 1], ' ') AS gram FROM p, sz WHERE p.k + sz.size - 1 <= len(p.w)) x
  JOIN g ON g.gram = x.gram AND g.size = x.size
), hw AS (SELECT r, count(DISTINCT c) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS c FROM (SELECT DISTINCT r, k, size FROM m)) GROUP BY r),
hi AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
scanned AS (
  SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hw.n_hit, 0)::BIGINT AS n_hit, coalesce(hi.n_items, 0)::BIGINT AS n_items, coalesce(hi.items, '') AS items
  FROM dw LEFT JOIN hw ON hw.r = dw.r LEFT JOIN hi ON hi.r = dw.r
)
"""

OP4_SQL = f"WITH {SCAN_SQL} SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AS contaminated FROM scanned"
