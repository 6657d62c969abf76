"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions alone.

Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased.  An item's windows are
its runs of ``window`` words; an item of fewer is one window.  A document's word is hit if an
occurrence of some window covers it.

1. Winnowing: of every ``window - k + 1`` consecutive k-gram hashes the least is kept, on both
   sides.  Any shared run of ``window`` words then shares a fingerprint, whatever surrounds it.
   An item shorter than a window has its longest word as fingerprint instead, and documents
   then also offer their words.
2. Documents' fingerprints join the items' (one pass over the texts).  Each match keeps its places, and
   with each place a slice of the words around it, as far as a window that covers the place can reach.
3. Matches are extended within their slices: the windows that cover the place join the items' windows
   on the words themselves, so that no hash decides.  No text is read again for that.

The benchmark is broadcast while it has few rows (checked).  Beyond that a fingerprint is shuffled with its text's
hash alone, each different text once, and what matches goes back to the text; rows are the same.  Null
texts have no words; items without words match nothing; items with equal text all count.  Hits belong to
a text, so each row gets its own answer, rows with null or repeated ``doc_id`` too.  A table without
documents gives no rows, one without items no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayloom.llm.common import documents, small, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a table of fingerprints or windows (under 1 KB each) up to which it is broadcast.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _runs(n: Column, k: int) -> Column:
    """1 .. n - k + 1, or nothing."""
    return F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))


def _grams(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("grams", F.transform(_runs(F.size("words"), k), lambda i: F.xxhash64(F.slice("words", i, k))))


def _minima(w: int) -> Column:
    return F.array_distinct(F.transform(_runs(F.size("grams"), w), lambda i: F.array_min(F.slice("grams", i, w))))


def _slices(window: int, k: int) -> Column:
    """(place, before, around) of each occurrence of a matched key: the words around it, and how many of them lie before it."""
    words = F.array_compact(F.transform("words", lambda x, i: F.when(F.xxhash64(x) == F.col("key"), i)))
    grams = F.array_compact(F.transform("grams", lambda g, i: F.when(g == F.col("key"), i)))
    before = lambda i: F.least(i, F.lit(window - 1))
    part = lambda i: F.struct(i.alias("place"), before(i).alias("before"), F.slice("words", i - before(i) + 1, F.lit(2 * window - 1)).alias("around"))
    return F.transform(F.array_union(grams, words), part)


def _covering(m: int) -> Column:
    """The runs of m words of a slice that cover its place, with their own places."""
    runs = _runs(F.size("around"), m)
    covers = F.filter(runs, lambda i: (i - 1 <= F.col("before")) & (i - 1 + m > F.col("before")))
    return F.transform(covers, lambda i: F.struct((F.col("place") - F.col("before") + i - 1).alias("place"), F.lit(m).alias("length"), F.array_join(F.slice("around", i, m), " ").alias("gram")))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def _matched(docs: DataFrame, keys: DataFrame, window: int, k: int, short: bool) -> DataFrame:
    """(text_hash, words, grams, key) of each fingerprint of a text that is one of ``keys``; ``short``: words are offered too."""

    def cut(texts: DataFrame, *more: str) -> DataFrame:
        return _grams(texts.select("text_hash", words(F.col("text")).alias("words"), *more), k)

    offered = _minima(window - k + 1)
    if short:
        offered = F.array_distinct(F.concat(offered, F.transform("words", lambda x: F.xxhash64(x))))
    # An outer explode infers no filter: pushed below, it would work out the keys twice, and their parts for each of them.
    if small(keys, BROADCAST_ROWS):
        rows = cut(docs.select(text_hash(), "text")).withColumn("keys", offered)
        return rows.select("text_hash", "words", "grams", F.explode_outer("keys").alias("key")).join(F.broadcast(keys), "key")
    texts = docs.select(text_hash(), "text").groupBy("text_hash").agg(F.first("text").alias("text"))
    each = cut(texts).select("text_hash", F.explode_outer(offered).alias("key")).join(keys, "key")
    found = each.groupBy("text_hash").agg(F.collect_list("key").alias("found"))  # at most the text's own
    return cut(texts.join(found, "text_hash"), "found").select("text_hash", "words", "grams", F.explode_outer("found").alias("key"))


def hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(text_hash, item_id, place, length) of each occurrence of a window in a text; places count from 0."""
    docs = documents(docs)
    items = items.select("item_id", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    spans = window - k + 1
    long_keys = _grams(items.where(F.col("n") >= window), k).select(F.explode(_minima(spans)).alias("key"))
    anchor = F.element_at(F.array_sort(F.transform("words", lambda x: F.struct(F.length(x).alias("a"), x.alias("b")))), -1)["b"]
    short_items = items.where(F.col("n") < window)
    lengths = [r.n for r in items.select(F.least("n", F.lit(window)).alias("n")).distinct().orderBy("n").collect()]  # at most ``window`` numbers
    keys = written(long_keys.unionByName(short_items.select(F.xxhash64(anchor).alias("key"))).distinct(), "benchmark-keys")
    cut = F.transform(_runs(F.greatest("n", F.lit(window)), window), lambda i: F.array_join(F.slice("words", i, window), " "))
    wanted = written(items.select("item_id", F.explode(cut).alias("gram")).distinct(), "benchmark-windows")

    matched = _matched(docs, keys, window, k, short=any(n < window for n in lengths))
    around = matched.select("text_hash", F.explode_outer(_slices(window, k)).alias("s")).select("text_hash", "s.*")
    runs = [_covering(m) for m in lengths] or [F.array().cast("array<struct<place: int, length: int, gram: string>>")]
    each = around.select("text_hash", F.explode_outer(F.flatten(F.array(*runs))).alias("r")).select("text_hash", "r.*")
    return each.join(_maybe_broadcast(wanted), "gram").select("text_hash", "item_id", "place", "length").distinct()


def text_hash() -> Column:
    return F.md5(F.col("text").cast("binary")).alias("text_hash")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """A row for each of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    found = written(hits(docs, items, window, k), "benchmark-hits")
    covered = found.select("text_hash", F.explode(F.expr("sequence(place, place + length - 1)")).alias("place")).distinct().groupBy("text_hash").agg(F.count("*").alias("n_hit"))
    named = found.select("text_hash", F.col("item_id").cast("string").alias("item")).distinct().groupBy("text_hash").agg(F.sort_array(F.collect_list("item")).alias("items"))
    told = written(covered.join(named, "text_hash"), "contaminated-texts")
    rows = documents(docs).select("doc_id", text_hash(), F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"))
    joined = rows.join(_maybe_broadcast(told), "text_hash", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The documents without a hit, all columns as they were; each row is judged by its text."""
    bad = written(hits(docs, items, window, k).select(F.col("text_hash").alias("bad_text")).distinct(), "contaminated")
    of = F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    return docs.join(_maybe_broadcast(bad), of == bad["bad_text"], "left_anti")
