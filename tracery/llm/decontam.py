"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A benchmark item is cut into windows of ``window`` words, a window into shingles of
two words (of one, if it has one word).  A document contains a window only if it
contains all its shingles, so by the prefix principle it is enough to join one of
them: the shingle that is rarest in the whole corpus.  Every hit of it in a document
fixes where the window would have to start (positional bound) and end (length bound),
and the words there are then compared with the window's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased words of a text; null for null."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _pair(first: Column, second: Column) -> Column:
    """Join key of a two-word shingle; words are compared later, so a rare clash of keys is harmless."""
    return F.xxhash64(first, second)


def _windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win): the windows of every item, each content once per item."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w")).where("size(w) > 0")
    length = F.least(F.lit(window), F.size("w"))
    starts = words.select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("s"))
    return starts.select("item", F.slice("w", F.col("s"), F.col("len")).alias("win")).distinct()


def hit_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, broadcast_windows: int = 200_000,
) -> DataFrame:
    """(id, th, n_hit, found) of the documents that hold a window: their id, the hash of their text, hit words, items.

    The windows are broadcast up to ``broadcast_windows`` of them (some 30 MB); with
    more, keys are joined by a shuffle and texts are joined to the surviving positions.
    """
    windows = _windows(items, item_col, item_text_col, window).select("item", "win", F.size("win").alias("len"))
    windows = written(windows, "windows")
    small = windows.count() <= broadcast_windows
    near = F.broadcast if small else (lambda df: df)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), item_words(F.col(text_col)).alias("words"))

    def hits_of(lengths: str, width: int) -> DataFrame:
        """Verified occurrences (id, th, start, end, item) of the windows with these lengths, by shingles of ``width`` words."""
        win = windows.where(lengths)
        if width == 2:
            offsets = win.select("item", "win", "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("off"))
            offsets = offsets.withColumn("key", _pair(F.get("win", F.col("off") - 1), F.get("win", F.col("off"))))
            key = _pair(F.col("word"), F.get("words", F.col("pos") + 1))
        else:
            offsets = win.select("item", "win", "len", F.lit(1).alias("off")).withColumn("key", F.xxhash64(F.get("win", F.lit(0))))
            key = F.xxhash64("word")
        spread = keyed.select("id", "th", "words", F.posexplode("words").alias("pos", "word")).select("id", "th", "words", "pos", key.alias("key"))
        wanted = offsets.select("key").distinct()
        counts = spread.select("key").join(near(wanted), "key").groupBy("key").agg(F.count("*").alias("freq"))
        rare = Window.partitionBy("item", "win").orderBy("freq", "key", "off")
        ranked = offsets.join(near(counts), "key", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
        prefix = ranked.withColumn("r", F.row_number().over(rare)).where("r = 1 and freq > 0").select("key", "off", "len", "win", "item")
        start = F.col("pos") - F.col("off") + 1
        if small:
            fit = spread.join(near(prefix), "key").withColumn("start", start)
        else:
            found = spread.select("id", "th", "pos", "key").join(prefix, "key").withColumn("start", start).where("start >= 0")
            fit = found.join(keyed.select(F.col("id").alias("i"), F.col("th").alias("t"), "words"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
        fit = fit.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("words")))
        fit = fit.where(F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len")) == F.col("win"))
        return fit.select("id", "th", "start", (F.col("start") + F.col("len")).alias("end"), "item")

    hits = hits_of("len >= 2", 2)
    if not windows.where("len = 1").isEmpty():
        hits = hits.union(hits_of("len = 1", 1))
    doc = Window.partitionBy("id", "th").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("id", "th", "item", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach)).alias("new"))
    return covered.groupBy("id", "th").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("found"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Return (id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    ``n_hit`` counts the document words inside any occurrence of an item's window.
    A null or empty text, and an item that is null, without words or without id, has
    no words and hits nothing.  Rows that repeat an id get equal results if their
    texts are equal, else their own.  Other columns are ignored.  An empty table of
    items leaves all documents clean.  The options are those of :func:`hit_documents`.
    """
    by_doc = hit_documents(docs, items, id_col, text_col, **options)
    by_doc = by_doc.select(F.col("id").alias("i"), F.col("th").alias("t"), "n_hit", "found")
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), item_words(F.col(text_col)).alias("words"))
    n_words = F.coalesce(F.size("words"), F.lit(0))
    all_docs = keyed.select("id", "th", F.greatest(n_words, F.lit(0)).cast("long").alias("n_words"))
    out = all_docs.join(by_doc, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns, whatever those are named.

    A null or empty text is clean; rows that repeat an id are judged by their own text.
    """
    bad = hit_documents(docs, items, id_col, text_col, **options).select(F.col("id").alias("bad"), "th")
    bad = written(bad, "leaks")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad")) & (F.col("hash") == F.col("th")), "left_anti").select("row.*")
