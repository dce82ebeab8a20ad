"""Benchmark decontamination with DataFrame functions alone.

The windows of all test items (``window`` consecutive normalised words; a shorter item is one window) form a
hash set that is broadcast while it has at most ``MOST_GRAMS`` entries, and joined by a shuffle beyond that.
Documents are scanned in two steps. Any occurrence of a window holds a short gram that starts at a multiple of
a stride, so the first step probes those few grams only and finds the documents that can have a hit at all.
The second step compares every window of these documents, word for word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.rows import riding, unpacked
from linkspark.session import cut

RESULT = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
WINDOW = 10
MOST_GRAMS = 1_000_000
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Normalised words: A-Z in lower case, cut at ASCII that is neither letter nor digit; null has none."""
    cut_up = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), BETWEEN_WORDS)
    return F.array_remove(cut_up, "")


def word_count(text: str) -> Column:
    """Number of ``words``, counted in the text as it is: letters of either case, digits and all beyond ASCII."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(word)).cast("long")


def _probe(size: int) -> tuple[int, int]:
    """(words of a probed gram, stride): every run of ``size`` words holds a gram that starts at a multiple of the stride."""
    gram = max(1, size // 2)
    return gram, size - gram + 1


def _grams(column: str, size: int, step: int, value) -> Column:
    """``value(offset)`` at every ``step``-th offset where ``size`` words are left; none in shorter arrays."""
    last = F.size(column) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), value)).otherwise(F.array())


def _text(column: str, size: int):
    return lambda at: F.array_join(F.slice(F.col(column), at + 1, F.lit(size)), " ")


def _code(size: int, gram: int):
    return lambda at: F.xxhash64(F.lit(size), F.slice(F.col("w"), at + 1, F.lit(gram)))


def _window(size: int):
    return lambda at: F.struct(F.lit(size).alias("size"), at.alias("first"), _text("w", size)(at).alias("gram"))


def item_windows(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(size, gram, items): the windows of all items and the ids they come from, as sorted strings.

    Items without words have no window. A null id marks words as hit but is listed nowhere.
    """
    own = items.select(F.col(key).cast("string").alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    full = own.filter(F.size("w") >= window).select(
        "item", F.lit(window).alias("size"), F.explode(_grams("w", window, 1, _text("w", window))).alias("gram"))
    short = own.filter(F.size("w") < window).select("item", F.size("w").alias("size"), F.array_join("w", " ").alias("gram"))
    return full.unionByName(short).groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _set(df: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(df) if entries <= MOST_GRAMS else df


def _same(left: DataFrame, right: DataFrame) -> Column:
    return (left["_id"].eqNullSafe(right["_id"])) & (left["_text"] == right["_text"])


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hit documents: ``_id``, ``_text`` (hash of the text), ``spans`` of (first, end) in words, ``items``."""
    windows = cut(item_windows(items, window))
    entries = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # window sizes
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_text"), words(text).alias("w"))
    if not entries:
        return rows.filter("false").select("_id", "_text", F.array().cast("array<struct<first:int,end:int>>").alias("spans"),
                                           F.array().cast("array<string>").alias("items"))

    # the first step: grams at multiples of a stride
    probes, anchors = [], []
    for size in sorted(entries):
        gram, step = _probe(size)
        code = _code(size, gram)
        probes.append(_grams("w", gram, step, code))
        of_size = windows.filter(F.col("size") == size).select(F.split("gram", " ").alias("w"))
        anchors.append(of_size.select(F.explode(_grams("w", gram, 1, code)).alias("code")))
    anchors = cut(reduce(DataFrame.unionByName, anchors).distinct())
    probed = rows.select("_id", "_text", F.explode(F.concat(*probes) if len(probes) > 1 else probes[0]).alias("code"))
    found = probed.join(_set(anchors, anchors.count()), "code", "left_semi").select("_id", "_text").distinct()

    # the second step: every window of those documents
    found = cut(found.withColumnRenamed("_id", "_fid").withColumnRenamed("_text", "_ftext"))
    again = rows.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text") == F.col("_ftext")), "left_semi")
    every = [_grams("w", size, 1, _window(size)) for size in sorted(entries)]
    scanned = again.select("_id", "_text", F.inline(F.concat(*every) if len(every) > 1 else every[0]))
    met = scanned.join(_set(windows, sum(entries.values())), ["size", "gram"])
    return met.groupBy("_id", "_text").agg(
        F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("size")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: str) -> Column:
    """Words within sorted (first, end) spans, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], a["reach"]))).alias("n"),
        F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit``, ``n_items``, ``items``, ``spans`` and ``contaminated``.

    A word is hit if it lies in any occurrence of any window. Null and empty texts have no words. Rows with
    equal id and text are judged alike; rows with equal ids and other texts each by their own text. Columns of
    these names are replaced.
    """
    names, rest = riding(docs, text, replaced=RESULT)
    found = hits(docs, items, window, key, text)
    rows = docs.select(rest, F.col(text).alias("_body"), F.xxhash64(text).alias("_doc"))
    joined = rows.join(found, rows[f"_row.{key}"].eqNullSafe(found["_id"]) & (rows["_doc"] == found["_text"]), "left")
    return joined.select(
        *unpacked(names, **{text: "_body"}), word_count("_body").alias("n_words"), F.coalesce(covered("spans"), F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, or (``remove="spans"``) with their texts as the normalised
    words outside all hit spans; clean texts stay as they are. Columns named like results of
    ``contamination`` are left out."""
    judged, own = contamination(docs, items, window, key, text), [c for c in docs.columns if c not in RESULT]
    if remove == "documents":
        return judged.filter("not contaminated").select(own)
    outside = F.filter(F.transform(words(text), lambda w, i: F.when(
        ~F.exists("spans", lambda s: (s["first"] <= i) & (i < s["end"])), w)), lambda w: w.isNotNull())
    clean = F.when(F.col("contaminated"), F.array_join(outside, " ")).otherwise(F.col(text))
    return judged.withColumn(text, clean).select(own)
