"""Full-text search over page tables: inverted index, fuzzy expansion, BM25, highlights.

The index is three plain tables, built once and stored. Queries are a table as well, so one
query and a million queries run through the same joins.

A saved index holds its postings in blocks: up to ``BLOCK`` documents of one term, their ids as distances from
the first, with the largest contribution of the block. The blocks lie sorted by term, and the terms of a query
are pushed to the scan, so a search reads the pages of its own terms only.

Batches of queries are answered without scoring what can't be among the best. A term's largest contribution
bounds what it can add. The rarest terms of a query give k documents a score, and the k-th of these is a floor;
terms that together stay below it make no document good enough by themselves. Documents are found by the other
terms alone, and what is missing of their score is looked up for those that can still pass the floor.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from linkspark.functions import text as T
from linkspark.session import cut, lookup_table, shuffle_partitions

K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "content": 1.0}
DEFAULT_SIZE, MAX_SIZE = 20, 100
SCORE_DIGITS = 6
LONG_WORD = 16  # letters from which words are cut into parts instead of shortened
BLOCK = 256  # postings of a block
PUSHED = 256  # terms up to which a query's terms go to the scan one by one
SPREAD = 50_000  # rows up to which what is asked of a large table is broadcast
EARLY = 2_000  # postings per query that the floor is worked out from, besides those of its rarest term
MARGIN = 2e-6  # scores are rounded to six digits, so what is nearer to the floor may tie with it


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # field, term, doc_id, length (of the document's field), tf
    terms: DataFrame     # field, term, df, most: the largest tf / (tf + norm)
    stats: DataFrame     # field, docs, mean_length: one row per field
    fields: tuple[str, ...]
    analyzer: str
    blocks: DataFrame | None = None  # of a saved index, whose postings are a view of them

    @property
    def lengths(self) -> DataFrame:
        return self.postings.groupBy("field", "doc_id").agg(F.max("length").alias("length"))

    def save(self, path: str, row_group: int = 8 << 20) -> None:
        """Sorted by term, so a query reads few row groups and pages; a frequent term spans blocks and files."""
        rated = self.postings.join(F.broadcast(self.stats.select("field", "mean_length")), "field")  # a row per field
        rated = rated.select("field", "term", "doc_id", "length", "tf", _share().alias("part"))
        laid = rated.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
        (laid.mapInArrow(_blocked, _block_schema(rated)).write.mode("overwrite").option("parquet.block.size", row_group)
         .option("parquet.page.row.count.limit", 64).parquet(f"{path}/blocks"))
        (self.terms.repartitionByRange("field", "term")
         .sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms"))
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str, fields: tuple[str, ...] = ("title", "content"),
             analyzer: str = "english") -> Index:
        blocks, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "stats"))
        return Index(_unblocked(blocks), terms, stats, fields, analyzer, blocks)

    def of_terms(self, asked: DataFrame) -> Index:
        """The index as far as the (field, term) of ``asked`` need it: few terms become filters of the scan."""
        if self.blocks is None:
            return self
        own = asked.select("field", "term").distinct().limit(PUSHED + 1).collect()  # PUSHED rows at most
        if len(own) > PUSHED:  # read by the join with the terms
            return self
        # one equality each: a list of more than a few values would be pushed as a mere range
        tests = [(F.col("field") == r.field) & (F.col("term") == r.term) for r in own]
        blocks = self.blocks.filter(reduce(Column.__or__, tests) if tests else F.lit(False))
        return Index(_unblocked(blocks), self.terms, self.stats, self.fields, self.analyzer, blocks)


def _norm() -> Column:
    return K1 * (1 - B + B * F.col("length") / F.col("mean_length"))


def _share() -> Column:
    """What a posting has of its term's weight."""
    return F.col("tf") / (F.col("tf") + _norm())


def _block_schema(postings: DataFrame) -> StructType:
    """field, term, first_id, last_id, best, ids, tfs, lengths; integer ids are distances from the first."""
    kind = postings.schema["doc_id"].dataType
    ids = LongType() if isinstance(kind, (LongType, IntegerType)) else kind
    return StructType([postings.schema["field"], postings.schema["term"], StructField("first_id", kind), StructField("last_id", kind),
                       StructField("best", DoubleType()), StructField("ids", ArrayType(ids)), StructField("tfs", ArrayType(LongType())),
                       StructField("lengths", ArrayType(IntegerType()))])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted postings; a block holds postings of one term and one batch."""
    names = ["field", "term", "first_id", "last_id", "best", "ids", "tfs", "lengths"]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in ("field", "term")]
        fresh = np.ones(n, bool)
        fresh[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
        runs = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
        starts = np.flatnonzero(place % BLOCK == 0)
        offsets = pa.array(np.append(starts, n), pa.int32())
        ids, first = batch.column("doc_id"), pa.array(starts)
        last = pa.array(np.append(starts[1:], n) - 1)
        if pa.types.is_integer(ids.type):
            plain = ids.to_numpy()
            own = pa.array(plain.astype(np.int64) - np.repeat(plain[starts], np.diff(np.append(starts, n))))
        else:
            own = ids
        best = np.maximum.reduceat(batch.column("part").to_numpy(), starts)
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (own, batch.column("tf"), batch.column("length"))]
        yield pa.RecordBatch.from_arrays([batch.column("field").take(first), batch.column("term").take(first), ids.take(first),
                                          ids.take(last), pa.array(best), *lists], names)


def _unblocked(blocks: DataFrame, *others: str) -> DataFrame:
    """(field, term, doc_id, length, tf): the postings of blocks, with ``others`` of their columns."""
    kind = blocks.schema["first_id"].dataType
    integers = isinstance(kind, (LongType, IntegerType))
    rows = blocks.select("field", "term", *others, "first_id", F.inline(F.arrays_zip("ids", "tfs", "lengths")))
    doc = (F.col("first_id") + F.col("ids")).cast(kind) if integers else F.col("ids")
    return rows.select("field", "term", doc.alias("doc_id"), F.col("lengths").alias("length"), F.col("tfs").alias("tf"), *others)


def analyze(df: DataFrame, columns: Mapping[str, str] | list[str], doc: str, analyzer: str = "english") -> DataFrame:
    """(field, doc_id, tokens): one row per document and field."""
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in names.items()])
    rows = df.select(F.col(doc).alias("doc_id"), F.inline(fields))
    rows = rows.select("field", "doc_id", T.tokens(F.col("text"), analyzer).alias("tokens"))
    if analyzer == "standard":
        return rows
    # a row's words get their stems, and come together again in their order
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    words = rows.select("_row", F.posexplode("tokens").alias("pos", "word"))
    told = words.join(lookup_table(T.stems(words)), "word").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("_stems"))
    return rows.join(told, "_row", "left").select(
        "field", "doc_id", F.coalesce(F.col("_stems.stem"), F.array().cast("array<string>")).alias("tokens"))


def _words(df: DataFrame, columns: Mapping[str, str] | list[str], doc: str, analyzer: str, positions: bool) -> DataFrame:
    """(field, term, doc_id, length, tf): the words of every document, counted; english ones by their stems."""
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in names.items()])
    rows = df.select(F.col(doc).alias("doc_id"), F.inline(fields))
    rows = rows.select("field", "doc_id", T.tokens(F.col("text"), analyzer).alias("tokens"))
    words = rows.select("field", "doc_id", F.size("tokens").alias("length"),
                        F.posexplode_outer("tokens").alias("pos", "term")).filter("term is not null")
    extra = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    # all tokens of a document sit in one partition, so counting is nearly done before the shuffle;
    # the text is analysed once, everything else comes from the written postings
    counted = cut(words.groupBy("field", "term", "doc_id", "length").agg(F.count("*").alias("tf"), *extra))
    if analyzer == "standard":
        return counted
    # the stems of the distinct words are worked out once, and join the counted words
    own = counted.join(lookup_table(T.stems(counted, "term")), "term")
    extra = [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else []
    return cut(own.groupBy("field", F.col("stem").alias("term"), "doc_id", "length").agg(F.sum("tf").alias("tf"), *extra))


def build_index(df: DataFrame, columns: Mapping[str, str] | list[str], doc: str = "doc_id",
                analyzer: str = "english", positions: bool = False) -> Index:
    postings = _words(df, columns, doc, analyzer, positions)
    lengths = postings.groupBy("field", "doc_id").agg(F.max("length").alias("length"))
    stats = cut(lengths.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length")))
    rated = postings.join(F.broadcast(stats.select("field", "mean_length")), "field")  # a row per field
    terms = cut(rated.groupBy("field", "term").agg(F.count("*").alias("df"), F.max(_share()).alias("most")))
    return Index(postings, terms, stats, tuple(columns), analyzer)


def term_stats(index: Index) -> DataFrame:
    """Documents and occurrences per term."""
    return index.postings.groupBy("field", "term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def term_frequencies(df: DataFrame, columns: Mapping[str, str] | list[str], doc: str = "doc_id", analyzer: str = "english") -> DataFrame:
    """(field, term, tf): occurrences of every term.

    The words are counted as they stand in the texts, before the shuffle; all that is done to a word is done once for
    the vocabulary.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in names.items()])
    rows = df.select(F.inline(fields)).select("field", F.explode_outer(T.tokens(F.col("text"), "standard")).alias("word"))
    counted = cut(rows.filter("word is not null").groupBy("field", "word").agg(F.count("*").alias("tf")))
    if analyzer != "standard":
        kept = counted.select("field", T.kept(F.col("word"), analyzer).alias("word"), "tf").filter("word is not null")
        counted = T.stemmed(kept).select("field", F.col("stem").alias("word"), "tf")
    return counted.groupBy("field", F.col("word").alias("term")).agg(F.sum("tf").alias("tf"))


def query_terms(queries: DataFrame, analyzer: str = "english") -> DataFrame:
    """(query_id, qterm, qtf) of ``queries(query_id, query)``."""
    words = queries.select("query_id", F.explode_outer(T.tokens(F.col("query"), analyzer)).alias("qterm")).filter("qterm is not null")
    if analyzer != "standard":
        words = words.join(lookup_table(T.stems(words, "qterm")), "qterm").select("query_id", F.col("stem").alias("qterm"))
    return words.groupBy("query_id", "qterm").agg(F.count("*").alias("qtf"))


def expand_terms(qterms: DataFrame, vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    """(field, qterm, term, edits, weight, df): index terms a query term may stand for.

    Candidates come from an equality join (on shortened forms, for long words on parts) instead of
    comparing every pair; the exact distance is worked out for those only. ``limit`` keeps the best
    per field.
    """
    most = T.edits_allowed("qterm")
    exact = (_near_pairs(qterms.select("qterm").distinct(), vocabulary)
             .withColumn("edits", F.expr(T.edit_distance("qterm", "term")))
             .filter(f"edits <= {most}")
             .withColumn("weight", 1 - F.col("edits") / F.least(F.length("qterm"), F.length("term")))
             .filter("weight > 0"))
    found = _asked_of(exact, vocabulary, ["term"])
    if limit is not None:
        best = Window.partitionBy("field", "qterm").orderBy(F.desc("weight"), "term")
        found = found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= limit)
    return found.select("field", "qterm", "term", "edits", "weight", "df")


def _vocabulary(vocabulary: DataFrame) -> DataFrame:
    # testing or unfolding a term costs far more than its few bytes, so they are spread wide
    return vocabulary.select("term").repartition(shuffle_partitions(vocabulary), "term").distinct()


def _near_pairs(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qterm, term) that may be close: every pair within the edits that the query term allows, and some more."""
    words = _vocabulary(vocabulary)
    short = wanted.filter(F.length("qterm") < LONG_WORD)
    left = _unfolded(short, "qterm", T.edits_allowed("qterm"))
    # only vocabulary whose length is within reach of some query term is unfolded
    most = T.edits_allowed("qterm")
    near = short.select(F.explode(F.expr(
        f"sequence(length(qterm) - ({most}), length(qterm) + ({most}))")).alias("_len")).distinct()
    close = words.filter(F.length("term") < LONG_WORD + 2).withColumn("_len", F.length("term")).join(near, "_len", "left_semi").drop("_len")
    right = _unfolded(close, "term", "CASE WHEN length(term) >= 4 THEN 2 WHEN length(term) >= 2 THEN 1 ELSE 0 END")
    one = _asked_of(left, right, ["_key"]).select("qterm", "term")

    long = wanted.filter(F.length("qterm") >= LONG_WORD).select("qterm", F.inline_outer(F.expr(T.parts("qterm"))))
    others = words.filter(F.length("term") >= LONG_WORD - 2).select("term", F.inline_outer(F.expr(T.near_parts("term"))))
    two = _asked_of(long, others, ["size", "part", "piece"]).select("qterm", "term")
    return one.unionByName(two).distinct()


def _asked_of(asked: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The join of both, in which ``table``, the unfolded vocabulary or all terms of an index, is never broadcast.

    Spark goes by the size of packed files and takes unfolded words for as small as the words themselves, so in memory
    the table can be fifty times what it looks. What is asked is written, and its rows decide: few are broadcast, with
    more of them both sides are shuffled.
    """
    asked = cut(asked)
    few = asked.limit(SPREAD + 1).count() <= SPREAD
    return table.join(F.broadcast(asked) if few else asked.hint("merge"), on)


def _unfolded(words: DataFrame, col: str, most: str) -> DataFrame:
    # outer, so that the optimizer does not compute the array once more to test its size
    return words.select(col, F.explode_outer(F.expr(T.deletions(col, most))).alias("_key"))


def weighted_terms(index: Index, queries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(query_id, field, term, weight, df, mean_length, most): what each index term counts for in a query."""
    qterms = query_terms(queries, index.analyzer)
    if fuzzy:
        expanded = expand_terms(qterms, index.terms)
    else:
        expanded = _asked_of(qterms.select(F.col("qterm").alias("term")).distinct(), index.terms, ["term"]).select(
            "field", F.col("term").alias("qterm"), "term", F.lit(1.0).alias("weight"), "df")
    expanded = cut(expanded)  # read twice
    top_df = expanded.groupBy("field", "qterm").agg(F.max("df").alias("df"))
    weighted = (expanded.drop("df").join(top_df, ["field", "qterm"]).join(qterms, "qterm")
                .select("query_id", "field", "term", (F.col("weight") * F.col("qtf")).alias("weight"), "df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    summed = weighted.join(index.stats, "field").groupBy("query_id", "field", "term", "mean_length").agg(
        F.sum(F.col("weight") * idf).alias("weight"))
    return _asked_of(summed, index.terms.select("field", "term", "df", "most"), ["field", "term"])


def _best(index: Index, boosts: Mapping[str, float], value: str = "part") -> Column:
    """The best boosted field of a (query, document), rounded."""
    sums = [F.sum(F.when(F.col("field") == f, F.col(value))) * float(boosts.get(f, 1.0)) for f in index.fields]
    return F.round(F.greatest(*sums) if len(sums) > 1 else sums[0], SCORE_DIGITS)


def _parts(postings: DataFrame, weighted: DataFrame, *others: str) -> DataFrame:
    """(query_id, doc_id, field, part) of the postings of weighted terms."""
    return postings.join(weighted, ["field", "term"]).select(
        "query_id", "doc_id", "field", (F.col("weight") * _share()).alias("part"), *others)


def score(index: Index, queries: DataFrame, fuzzy: bool = True, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """(query_id, doc_id, score): BM25 summed over terms, best boosted field wins."""
    weighted = cut(weighted_terms(index, queries, fuzzy))  # read twice
    # the document length sits in the posting, and one grouping serves all fields: a single shuffle
    return _parts(index.of_terms(weighted).postings, weighted).groupBy("query_id", "doc_id").agg(
        _best(index, boosts).alias("score"))


def _missing(asked: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, field, part) of ``terms`` for (query_id, doc_id, field) pairs.

    A row per pair and term of its query, whatever the term's postings; those are read once for all queries.
    """
    wanted = cut(terms.select("field", "term").distinct())
    if wanted.limit(SPREAD + 1).count() <= SPREAD:  # postings of other terms aren't shuffled
        postings = postings.join(F.broadcast(wanted), ["field", "term"], "left_semi")
    return asked.join(terms, ["query_id", "field"]).join(postings, ["field", "term", "doc_id"]).select(
        "query_id", "doc_id", "field", (F.col("weight") * _share()).alias("part"))


def _floors(postings: DataFrame, weighted: DataFrame, index: Index, k: int, boosts: Mapping[str, float]) -> DataFrame:
    """(query_id, floor): the ``k``-th best score among those documents that are best by the query's rarest terms.

    Every query brings ``EARLY`` postings and those of one term at most, whatever the size of the index, and has
    the scores of ``2 k`` documents completed. Queries with fewer than ``k`` have no floor.
    """
    rarest = Window.partitionBy("query_id").orderBy("df", "field", "term")
    terms = weighted.withColumn("_sum", F.sum("df").over(rarest)).withColumn("_nth", F.row_number().over(rarest))
    terms = cut(terms.withColumn("_early", (F.col("_nth") == 1) | (F.col("_sum") <= EARLY)).drop("_sum", "_nth"))
    some = _parts(postings, terms.filter("_early")).groupBy("query_id", "doc_id", "field").agg(F.sum("part").alias("part"))
    own = F.col("part") * _boost(boosts)
    order = Window.partitionBy("query_id").orderBy(F.desc("_own"), "doc_id")
    some = some.withColumn("_own", own).withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= 2 * k)
    some = cut(some.drop("_own", "_nth"))
    whole = some.unionByName(_missing(some.drop("part"), terms.filter("not _early"), postings)).groupBy("query_id", "doc_id").agg(
        _best(index, boosts).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return whole.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k).filter(F.col("_nth") == k).select(
        "query_id", F.col("score").alias("floor"))


def _boost(boosts: Mapping[str, float]) -> Column:
    return reduce(lambda c, f: c.when(F.col("field") == f, float(boosts[f])), boosts, F.when(F.lit(False), 1.0)).otherwise(1.0)


def _split(weighted: DataFrame, floors: DataFrame, boosts: Mapping[str, float]) -> DataFrame:
    """``weighted`` plus ``bound``, ``all`` (the field's bounds together), ``floor``, ``finds`` and ``rest``.

    Per query and field, the terms with the smallest bounds that together stay below the floor find nothing
    (``finds`` is false); ``rest`` is what these can add to a document that another term has found.
    """
    own = Window.partitionBy("query_id", "field")
    least = own.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = weighted.join(floors, "query_id", "left").withColumn("boost", _boost(boosts)).withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    rows = rows.withColumn("bound", F.col("weight") * F.col("most") * F.col("boost"))
    rows = rows.withColumn("_below", F.sum("bound").over(least)).withColumn("all", F.sum("bound").over(own))
    rows = rows.withColumn("finds", F.col("_below") >= F.col("floor") - MARGIN)
    return rows.withColumn("rest", F.coalesce(F.max(F.when(~F.col("finds"), F.col("_below"))).over(own), F.lit(0.0))).drop("_below")


def candidates(index: Index, weighted: DataFrame, k: int, boosts: Mapping[str, float] = BOOSTS,
               docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What can be among the ``k`` best: (query_id, doc_id, field, part) of the terms that find, summed and written,
    and the terms whose parts are still missing."""
    own = index.of_terms(weighted)

    def allowed(rows: DataFrame) -> DataFrame:
        return rows if docs is None else rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    split = cut(_split(weighted, _floors(allowed(own.postings), weighted, index, k, boosts), boosts))
    finding = split.filter("finds").select("query_id", "field", "term", "weight", "mean_length", "boost", "bound", "all", "floor", "rest")
    if own.blocks is None:
        parts = _parts(allowed(own.postings), finding, "boost", "floor", "rest")
    else:  # a block none of whose documents can pass isn't unfolded
        blocks = own.blocks.join(finding, ["field", "term"]).filter(
            F.col("all") - F.col("bound") + F.col("best") * F.col("weight") * F.col("boost") >= F.col("floor") - MARGIN)
        postings = allowed(_unblocked(blocks, "query_id", "weight", "mean_length", "boost", "floor", "rest"))
        parts = postings.select("query_id", "doc_id", "field", (F.col("weight") * _share()).alias("part"), "boost", "floor", "rest")
    found = parts.groupBy("query_id", "doc_id", "field", "boost", "floor", "rest").agg(F.sum("part").alias("part"))
    passing = found.filter(F.col("part") * F.col("boost") + F.col("rest") >= F.col("floor") - MARGIN)
    return (cut(passing.select("query_id", "doc_id", "field", "part")),
            split.filter("not finds").select("query_id", "field", "term", "weight", "mean_length"))


def search_many(index: Index, queries: DataFrame, k: int = DEFAULT_SIZE, fuzzy: bool = True,
                boosts: Mapping[str, float] = BOOSTS, docs: DataFrame | None = None) -> DataFrame:
    """Top ``k`` documents per query; ``docs(doc_id)`` restricts what may be found."""
    weighted = cut(weighted_terms(index, queries, fuzzy))
    passing, missing = candidates(index, weighted, k, boosts, docs)
    more = _missing(passing.select("query_id", "doc_id", "field"), missing, index.of_terms(missing).postings)
    found = passing.unionByName(more).groupBy("query_id", "doc_id").agg(_best(index, boosts).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def _one(spark: SparkSession, query: str) -> DataFrame:
    if not query:
        raise ValueError("the query must not be empty")
    return spark.createDataFrame([(0, query)], "query_id int, query string")


def search(index: Index, pages: DataFrame, query: str, job_id: str | None = None, size: int = DEFAULT_SIZE,
           fuzzy: bool = True, highlights: bool = True) -> DataFrame:
    """Best pages for one query, without their text.

    ``pages(doc_id, job_id, url, title, content, depth, status_code, crawled_at)``.
    """
    if not 1 <= size <= MAX_SIZE:
        raise ValueError(f"size must be 1..{MAX_SIZE}")
    queries = _one(pages.sparkSession, query)
    found = score(index, queries, fuzzy)
    if job_id is not None:
        found = found.join(pages.filter(F.col("job_id") == job_id).select("doc_id"), "doc_id", "left_semi")
    best = found.orderBy(F.desc("score"), "doc_id").limit(size).collect()  # MAX_SIZE rows at most
    hits = pages.sparkSession.createDataFrame(best, found.schema)
    shown = ["doc_id", "job_id", "url", "title", "depth", "status_code", "crawled_at", "score"]
    # the ids reach the scan, so of the pages' text only what may hold a hit is read
    rows = pages.filter(F.col("doc_id").isin([r.doc_id for r in best])).join(F.broadcast(hits), "doc_id")
    if highlights:
        rows = highlight(rows, queries, index, fuzzy)
        shown.append("highlights")
    return rows.select(*shown).orderBy(F.desc("score"), "doc_id")


def highlight(hits: DataFrame, queries: DataFrame, index: Index, fuzzy: bool = True) -> DataFrame:
    """Add ``highlights`` (field -> fragments) to the few hit rows with ``query_id, title, content``."""
    qterms = query_terms(queries, index.analyzer)
    if fuzzy:
        words = qterms.join(expand_terms(qterms, index.terms).select("qterm", "term"), "qterm")
    else:
        words = qterms.withColumn("term", F.col("qterm"))
    per_query = words.groupBy("query_id").agg(F.collect_set("term").alias("_terms"))
    analyzer = index.analyzer

    @F.pandas_udf("struct<title:array<string>,content:array<string>>")
    def marked(title: pd.Series, content: pd.Series, terms: pd.Series) -> pd.DataFrame:
        rows = []
        for t, c, ws in zip(title, content, terms):
            known = set(ws if ws is not None else [])
            rows.append({"title": T.mark(t or "", known, analyzer, 1, 0),
                         "content": T.mark(c or "", known, analyzer, T.FRAGMENTS, T.FRAGMENT_SIZE)})
        return pd.DataFrame(rows, columns=["title", "content"])

    both = F.create_map(F.lit("title"), F.col("_m.title"), F.lit("content"), F.col("_m.content"))
    return (hits.join(per_query, "query_id", "left")
            .withColumn("_m", marked("title", "content", "_terms"))
            .withColumn("highlights", F.map_filter(both, lambda _, v: F.size(v) > 0))
            .drop("_m", "_terms"))
