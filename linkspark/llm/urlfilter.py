"""URL lists with a blocked Bloom filter before an exact hash join, in DataFrame functions alone.

A rule is a host and a path prefix. It fits its host and all subdomains, where the path starts with the prefix;
the longest rule wins (characters of host and path together, then of the host; ``block`` before ``allow`` where a
list holds one rule twice). The listed hosts and the listed rules, in canonical form, are set as bits of a blocked
Bloom filter: a key has one bit in each of the four words of one block. The filter is one array of at most
``MOST_WORDS`` words, worked out once as a scalar subquery. A row's possible hits - suffixes of its host, then
prefixes of its path, of listed lengths - are tested inside the row. Rows without any pass straight on, unshuffled.
The others are joined with the list on host and path, which removes what the filter let through by chance; in
which of the two ways Spark joins follows from the list's measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.rows import riding, unpacked
from linkspark.session import cut

RESULT = ("host", "path", "rule", "verdict")
LANES = 4  # words of a block; a key has a bit in each
BITS = 16  # per key, while the filter can still grow
GROUP = 1024  # words that are gathered at a time
MOST_WORDS = 1 << 22  # 32 MB; with more keys the filter lets more pass, and the join drops more
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: str | Column) -> Column:
    column = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(column, "://")
    return F.when(at > 0, F.substring(column, at + 3, F.length(column))).otherwise("")


def canonical(rules: DataFrame) -> DataFrame:
    """(host, path, verdict): one row per rule, hosts with A-Z in lower case; rules with a null part are none."""
    lower = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna()
    return lower.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block before allow


def _lanes(code: Column, words: int) -> list[tuple[Column, Column]]:
    """(number of the word, its bit) of a key's hash, for every word of its block."""
    block = F.shiftrightunsigned(code, 24).bitwiseAND(F.lit(words // LANES - 1).cast("long")) * LANES
    bit = [F.shiftrightunsigned(code, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(LANES)]
    return [(block + i, F.call_function("shiftleft", F.lit(1).cast("long"), b)) for i, b in enumerate(bit)]


def _host_code(host: Column) -> Column:
    return F.xxhash64(F.lit(1), host)


def _rule_code(host: Column, path: Column) -> Column:
    return F.xxhash64(F.lit(2), host, path)


class UrlList:
    """A list of rules: its filter and its bounds, and the rules themselves."""

    def __init__(self, rules: DataFrame, most_words: int = MOST_WORDS) -> None:
        self.rules = cut(canonical(rules))
        n, self.host_chars, self.path_chars = self.rules.agg(
            F.count("*"), F.coalesce(F.max(F.length("host")), F.lit(0)), F.coalesce(F.max(F.length("path")), F.lit(0))).first()
        self.words = GROUP
        while self.words < min(most_words, 2 * n * BITS // 64):  # a rule sets two keys: its host, and itself
            self.words *= 2
        # written, so that what every use of it repeats in a plan is a scan of one row
        self.filter = cut(self._built())

    def _built(self) -> DataFrame:
        """One row: ``bits``, the filter as an array of arrays of ``GROUP`` words, and ``lengths`` of listed paths.

        There are no more lengths than characters in the longest path.
        """
        code = F.explode(F.array(_host_code(F.col("host")), _rule_code(F.col("host"), F.col("path"))))
        codes = self.rules.select(code.alias("code")).distinct()
        lanes = F.array(*[F.struct(at.alias("word"), bit.alias("bit")) for at, bit in _lanes(F.col("code"), self.words)])
        own = codes.select(F.inline(lanes)).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        every = self.rules.sparkSession.range(self.words).withColumnRenamed("id", "word").join(own, "word", "left")
        groups = every.groupBy(F.floor(F.col("word") / GROUP).alias("group")).agg(
            F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
        whole = groups.agg(F.sort_array(F.collect_list(F.struct("group", F.col("w.bits").alias("bits")))).alias("g"))
        lengths = self.rules.agg(F.sort_array(F.collect_set(F.length("path")))).scalar()
        return whole.select(F.col("g.bits").alias("bits"), lengths.alias("lengths"))

    def _listed(self, code: Column) -> Column:
        """Whether the filter holds a key with this hash."""
        hit = None
        for at, bit in _lanes(code, self.words):
            word = F.get(F.get(F.col("_bits"), F.floor(at / GROUP).cast("int")), (at % GROUP).cast("int"))
            own = word.bitwiseAND(bit) != 0
            hit = own if hit is None else hit & own
        return hit

    def _suffixes(self) -> Column:
        """The host and its ends after each dot, as far as they are no longer than the longest listed host."""
        longer = F.length("_host") > self.host_chars
        end = F.when(longer, F.right("_host", F.lit(self.host_chars + 1))).otherwise(F.col("_host"))
        labels = F.split(end, r"\.", -1)
        first = F.when(longer, 1).otherwise(0)  # a label that was cut begins no host
        own = F.transform(F.sequence(first, F.size(labels) - 1), lambda i: F.array_join(
            F.slice(labels, i + 1, F.size(labels)), "."))
        return F.when(F.size(labels) > first, own).otherwise(F.array().cast("array<string>"))

    def possible(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``_host`` and ``_path``) plus ``_keys``: the listed rules that the filter holds possible."""
        rows = rows.withColumn("_bits", self.filter.select("bits").scalar()).withColumn(
            "_lengths", self.filter.select("lengths").scalar())
        rows = rows.withColumn("_hosts", F.filter(self._suffixes(), lambda h: self._listed(_host_code(h))))
        keys = F.flatten(F.transform("_hosts", lambda h: F.transform(
            F.filter("_lengths", lambda n: n <= F.length("_path")),
            lambda n: F.struct(h.alias("host"), F.substring(F.col("_path"), F.lit(1), n).alias("path")))))
        keys = F.when(F.size("_hosts") > 0, F.filter(keys, lambda k: self._listed(_rule_code(k["host"], k["path"]))))
        return rows.withColumn("_keys", F.coalesce(keys, F.array().cast("array<struct<host:string,path:string>>"))).drop(
            "_bits", "_lengths", "_hosts")

    def judge(self, df: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
        """``df`` plus ``host``, ``path``, ``rule`` (host and path, null if none fits) and ``verdict``.

        A null url, or one without ``://``, has an empty host and path and gets ``default``, as do all rows with an
        empty list. Repeated rows are judged each; columns of these names are replaced. Length is no matter: of a
        host only as many characters count as the longest listed host has, of a path only listed prefixes.
        """
        names, rest = riding(df, replaced=RESULT)
        address = F.col(f"`{url}`")
        rows = df.select(rest, host_of(address).alias("_host"), path_of(address).alias("_path"))
        judged = self.possible(rows)
        clear = judged.filter(F.size("_keys") == 0).select(
            "_row", "_host", "_path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("own"))

        # exact: what the filter held possible against the rules, once for all rows of a host and path
        asked = self.possible(df.select(host_of(address).alias("_host"), path_of(address).alias("_path")))
        asked = asked.filter(F.size("_keys") > 0).select("_host", "_path", F.inline("_keys"))
        rank = F.struct(F.length("host") + F.length("path"), F.length("host"))
        best = asked.join(self.rules, ["host", "path"]).groupBy("_host", "_path").agg(
            F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), rank).alias("best"))
        best = cut(best.select("_host", "_path", "best.rule", F.col("best.verdict").alias("own")))
        met = judged.filter(F.size("_keys") > 0).select("_row", "_host", "_path").join(best, ["_host", "_path"], "left")
        every = clear.unionByName(met.select("_row", "_host", "_path", "rule", "own"))
        return every.select(*unpacked(names), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
                            F.coalesce("own", F.lit(default)).alias("verdict"))


def rules_of(spark, rules) -> DataFrame:
    """A few (verdict, host, path) as a table; longer lists are read from files."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """See ``UrlList.judge``."""
    return UrlList(rules).judge(df, url, default)
