"""URL filters: rules by host and path, and a block list held as a Bloom filter cascade.

The cascade: level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 takes
for listed by mistake, level 3 the listed keys that level 2 takes for those, and so on until a
level makes no mistake over the complete key universe.  A key's first level that lacks it tells
exactly whether it is listed, without a join.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut

#: Bits for each key of a level, and hash functions.
BITS_PER_KEY, HASHES = 12, 4
#: Bytes that all levels may have to be sent to every task.  Beyond it listed keys are joined.
CASCADE_BYTES = 16 << 20
#: Levels after which a cascade is given up.
MOST_LEVELS = 200

#: (verdict, host, path); fixed by the task.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Setting that names a Parquet table of listed hosts (column key).
LIST_SETTING = "spark.folioscope.blocklist"
#: Hosts of the block list where the setting is not made; each stands for its subdomains too.
LISTED = ["ads-track.example.com", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def domains(host: Column) -> Column:
    """The host and what is left of it without its first labels."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def words_needed(n: int) -> int:
    """64-bit words of a level of n keys."""
    return max(1, -(-n * BITS_PER_KEY // 64))


class Level:
    """One Bloom filter: words of 64 bits in one row."""

    def __init__(self, keys: DataFrame, n: int, number: int) -> None:
        self.number, self.n_words = number, words_needed(n)
        spots = keys.select(F.explode(F.array(*[self.spot(F.col("key"), j) for j in range(HASHES)])).alias("p"))
        words = spots.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        empty = keys.sparkSession.range(self.n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        every = words.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        # one value of a size that was tested before (see Cascade)
        row = every.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
        self.row = cut(row.select(F.transform("w", lambda x: x["bits"]).alias("words")))

    def spot(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number * HASHES + j)), F.lit(64 * self.n_words))

    def holds(self, key: Column, words: Column) -> Column:
        out = F.lit(True)
        for j in range(HASHES):
            p = self.spot(key, j)
            out = out & (F.getbit(F.get(words, (F.floor(p / 64)).cast("int")), (p % 64).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership of the listed keys among all keys of the universe.

    `whole` is false if the levels would take more than `limit` bytes, or if MOST_LEVELS don't
    end it: then it tells nothing, and the listed keys must be joined.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, limit: int = CASCADE_BYTES) -> None:
        """Both with one column, key.  Nulls are ignored."""
        listed = cut(listed.select("key").where("key is not null").distinct())
        self.levels: list[Level] = []
        n, others = listed.count(), None
        coded, rest = listed, None
        while n and len(self.levels) < MOST_LEVELS and self.bytes + 8 * words_needed(n) <= limit:
            if others is None:
                others = rest = cut(universe.where("key is not null").distinct().join(listed, "key", "left_anti"))
            self.levels.append(level := Level(coded, n, len(self.levels)))
            wrong = cut(rest.withColumn("__w", level.row.scalar()).where(level.holds(F.col("key"), F.col("__w"))).select("key"))
            coded, rest, n = wrong, coded, wrong.count()
        self.whole = not n

    @property
    def bytes(self) -> int:
        return 8 * sum(level.n_words for level in self.levels)

    def columns(self) -> dict[str, Column]:
        return {f"__level{i}": level.row.scalar() for i, level in enumerate(self.levels)}

    def holds(self, key: Column) -> Column:
        """Whether key is listed; needs columns() in the frame."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].holds(key, F.col(f"__level{i}")), out).otherwise(F.lit(i % 2 == 1))
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, key: str = "page_id", url: str = "url", limit: int = CASCADE_BYTES) -> DataFrame:
    """key, host, path, rule, verdict: one row for each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins
    (of equally long ones the first).  Without a rule, a url is blocked if its host or a parent
    domain is listed.  A null url or one without :// has an empty host and path, fits no rule and
    is allowed; null and repeated keys and repeated rows are kept, other columns are ignored,
    whatever their names.  listed has a column key (nulls and repeats don't matter, it may be
    empty); an empty table of pages gives no rows.
    """
    base = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    base = base.select("__key", host.alias("__host"), path.alias("__path"))
    universe = base.select("__host").distinct().select(F.explode(domains(F.col("__host"))).alias("key"))
    cascade = Cascade(listed, universe, limit)
    if cascade.whole:
        with_bits = base.withColumns(cascade.columns()) if cascade.levels else base
        blocked = F.exists(domains(F.col("__host")), cascade.holds) if cascade.levels else F.lit(False)
    else:
        bad = base.select("__host").distinct().select("__host", F.explode(domains(F.col("__host"))).alias("key")).join(listed, "key", "left_semi").select("__host").distinct()
        with_bits = base.join(bad.withColumn("__bad", F.lit(True)), "__host", "left")
        blocked = F.coalesce("__bad", F.lit(False))
    rule, verdict = F.lit(None).cast("string"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((F.col("__host") == h) | F.endswith(F.col("__host"), F.lit("." + h))) & F.startswith(F.col("__path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return with_bits.select(F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.conf.get(LIST_SETTING, None)
    listed = spark.read.parquet(named).select("key") if named else spark.createDataFrame([(x,) for x in LISTED], "key string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, listed)


_FITS = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out}'"
_ORDER = sorted(RULES, key=lambda r: len(r[1] + r[2]), reverse=True)
SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(r, '') AS r FROM rest))
SELECT page_id, host, path,
  CASE {" ".join(_FITS.format(h=h, p=p, out=h + p) for _, h, p in _ORDER)} END AS rule,
  CASE {" ".join(_FITS.format(h=h, p=p, out=v) for v, h, p in _ORDER)}
       {" ".join(f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN 'block'" for h in LISTED)} ELSE 'allow' END AS verdict
FROM parts
"""

QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE_SQL = {"op6_url_filter": SQL}
