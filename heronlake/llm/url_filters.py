"""URL filters: longest-match rules, then exact membership in a block list by a cascade of Bloom filters.

The universe of keys is every host of the corpus with its parent domains. The first filter encodes the listed keys of the universe; the
second the keys that the first takes by mistake; the third the listed keys that the second takes by mistake; and so on
until none is left. A key of the universe is listed if the number of filters that it passes in a row is odd: no error
either way, and no join when urls are judged. Filters are built by Spark (bits are or-ed by word) and stand in the plan as constants;
each is at most MAX_BITS. A longer list is cut by a hash of the keys into parts with a cascade each, at most MAX_PARTS (some 13 million listed
keys of the universe). The filters of a list beyond that would outgrow what a task should be sent; it is judged by an equi-join with the listed keys.

All in DataFrame functions. Keys are combined before they are shuffled, so a host that a third of all pages share costs one row a task.

Cases: a null url, or one without `://`, has empty host and path, fits no rule and is allowed; null listed keys are left out, repeated ones
count once; of rules of equal length the first in text order wins; repeated rows give repeated results; an empty table or list
gives an empty result or no block; columns of the input other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import Written, table

MAX_BITS = 1 << 23
MAX_PARTS = 16
BITS_A_KEY = 10
PROBES = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Domains on the query's block list; hosts of the corpus whose MD5 starts with LISTED_DIGIT stand on it too, so that it grows with the corpus.
LISTED_DIGIT = "0"
LISTED = ["casino-win.example.com", "cheap-pills.example.com", "click-bait.example.net", "free-prizes.example.net", "spam-farm.example.org", "tionsh.example.net", "thther.example.org"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class Level:
    """One filter: its words of 64 bits, kept as text that the optimiser turns into a constant array."""

    def __init__(self, keys: DataFrame, many: int, seed: int):
        self.seed, self.bits = seed, max(64, -(-many * BITS_A_KEY // 64) * 64)
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        words = places.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS INT))")).alias("bits"))
        got = {r["word"]: r["bits"] for r in words.collect()}  # at most MAX_BITS / 64 rows
        self.words = ",".join(str(got.get(w, 0)) for w in range(self.bits // 64))

    def _places(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.seed))
        a, b = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
        return [(a + b * k) % self.bits for k in range(PROBES)]

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in self._places(key):
            word = F.get(words, F.floor(at / 64).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


class Cascade:
    """Exact membership of keys of a universe that has `many` listed ones. universe: (key, listed)."""

    def __init__(self, universe: DataFrame, many: int):
        self.levels: list[Level] = []
        mine, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
        while many:
            self.levels.append(Level(mine, many, len(self.levels)))
            mine, other = Written(other.where(self.levels[-1].has(F.col("key"))), "false-keys").df, mine
            many = mine.count()

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].has(key), out).otherwise(F.lit(k % 2 == 1))
        return out


class Cascades:
    """A cascade for each part of the key space, as many as the listed keys need; fits tells whether MAX_PARTS suffice."""

    def __init__(self, universe: DataFrame):
        listed = universe.where("listed").count()
        n = max(1, -(-listed * BITS_A_KEY // MAX_BITS))
        n = n if n == 1 else n + n // 4 + 1  # room for uneven parts
        self.fits = n <= MAX_PARTS
        self.parts: list[Cascade] = []
        if self.fits:
            sizes = {r["part"]: r["n"] for r in universe.where("listed").groupBy(self._part(n).alias("part")).agg(F.count("*").alias("n")).collect()}  # at most MAX_PARTS rows
            self.parts = [Cascade(universe.where(self._part(n) == k), sizes.get(k, 0)) for k in range(n)]

    @staticmethod
    def _part(n: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(n))

    def has(self, key: Column) -> Column:
        out = self.parts[-1].has(key)
        at = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.parts)))
        for k in range(len(self.parts) - 2, -1, -1):
            out = F.when(at == k, self.parts[k].has(key)).otherwise(out)
        return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict). listed: key, a domain on the block list; it covers its subdomains."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keys = rows.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    marks = listed.where("key is not null").select("key").distinct().withColumn("listed", F.lit(True))
    universe = Written(keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    cascade = Cascades(universe.df)
    if cascade.fits:
        rows = rows.withColumn("blocked", F.exists(domains(F.col("host")), cascade.has))
    else:
        hosts = rows.select("host").distinct().select("host", F.explode(domains(F.col("host"))).alias("key"))
        bad = Written(hosts.join(universe.df.where("listed"), "key", "left_semi").select("host").distinct().withColumn("blocked", F.lit(True)), "blocked-hosts")
        rows = rows.join(bad.df, "host", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = host_and_path(F.col("url"))[0].alias("key")
    found = pages.select(host).distinct().where((F.col("key") != "") & (F.substring(F.md5(F.col("key").cast("binary")), 1, 1) == LISTED_DIGIT))
    return judge(pages, found.unionByName(spark.createDataFrame([(k,) for k in LISTED], "key string")), RULES)


OP6_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, rh, rp) AS (VALUES %s),
f AS (SELECT page_id, rh || rp AS rule, v FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) = 1),
k AS (SELECT unnest(%s) AS k UNION SELECT host FROM h WHERE host <> '' AND md5(host)[1] = '%s'),
b AS (SELECT DISTINCT page_id FROM h JOIN k ON host = k OR ends_with(host, '.' || k))
SELECT h.page_id, host, path, f.rule AS rule, coalesce(f.v, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN f USING (page_id) LEFT JOIN b USING (page_id)
""" % (", ".join(str(r) for r in RULES), LISTED, LISTED_DIGIT)
