"""URL filtering by a sort-merge range join of reversed-host keys.

The labels of a host in reverse, each with a dot behind it, make a key under
which a host and all its subdomains are one interval: ``com.example.`` up to,
not including, the first key without that prefix. Rules and distinct hosts are
sorted together within ranges of keys, a rule going to every range that its
interval meets, and swept in order. Intervals nest, so the rules that are open at
a place in the sweep form a stack, one slot for each number of labels: a rule
that begins fills the slot of its depth, and a slot counts until the sweep has
passed the end of its rule's interval. Of the open rules the longest whose path
fits the page's wins. All steps are SQL and DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: (host, path, verdict); the path starts at the first slash.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DEFAULT = "allow"
#: Distinct hosts in a range of keys, about, and ranges at least; the sweep is dealt
#: out over them.
RANGE_HOSTS, RANGES = 1 << 17, 64
#: Behind every key of a prefix: no character of a host sorts after it.
_PAST = "\U0010ffff"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.
    Both are empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    front = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.translate(F.regexp_extract(front, r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substring(front, F.length(host) + 1, F.length(front))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels in reverse, each with a dot behind it; a host without
    characters has the empty key, which no rule has."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _cuts(hosts: DataFrame, ranges: int) -> list[str]:
    """Keys that part the hosts into ranges of about equal size, ``ranges`` at
    most. Their exact place affects balance alone."""
    dealt = hosts.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("first"))
    return sorted(r["first"] for r in dealt.collect())  # one key a range


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the
    page's path starts with the rule's. The longest rule (host and path) wins; of
    equally long ones that with the longer host, then the one that blocks. Without
    a rule: rule null, verdict ``default``. Null urls have an empty host and path,
    which no rule fits; repeated rows repeat; rules with a null or empty host are
    not used; other columns are not looked at."""
    host, path = split_url(F.col(url).cast("string"))
    split = pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    hosts = written(split.select("key").distinct(), "hosts")
    cuts = _cuts(hosts, ranges or max(RANGES, -(-hosts.count() // RANGE_HOSTS)))
    bound = F.array(*map(F.lit, cuts)) if cuts else F.expr("cast(array() as array<string>)")
    place = lambda at: F.size(F.filter(bound, lambda c: c <= at))
    rule_host = F.translate(F.col("host").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = rules.where("host is not null and host <> ''").select(
        host_key(rule_host).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.concat(rule_host, F.coalesce("path", F.lit(""))).alias("rule"), F.col("verdict").cast("string").alias("verdict")
    )
    past = F.concat(F.col("key"), F.lit(_PAST))
    own = clean.groupBy("key").agg(F.collect_list(F.struct("key", "path", "rule", "verdict")).alias("rules"))
    own = written(own.withColumn("depth", F.size(F.split("key", r"\.", -1)) - 1), "rules")
    depths = sorted(r["depth"] for r in own.select("depth").distinct().collect())  # as many as a host has labels
    begun = own.select("key", "depth", "rules", F.explode(F.sequence(place(F.col("key")), place(past))).alias("range"))
    nothing = F.lit(None).cast(own.schema["rules"].dataType)
    events = hosts.select("key", F.lit(None).cast("int").alias("depth"), nothing.alias("rules"), place(F.col("key")).alias("range"), F.lit(1).alias("is_host")).unionByName(begun.withColumn("is_host", F.lit(0)))
    sweep = Window.partitionBy("range").orderBy("key", "is_host").rowsBetween(Window.unboundedPreceding, 0)
    slots = {f"slot{d}": F.last(F.when(F.col("depth") == d, F.struct("key", "rules")), ignorenulls=True).over(sweep) for d in depths}
    swept = events.select("key", "is_host", *[c.alias(n) for n, c in slots.items()]).where("is_host = 1")
    still = [F.when(F.col("key").startswith(F.col(n)["key"]), F.col(n)["rules"]) for n in slots]
    held = F.flatten(F.array_compact(F.array(*still))) if still else nothing
    live = written(swept.select("key", held.alias("open")).where(F.size("open") > 0), "open_rules")  # Spark splits a hot host in the join
    judged = split.join(live, "key", "left")
    fits = F.filter("open", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), F.length(r["key"]).alias("h"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return judged.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def op5_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = r"""
with r(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
f as (select page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') as front from u),
p as (select page_id, translate(regexp_extract(front, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             substr(front, length(regexp_extract(front, '^[^/]*')) + 1) as path from f)
select p.page_id, p.host, p.path,
       (select max_by(r.host || r.path, length(r.host || r.path)) from r where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)) as rule,
       coalesce((select max_by(r.verdict, length(r.host || r.path)) from r where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)), 'allow') as verdict
from p
"""
