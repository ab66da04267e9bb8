"""URL filters by a temporal join with a dated list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, table, written

_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: Hosts that are addresses, and so have no parent domains.
_ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot, an IPv6 address in its brackets; null if there
    is none. A url without a scheme has one if it begins with two slashes."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """entries(kind, pattern, action, at) as validity intervals: kind, pattern, since, until.

    kind is host (that host) or domain (the host and all below it), action add or remove. An entry
    holds from its add, that instant included, until the next action on it, excluded, or for ever.
    Repeated actions change nothing; of an add and a remove at one instant the remove counts. Rows
    with a null, or of another kind or action, are left out. The window holds one pattern's dates."""
    own = narrow(entries, "kind", "pattern", "action", "at").where("kind in ('host', 'domain') and action in ('add', 'remove') and pattern is not null and at is not null")
    own = own.groupBy("kind", F.lower("pattern").alias("pattern"), "at").agg(F.max("action").alias("action"))
    turn = own.withColumn("until", F.lead("at").over(Window.partitionBy("kind", "pattern").orderBy("at")))
    return turn.where("action = 'add' and (until is null or until > at)").select("kind", "pattern", F.col("at").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of captures(page_id, url, fetched): page_id, host, fetched, blocked, n_active, pattern.

    An as-of join: a capture is judged by the entries active when it was fetched. Captures first
    shrink to distinct hosts, which meet the list under each of their parent domains. These hosts'
    intervals are a table of known size: captures meet it without a shuffle if it is small enough to
    send, else by a join that Spark splits at a hot host. What is active then counts by capture. So
    neither a host's captures nor its history is ever collected.

    n_active counts the active entries; pattern is the longest, host before domain, ties by name. A
    null url or one without a host, and a null fetch time, meet no entry. A long url counts as any.
    Repeated rows repeat. Empty tables give no rows, or nothing blocked; other columns are not read,
    whatever their names."""
    own = narrow(captures, "page_id", "url", "fetched").select("page_id", host_of(F.col("url")).alias("host"), "fetched")
    hosts = own.where("host is not null").select("host").distinct()
    whole = hosts.select("host", F.when(F.col("host").rlike(_ADDRESS), F.array("host")).otherwise(F.split("host", r"\.")).alias("labels"))
    below = whole.select("host", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")).alias("name"))
    met = below.join(intervals(entries), (F.col("name") == F.col("pattern")) & ((F.col("kind") == "domain") | (F.col("name") == F.col("host"))))
    met = written(met.select(F.col("host").alias("of"), "kind", "pattern", "since", "until"))
    on = (F.col("host") == F.col("of")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    active = own.withColumn("row", F.monotonically_increasing_id()).join(met, on, "left")
    best = F.max(F.struct(F.length("pattern").alias("n"), "kind", "pattern"))
    judged = active.groupBy("row", "page_id", "host", "fetched").agg(F.count("pattern").alias("n_active"), best.alias("best"))
    return judged.select("page_id", "host", "fetched", (F.col("n_active") > 0).alias("blocked"), "n_active", F.col("best.pattern").alias("pattern"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages, derived from their md5: about a third of the hosts are
    listed alone, a third by their parent domain, each removed some days later and some added again.
    Dates are minutes."""
    hosts = pages.select(host_of(pages["url"]).alias("host")).where("host is not null").distinct()
    h = hosts.withColumn("v", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("bigint"))
    h = h.where("v % 3 < 2").withColumn("kind", F.expr("if(v % 3 = 0, 'host', 'domain')"))
    h = h.withColumn("pattern", F.when(F.col("kind") == "host", F.col("host")).otherwise(F.regexp_replace("host", r"^(www|blog)\.", "")))
    acts = F.expr("""array(struct('add' as action, v % 20000 as at), struct('remove' as action, v % 20000 + 5000 + v % 7000 as at),
                           struct(if(v % 2 = 0, 'add', 'remove') as action, v % 20000 + 20000 as at))""")
    return h.select("kind", "pattern", F.explode(acts).alias("a")).select("kind", "pattern", "a.action", "a.at")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures fetched at minute (page_id * 7919) % 57600, against the list derived from the hosts."""
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(57600)).alias("fetched")), dated_list(pages))


OP10_SQL = rf"""
with c as (select page_id, nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', ''), '') as host,
                  ((page_id * 7919) % 57600 + 57600) % 57600 as fetched from pages),
h as (select host, cast('0x' || substr(md5(host), 1, 6) as bigint) as v from (select distinct host from c where host is not null)),
l as (select case when v % 3 = 0 then 'host' else 'domain' end as kind, v,
             case when v % 3 = 0 then host else regexp_replace(host, '^(www|blog)\.', '') end as pattern from h where v % 3 < 2),
e as (select kind, pattern, 'add' as action, v % 20000 as "at" from l
      union all select kind, pattern, 'remove', v % 20000 + 5000 + v % 7000 from l
      union all select kind, pattern, case when v % 2 = 0 then 'add' else 'remove' end, v % 20000 + 20000 from l),
o as (select kind, pattern, "at", max(action) as action from e group by kind, pattern, "at"),
t as (select *, lead("at") over (partition by kind, pattern order by "at") as until from o),
i as (select kind, pattern, "at" as since, until from t where action = 'add'),
m as (select c.page_id, i.pattern, row_number() over (partition by c.page_id order by length(i.pattern) desc, i.kind desc, i.pattern desc) as k
      from c join i on (c.host = i.pattern or (i.kind = 'domain' and not regexp_matches(c.host, '{_ADDRESS}') and ends_with(c.host, '.' || i.pattern)))
                   and i.since <= c.fetched and (i.until is null or c.fetched < i.until)),
g as (select page_id, count(*) as n, max(case when k = 1 then pattern end) as pattern from m group by page_id)
select c.page_id, c.host, c.fetched, coalesce(g.n, 0) > 0 as blocked, coalesce(g.n, 0) as n_active, g.pattern
from c left join g using (page_id)
"""
