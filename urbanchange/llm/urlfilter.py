"""URL filters with dated lists: every capture is judged by the entries active when it was fetched.

List events (an entry is added or removed at a time) become validity intervals: an addition holds
until the next event of the same entry. A capture looks itself up under its host, every parent
domain and every leading path of its URL. The as-of join is an equi-join on the looked-up key and
a time bucket, into each of which the intervals are laid that touch it; so a key with a long
history is split by time, and a popular key is an ordinary skewed join of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanchange.llm.common import written

DAYS = 91  # of a time bucket


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def lookup_keys(url: Column) -> Column:
    """Array of (kind, key): the host, its domains (itself too), and host/path beginnings."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")),
    )
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    paths = F.transform(
        steps,
        lambda s, i: F.struct(
            F.lit("prefix").alias("kind"),
            F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")).alias("key"),
        ),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(own, domains, paths)))


def intervals(events: DataFrame) -> DataFrame:
    """``list``, ``kind``, ``key``, ``since``, ``until`` (null: still valid) of all additions.

    ``events`` has ``list``, ``kind``, ``key``, ``action`` (add or remove) and ``at``. Of events
    of one entry at the same time, the removal comes last. Repeated additions end the interval
    before and begin the next, so intervals of one entry never overlap.
    """
    entry = Window.partitionBy("list", "kind", "key").orderBy("at", "action")
    known = events.where("at is not null and key is not null").distinct()
    with_next = known.withColumn("until", F.lead("at").over(entry))
    return with_next.where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("at")))).select(
        "list", "kind", "key", F.col("at").alias("since"), "until"
    )


def _bucket(time: Column) -> Column:
    return F.floor(F.datediff(time, F.lit("1970-01-01").cast("date")) / DAYS).cast("int")


def evaluate(captures: DataFrame, events: DataFrame, id_col: str, url: str, fetched: str) -> DataFrame:
    """Every capture: id, ``host``, ``n_active`` entries, ``lists`` that hold one, and ``kept``.

    A capture without a host or without a fetch time meets no entry and is kept; ids may be null
    or repeat, for every row is judged by itself; an empty list keeps all. An interval holds from
    ``since`` to before ``until``. Other columns are left aside.
    """
    # written, as a lost executor must not number the rows of the two branches differently
    rows = written(captures.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        host_of(F.col(url)).alias("host"), F.col(fetched).alias("t"), lookup_keys(F.col(url)).alias("keys"),
    ))
    asked = rows.where("t is not null").select("row", "t", _bucket(F.col("t")).alias("bucket"), F.explode("keys").alias("q"))
    asked = asked.select("row", "t", "bucket", "q.kind", "q.key")
    spans = intervals(events)
    # intervals that are still open end in the bucket of the last capture
    horizon = rows.agg(_bucket(F.max("t"))).first()[0]
    horizon = -(1 << 20) if horizon is None else horizon
    first = _bucket(F.col("since"))
    end = F.least(F.coalesce(_bucket(F.col("until")), F.lit(horizon)), F.lit(horizon))
    laid = spans.where(first <= end).withColumn("bucket", F.explode(F.sequence(first, end)))
    met = asked.join(laid, ["kind", "key", "bucket"]).where(
        (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    )
    found = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_active"), F.sort_array(F.collect_set("list")).alias("lists"))
    return rows.drop("keys", "t").join(found, "row", "left").select(
        F.col("id").alias(id_col), "host",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"),
        F.col("n_active").isNull().alias("kept"),
    )


# -- dated lists and fetch times from a page table --------------------------------------------


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day that follows from the id, spread over four years."""
    day = F.pmod(F.col("page_id") * 37, F.lit(1461)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), day).alias("fetched"))


def page_list_events(pages: DataFrame) -> DataFrame:
    """A dated list from the hosts themselves: every third host, all domains of two labels, and
    some leading paths are listed for a while, some of them twice."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host is not null")
    by_host = hosts.groupBy("host").agg(F.min("page_id").alias("n"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    by_domain = hosts.where(domain != "").groupBy(domain.alias("key")).agg(F.min("page_id").alias("n"))
    step = F.regexp_extract("path", r"^/([^/]+)", 1)
    by_path = hosts.where(step != "").groupBy(F.concat("host", F.lit("/"), step).alias("key")).agg(F.min("page_id").alias("n"))
    entries = (
        by_host.where("n % 3 = 0").select(F.lit("spam").alias("list"), F.lit("host").alias("kind"), F.col("host").alias("key"), "n")
        .union(by_domain.select(F.lit("adult"), F.lit("domain"), "key", "n"))
        .union(by_path.where("n % 5 = 1").select(F.lit("piracy"), F.lit("prefix"), "key", "n"))
    )
    day = lambda k: F.date_add(F.lit("2020-01-01").cast("date"), (F.pmod(F.col("n") * 17, F.lit(700)) + k).cast("int"))
    dated = F.array(
        F.struct(F.lit("add").alias("action"), day(0).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(300).alias("at")),
        F.struct(F.when(F.col("n") % 2 == 0, F.lit("add")).alias("action"), day(500).alias("at")),
    )
    return entries.select("list", "kind", "key", F.explode(dated).alias("e")).where("e.action is not null").select(
        "list", "kind", "key", "e.action", "e.at"
    )


_URL = "'^[A-Za-z][A-Za-z0-9+.-]*://"
ORACLE = f"""
WITH p AS (
  SELECT page_id, url,
    DATE '2020-01-01' + CAST(page_id * 37 % 1461 AS INTEGER) AS fetched,
    nullif(lower(regexp_replace(regexp_replace(
      regexp_extract(url, {_URL}([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host,
    regexp_extract(url, {_URL}[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
by_host AS (SELECT host AS key, min(page_id) AS n FROM p WHERE host IS NOT NULL GROUP BY 1),
by_domain AS (
  SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS key, min(page_id) AS n FROM p
  WHERE host IS NOT NULL GROUP BY 1 HAVING key <> ''),
by_path AS (
  SELECT host || '/' || regexp_extract(path, '^/([^/]+)', 1) AS key, min(page_id) AS n FROM p
  WHERE host IS NOT NULL AND regexp_extract(path, '^/([^/]+)', 1) <> '' GROUP BY 1),
entries AS (
  SELECT 'spam' AS list, 'host' AS kind, key, n FROM by_host WHERE n % 3 = 0
  UNION ALL SELECT 'adult', 'domain', key, n FROM by_domain
  UNION ALL SELECT 'piracy', 'prefix', key, n FROM by_path WHERE n % 5 = 1),
spans AS (
  SELECT list, kind, key, DATE '2020-01-01' + CAST(n * 17 % 700 AS INTEGER) AS since,
         DATE '2020-01-01' + CAST(n * 17 % 700 + 300 AS INTEGER) AS until FROM entries
  UNION ALL
  SELECT list, kind, key, DATE '2020-01-01' + CAST(n * 17 % 700 + 500 AS INTEGER), DATE '9999-01-01'
  FROM entries WHERE n % 2 = 0),
met AS (
  SELECT p.page_id, s.list FROM p JOIN spans s ON s.kind = 'host' AND s.key = p.host
    AND fetched >= since AND fetched < until
  UNION ALL
  SELECT p.page_id, s.list FROM p JOIN spans s ON s.kind = 'domain'
    AND s.key = regexp_extract(p.host, '([^.]+\\.[^.]+)$', 1) AND fetched >= since AND fetched < until
  UNION ALL
  SELECT p.page_id, s.list FROM p JOIN spans s ON s.kind = 'prefix'
    AND s.key = p.host || '/' || regexp_extract(p.path, '^/*([^/]+)', 1) AND fetched >= since AND fetched < until)
SELECT p.page_id, any_value(p.host) AS host, count(m.list) AS n_active,
       coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists, count(m.list) = 0 AS kept
FROM p LEFT JOIN met m USING (page_id) GROUP BY p.page_id
"""
