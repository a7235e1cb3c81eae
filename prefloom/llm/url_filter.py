"""URL filters from dated lists: validity intervals and an as-of join.

List entries are dated: on some day a host or domain, optionally with the beginning of a path,
is put on a list or taken off it. Each (list, host, path) is folded into validity intervals,
from the day of an addition to the day of the next removal, the last one open. A capture is
judged by the entries that were valid on the day it was fetched.

An entry covers its host and all hosts below it, and its path in whole segments. So a capture has
one key for each parent domain and each beginning of its path, and meets entries by equality. The
as-of condition is then looked up in the key's intervals: entries of one day collapse first, so
a key's history is never longer than the calendar. Verdicts are made once for each distinct
(URL, day) and dealt over salts where they meet a key that many captures share.

Edge cases: captures without a URL, host or day match nothing; hosts are compared in lower case
without user, port or final dot; of an addition and a removal on one day the addition counts; a
removal of what is not listed does nothing; entries without list, host, day or kind are
ignored; repeated captures are judged each on their own. Either table may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.batches import fresh_name
from prefloom.llm.tables import beside, stored

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, null if there is none."""
    authority = F.regexp_extract(F.lower(url), SCHEME + r"([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of an absolute URL without its final slash; empty at the root."""
    return F.regexp_replace(F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1), r"/+$", "")


def domains(host: Column) -> Column:
    """The host and its parents of two labels or more; a single label stands for itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def beginnings(path: Column) -> Column:
    """The path and what it begins with, in whole segments, the empty path among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def intervals(entries: DataFrame) -> DataFrame:
    """``host, path, spans``: per key an array of ``list, start, stop``, ``stop`` null while open.

    ``entries`` has ``list, host, path, day, added``; a null path means the whole host.
    """
    usable = entries.where("list is not null and host is not null and day is not null and added is not null")
    path = F.regexp_replace(F.coalesce("path", F.lit("")), r"/+$", "")
    daily = usable.groupBy("list", F.lower("host").alias("host"), path.alias("path"), "day").agg(F.max("added").alias("added"))
    history = daily.groupBy("list", "host", "path").agg(F.array_sort(F.collect_list(F.struct("day", "added"))).alias("h"))
    turns = F.filter("h", lambda x, i: F.when(i == 0, x["added"]).otherwise(x["added"] != F.get("h", i - 1)["added"]))
    # Additions and removals take turns now, from an addition on.
    turned = history.withColumn("h", turns)
    spans = F.filter(F.transform("h", lambda x, i: F.struct(
        F.col("list").alias("list"), x["day"].alias("start"), F.get("h", i + 1)["day"].alias("stop"), x["added"].alias("added"))),
        lambda x: x["added"])
    spans = F.transform(spans, lambda x: F.struct(x["list"].alias("list"), x["start"].alias("start"), x["stop"].alias("stop")))
    return turned.select("host", "path", spans.alias("spans")).groupBy("host", "path").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with ``host``, ``n_entries`` valid when fetched, ``lists`` (sorted) and ``blocked``.

    ``n_entries`` counts (list, host, path) entries. Columns of those names are refused.
    """
    added = ["host", "n_entries", "lists", "blocked"]
    if clash := {c.lower() for c in captures.columns} & set(added):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    seen = captures.where(F.col(url).isNotNull() & F.col(day).isNotNull()).select(F.col(url).alias("u"), F.col(day).alias("d")).distinct()
    keyed = seen.withColumn("host", F.explode(domains(host_of(F.col("u"))))).withColumn(
        "path", F.explode(beginnings(path_of(F.col("u")))))
    met = beside(keyed, intervals(entries), ["host", "path"], ["u", "d"])
    valid = F.filter("spans", lambda x: (x["start"] <= F.col("d")) & (x["stop"].isNull() | (F.col("d") < x["stop"])))
    verdicts = met.withColumn("v", valid).where(F.size("v") > 0).groupBy("u", "d").agg(
        F.sum(F.size("v")).alias("n_entries"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("v", lambda x: x["list"]))))).alias("lists"))
    verdicts = stored(verdicts, "verdicts")
    u, d = fresh_name(captures, "_u"), fresh_name(captures, "_d")
    verdicts = verdicts.withColumnsRenamed({"u": u, "d": d})
    joined = captures.join(verdicts, (captures[url] == verdicts[u]) & (captures[day] == verdicts[d]), "left")
    return joined.select(*[captures[c] for c in captures.columns], host_of(captures[url]).alias("host"),
                         F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
                         F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
                         F.col("n_entries").isNotNull().alias("blocked"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture, fetched on a day that follows from its id."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list entry from every page: its host or domain, some with the path's first segment.

    Three of four entries are additions; list, day and reach follow from the id.
    """
    i, host = F.col("page_id"), host_of(F.col("url"))
    name = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (i % 3 + 1).cast("int"))
    first = F.element_at(beginnings(path_of(F.col("url"))), 2)
    return pages.select(
        name.alias("list"), F.when(i % 7 == 0, F.element_at(domains(host), -1)).otherwise(host).alias("host"),
        F.when(i % 2 == 0, F.when(F.size(F.split(path_of(F.col("url")), "/")) > 1, first)).alias("path"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(i * 53, F.lit(730)).cast("int")).alias("day"),
        (i % 4 != 3).alias("added"))


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, page_id, url,
         nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', ''), '') AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS day FROM pages),
entries AS (
  SELECT ['adult', 'malware', 'spam'][page_id % 3 + 1] AS list,
         CASE WHEN page_id % 7 = 0 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS host,
         CASE WHEN page_id % 2 = 0 AND len(string_split(path, '/')) > 1 THEN '/' || string_split(path, '/')[2] ELSE '' END AS path,
         DATE '2023-01-01' + CAST(page_id * 53 % 730 AS INTEGER) AS day, page_id % 4 <> 3 AS added FROM base),
daily AS (
  SELECT list, host, path, day, bool_or(added) AS added FROM entries WHERE host IS NOT NULL GROUP BY ALL),
lists AS (SELECT DISTINCT list FROM daily),
hosts AS (
  SELECT r, path, day, array_to_string(labels[i:], '.') AS host FROM (
    SELECT r, path, day, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i
    FROM (SELECT r, path, day, string_split(host, '.') AS labels FROM base WHERE host IS NOT NULL))),
keys AS (
  SELECT r, day, host, array_to_string(parts[1:i], '/') AS path FROM (
    SELECT r, day, host, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT r, day, host, string_split(path, '/') AS parts FROM hosts))),
valid AS (
  SELECT k.r, k.list FROM (SELECT keys.*, list FROM keys CROSS JOIN lists) k
  ASOF JOIN daily d ON k.list = d.list AND k.host = d.host AND k.path = d.path AND k.day >= d.day WHERE d.added),
verdicts AS (SELECT r, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM valid GROUP BY r)
SELECT page_id, day, host, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM base LEFT JOIN verdicts USING (r)
"""
