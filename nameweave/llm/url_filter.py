"""URL filters over time: dated list entries become validity intervals, and an as-of join evaluates every capture against the entries active at its fetch time, in SQL functions alone.

A list is a table of events (entry_id, key, action, listed, dated): from its date an entry is listed or, where listed is
false, no longer. A key is a domain, which covers its subdomains, or a host with leading path segments. A capture is looked
up under all keys that may cover it. Both sides meet on (key, period), where a period is PERIOD days and an interval stands in
each period that it touches and that holds captures; so neither the captures of a hot host nor the history of a hot key are
compared as a whole, an odd date far away costs one period, and what is left of a hot (key, period) can be split freely, as
it is an ordinary equi-join.

Hosts and keys are compared in one form: lower case, without dots at the end. A host in brackets or of four numbers is an address and has
no parent domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameweave.llm.columns import repeated
from nameweave.scratch import Table

PERIOD = 30
#: Scheme and user info before the host, which may be an address in brackets; host; path up to query or fragment. As in browsers, a backslash there is a slash.
_URL = r"^\x20*[a-z][a-z0-9+.-]*:[/\\]{2}(?:[^/\\?#@]*@)?(\[[^\]/\\?#]*\]|[^/\\?#:@\[\]]+)(?::[0-9]*)?([/\\][^?#]*)?"
_ADDRESS = r"^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def host(url: Column) -> Column:
    """The lower-cased host without dots at its end, empty where the URL has none."""
    return F.rtrim(F.coalesce(F.regexp_extract(F.lower(url), _URL, 1), F.lit("")), F.lit("."))


def _filled(path: Column) -> Column:
    return F.array_remove(F.split(F.translate(path, "\\", "/"), "/"), "")


def segments(url: Column) -> Column:
    """The path's segments that aren't empty, lower-cased."""
    return _filled(F.coalesce(F.regexp_extract(F.lower(url), _URL, 2), F.lit("")))


def list_key(key: Column) -> Column:
    """A list's key in the form of hosts and segments; null without a host."""
    parts = F.split(F.lower(key), "/")
    h = F.rtrim(F.get(parts, F.lit(0)), F.lit("."))
    return F.when(h != "", F.concat_ws("/", F.array(h), F.array_remove(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "")))


def covering_keys(url: Column, labels_most: int | None = None, segments_most: int | None = None) -> Column:
    """The host, its parent domains of two labels or more unless it is an address, and the host with each run of leading path segments.

    Only parents of at most `labels_most` labels and runs of at most `segments_most` segments are made, if these are given.
    """
    h, path = host(url), segments(url)
    labels = F.split(h, "\\.")
    n = F.size(labels)
    first = F.lit(2) if labels_most is None else F.greatest(n - labels_most + 1, F.lit(2))
    parents = F.when(F.regexp_like(h, F.lit(_ADDRESS)) | (first > n - 1), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(first, n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    runs = F.size(path) if segments_most is None else F.least(F.size(path), F.lit(segments_most))
    paths = F.when(runs < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), runs), lambda i: F.concat_ws("/", h, F.array_join(F.slice(path, 1, i), "/"))))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(h), parents, paths)))


def intervals(events: DataFrame) -> DataFrame:
    """(entry_id, key, action, valid_from, valid_to): when each entry holds; valid_to is excluded, and null while it still does.

    Of an entry's events on one day the last by (listed, action) counts. Events without key, entry_id or date are none.
    """
    events = events.select("entry_id", list_key(F.col("key")).alias("key"), "action", "listed", "dated")
    events = events.where("key is not null and entry_id is not null and dated is not null")
    day = events.groupBy("entry_id", "key", "dated").agg(F.max(F.struct("listed", "action")).alias("e"))
    ahead = Window.partitionBy("entry_id", "key").orderBy("dated")
    return day.select("entry_id", "key", F.col("e.action").alias("action"), F.col("e.listed").alias("listed"), F.col("dated").alias("valid_from"), F.lead("dated").over(ahead).alias("valid_to")).where("listed").drop("listed")


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD).cast("int")


def verdicts(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each row of captures (page_id, url, fetched): with host, n_active, entry_key, action, valid_from, blocked.

    Of the active entries the one with the longest key decides; between equal keys the one listed last, then the larger
    entry_id. Captures without a date, host or active entry aren't blocked. Equal rows are evaluated once and returned as often as they
    were there. Long URLs are taken whole: a key costs a URL no more
    than its own leading part, and none is made that is longer than the list's. Other columns of either table aren't read, and an empty table gives no rows or no entries.
    """
    rows = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n"))
    # no URL is looked up under more labels or segments than any key has: two numbers about the list, whatever its size
    held = Table(intervals(events), "intervals").df
    parts = F.size(F.split("key", "/"))
    most = held.agg(F.coalesce(F.max(F.size(F.split(F.substring_index("key", "/", 1), "\\."))), F.lit(0)).alias("labels"), F.coalesce(F.max(parts) - 1, F.lit(0)).alias("segments")).head()
    looked = rows.select("*", F.explode_outer(covering_keys(F.col("url"), most.labels, most.segments)).alias("key")).withColumn("period", _period(F.col("fetched")))
    # there are no more of these than periods in the calendar
    periods = captures.where("fetched is not null").agg(F.sort_array(F.collect_set(_period(F.col("fetched")))).alias("periods"))
    held = held.join(F.broadcast(periods))
    until = F.when(F.col("valid_to").isNotNull(), _period(F.date_sub("valid_to", 1)))
    inside = F.filter("periods", lambda p: (p >= _period(F.col("valid_from"))) & (until.isNull() | (p <= until)))
    held = held.select(F.col("key").alias("k"), "entry_id", "action", "valid_from", "valid_to", F.explode(inside).alias("p"))
    active = (F.col("key") == F.col("k")) & (F.col("period") == F.col("p")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    met = looked.join(held, active, "left")
    best = F.max(F.when(F.col("entry_id").isNotNull(), F.struct(F.length("k").alias("length"), "valid_from", "entry_id", "action", "k")))
    out = met.groupBy("page_id", "url", "fetched", "n").agg(F.count("entry_id").alias("n_active"), best.alias("b"))
    out = repeated(out, "n")
    return out.select("page_id", host(F.col("url")).alias("host"), "fetched", "n_active", F.col("b.k").alias("entry_key"), F.col("b.action").alias("action"), F.col("b.valid_from").alias("valid_from"), F.coalesce(F.col("b.action") == "block", F.lit(False)).alias("blocked"))


# The test tables hold neither fetch times nor a dated list. Both are made from rules that SQL can repeat: a page is fetched
# on a day of 2024 by its page_id, and each host and each host's first path segment is on the list at times by the MD5 of its name.


def _number(key: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), at, 4), 16, 10).cast("long")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched)."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Events of a list: of ten names three are blocked for a time, two of these again later, and one is allowed for good."""
    h, path = host(F.col("url")), segments(F.col("url"))
    hosts = pages.select(h.alias("h"), F.get(path, F.lit(0)).alias("s")).where("h <> ''").distinct()
    keys = hosts.select("h").union(hosts.where("s is not null").select(F.concat_ws("/", "h", "s"))).distinct().toDF("key")
    k = keys.select("key", (_number(F.col("key"), 1) % 10).alias("kind"), (_number(F.col("key"), 5) % 300).alias("day"), (_number(F.col("key"), 9) % 90 + 10).alias("held"))
    event = lambda listed, day, action: F.struct(F.lit(listed).alias("listed"), F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("dated"), F.lit(action).alias("action"))
    day, held = F.col("day"), F.col("held")
    once = F.array(event(True, day, "block"), event(False, day + held, "block"))
    again = F.concat(once, F.array(event(True, day + held + 20, "block")))
    plan = F.when(F.col("kind") == 0, once).when(F.col("kind").isin(1, 2), again).when(F.col("kind") == 3, F.array(event(True, day, "allow")))
    return k.select("key", F.explode(plan).alias("e")).select(F.md5(F.col("key").cast("binary")).alias("entry_id"), "key", "e.action", "e.listed", "e.dated")


ORACLE = r"""
WITH u AS (SELECT page_id, url, lower(url) AS l, '^\x20*[a-z][a-z0-9+.-]*:[/\\]{2}(?:[^/\\?#@]*@)?(\[[^\]/\\?#]*\]|[^/\\?#:@\[\]]+)(?::[0-9]*)?([/\\][^?#]*)?' AS re FROM pages),
p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched, rtrim(regexp_extract(l, re, 1), '.') AS host,
    list_filter(string_split(translate(regexp_extract(l, re, 2), '\', '/'), '/'), lambda x: x <> '') AS path
  FROM u),
names AS (
  SELECT DISTINCT host AS key FROM p WHERE host <> ''
  UNION SELECT DISTINCT host || '/' || path[1] FROM p WHERE host <> '' AND len(path) > 0),
k AS (
  SELECT key, md5(key) AS entry_id, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) % 10 AS kind,
    CAST('0x' || substr(md5(key), 5, 4) AS INTEGER) % 300 AS day, CAST('0x' || substr(md5(key), 9, 4) AS INTEGER) % 90 + 10 AS held FROM names),
held AS (
  SELECT entry_id, key, 'block' AS action, DATE '2024-01-01' + day AS valid_from, DATE '2024-01-01' + day + held AS valid_to FROM k WHERE kind IN (0, 1, 2)
  UNION ALL SELECT entry_id, key, 'block', DATE '2024-01-01' + day + held + 20, NULL FROM k WHERE kind IN (1, 2)
  UNION ALL SELECT entry_id, key, 'allow', DATE '2024-01-01' + day, NULL FROM k WHERE kind = 3),
labels AS (SELECT page_id, host, path, string_split(host, '.') AS l, regexp_matches(host, '^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$') AS address FROM p WHERE host <> ''),
keys AS (
  SELECT page_id, unnest(list_transform(range(1, CASE WHEN address THEN 1 ELSE greatest(len(l) - 1, 1) END + 1), lambda i: CASE WHEN i = 1 THEN host ELSE array_to_string(l[i:], '.') END)) AS key FROM labels
  UNION ALL SELECT page_id, unnest(list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/'))) FROM labels),
met AS (
  SELECT p.page_id, h.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(h.key) DESC, h.valid_from DESC, h.entry_id DESC) AS r, count(*) OVER (PARTITION BY p.page_id) AS n
  FROM p JOIN keys ON keys.page_id = p.page_id JOIN held h ON h.key = keys.key AND p.fetched >= h.valid_from AND (h.valid_to IS NULL OR p.fetched < h.valid_to))
SELECT p.page_id, p.host, p.fetched, coalesce(m.n, 0) AS n_active, m.key AS entry_key, m.action, m.valid_from, coalesce(m.action = 'block', false) AS blocked
FROM p LEFT JOIN met m ON m.page_id = p.page_id AND m.r = 1
"""
