"""Not-modified revisits of a web archive: an as-of join by canonical URL to the latest earlier full response.

The join is a running last value over records sorted by (URL, time). Spark range-partitions them by URL, time and id, so that
a URL with a third of all records spreads over many ranges; inside a range the last response is a window of that range's part
of the URL, and what earlier ranges hand on is one row a range and URL. A revisit takes the response only if its
validators agree, and of its headers only those that a not-modified answer may update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize

# Headers that a 304 answer updates in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that say where a visitor came from, not what page is meant.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
HOST = r"^(?:[^@]*@)?(?:www\.)?"
# Ports that a scheme means anyway; without a scheme either may.
PORTS = {"http": ":80$", "https": ":443$", "": ":(80|443)$"}


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, `www.` and its scheme's default port, path without closing slashes, sorted query without tracking;
    scheme and fragment are dropped. What is no URL with a host stays as it is; null stays null."""
    url = F.trim(url)
    named = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), HOST, "")
    scheme, host = F.lower(F.regexp_extract(url, SCHEME, 1)), named
    for name, port in PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(named, port, "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(url, URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(query), "&")
    return F.when(host == "", url).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _tag(headers: Column) -> Column:
    """Entity tags compare weakly."""
    return F.regexp_replace(headers["etag"], "^W/", "")


def lower_headers(headers: Column) -> Column:
    """A map of headers by lower-case name. Of names that differ in case only the one whose spelling comes last counts; null: empty."""
    none = F.create_map().cast("map<string,string>")
    sorted_ = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, none)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("spelt"), e["value"].alias("value"))))
    last = F.filter(sorted_, lambda e, i: ~F.coalesce(F.try_element_at(F.transform(sorted_, lambda x: x["key"]), i + 2) == e["key"], F.lit(False)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def resolve_revisits(records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", type_col: str = "type", headers_col: str = "headers", digest_col: str = "digest") -> DataFrame:
    """One row a record: id, canonical_url, response_id, outcome, headers (map), digest.

    Outcomes: `response` (a full one, itself); `resolved`; `changed` (validators disagree: entity tags, or last-modified where one
    side has no tag); `unchecked` (no validator on both sides, not resolved); `missing` (no earlier response, no URL or no time).
    Header names are compared in lower case (lower_headers). `earlier` is strictly so; of responses of one time the one of largest
    id counts, and of rows that repeat a response's URL, time and id the one whose digest and headers, as text, come last. Types other
    than response and revisit are left out; a record without headers has an empty map. Rows that repeat an id stay apart.
    """
    lower = lower_headers(F.col(headers_col))
    rows = records.where(F.col(type_col).isin("response", "revisit")).select(
        F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("url"), F.col(time_col).alias("ts"),
        (F.col(type_col) == "response").alias("full"), lower.alias("headers"), F.col(digest_col).alias("digest"),
    )
    ranged = materialize(rows.repartitionByRange("url", "ts", "id").withColumn("part", F.spark_partition_id()), "records")
    own = F.when(F.col("full") & F.col("url").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "id", "headers", "digest"))
    # Rows of one time see what is before that time: a range frame over the time, as a rank, ends one rank earlier.
    order = W.partitionBy("part", "url").orderBy(F.col("ts").asc_nulls_first())
    placed = ranged.withColumn("own", own).withColumn("time_rank", F.dense_rank().over(order))
    before = W.partitionBy("part", "url").orderBy("time_rank").rangeBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("here", F.max(F.struct(F.col("own.ts").alias("ts"), F.col("own.id").alias("id"))).over(before))
    # Responses by range and URL, two at most: the last one, and the last of an earlier time, for a time that ranges share.
    last = placed.where("own is not null").groupBy("url", "part").agg(F.max("ts").alias("top"), F.max(F.struct("ts", "id")).alias("last"))
    second = placed.join(last.select("url", "part", "top"), ["url", "part"]).where("own is not null and ts < top").groupBy("url", "part").agg(F.max(F.struct("ts", "id")).alias("prior"))
    sums = last.join(second, ["url", "part"], "left")
    parts = ranged.groupBy("url", "part").agg(F.min("ts").alias("first_ts")).where("url is not null").join(sums, ["url", "part"], "left")
    earlier = W.partitionBy("url").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # A time that closes an earlier range may open this one; then what counts for its rows is before that time. Of the responses of
    # earlier times the latest is the last of its range or, where that range closes with the shared time, the second.
    closing = sums.select("url", F.explode(F.array("last", "prior")).alias("at")).where("at is not null")
    openings = parts.select("url", F.col("first_ts").alias("ts"), "part", F.lit(None).cast(closing.schema["at"].dataType).alias("at"))
    events = openings.unionByName(closing.select("url", F.col("at.ts").alias("ts"), F.lit(None).cast("int").alias("part"), "at"))
    events = events.withColumn("time_rank", F.dense_rank().over(W.partitionBy("url").orderBy(F.col("ts").asc_nulls_first())))
    prior = events.withColumn("all_prior", F.max("at").over(W.partitionBy("url").orderBy("time_rank").rangeBetween(W.unboundedPreceding, -1))).where("part is not null")
    handed = parts.withColumn("last", F.max("last").over(earlier)).join(prior.select("url", "part", "all_prior"), ["url", "part"])
    handed = handed.select("url", "part", F.col("last").alias("handed_last"), F.col("all_prior").alias("handed_prior"))
    seen = local.where("not full").join(handed, ["url", "part"], "left")
    usable = lambda c: F.when(F.col(f"{c}.ts") < F.col("ts"), F.col(c))
    found = seen.withColumn("at", F.greatest(F.when(F.col("here.ts").isNotNull(), F.col("here")), usable("handed_last"), usable("handed_prior")))
    found = found.select("id", "url", "ts", "headers", "digest", "at")
    responses = ranged.where("full").select(F.col("url").alias("r_url"), F.col("ts").alias("r_ts"), F.col("id").alias("r_id"), F.col("headers").alias("r_headers"), F.col("digest").alias("r_digest"))
    said = F.to_json(F.struct(F.col("r_digest"), F.array_sort(F.map_entries("r_headers")).alias("h")))
    # Ids rarely repeat: the rows of one id are few, and of them one stays, whatever the order they come in.
    responses = responses.groupBy("r_url", "r_ts", "r_id").agg(F.max_by(F.struct("r_headers", "r_digest"), said).alias("r")).select("r_url", "r_ts", "r_id", "r.*")
    met = found.join(responses, (F.col("url") == F.col("r_url")) & (F.col("at.ts") == F.col("r_ts")) & (F.col("at.id") == F.col("r_id")), "left")
    same_tag = _tag(F.col("headers")) == _tag(F.col("r_headers"))
    same_time = F.col("headers")["last-modified"] == F.col("r_headers")["last-modified"]
    agrees = F.coalesce(same_tag, same_time)
    outcome = F.when(F.col("r_id").isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("changed")
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter("r_headers", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    met = met.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    revisits = met.select("id", "url", F.when(good, F.col("r_id")).alias("response_id"), "outcome", F.when(good, F.map_concat(kept, update)).otherwise(F.col("headers")).alias("headers"), F.when(good, F.col("r_digest")).alias("digest"))
    full = ranged.where("full").select("id", "url", F.col("id").alias("response_id"), F.lit("response").alias("outcome"), "headers", "digest")
    return full.unionByName(revisits).withColumnsRenamed({"id": id_col, "url": "canonical_url"})


def archive_of(pages: DataFrame) -> DataFrame:
    """A capture log from pages: each page as a full response and as a revisit half an hour later, by a URL that is spelt
    otherwise, with a validator that agrees, has changed or is missing, by page_id."""
    k = F.col("page_id")
    http_time = lambda ts: F.concat(F.lit("t"), ts.cast("string"))
    ts = k * 3600
    tag = F.md5("html")
    response = pages.select(
        (k * 2).alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("type"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), http_time(ts), F.lit("ETag"), tag, F.lit("Last-Modified"), http_time(ts - 60)).alias("headers"),
        tag.alias("digest"),
    )
    spelt = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?://", "HTTP://WWW."), F.when(F.col("url").contains("?"), "&utm_source=log").otherwise("?utm_source=log"), F.lit("#again"))
    changed = F.when(k % 7 == 0, F.concat(F.lit("x"), tag)).when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    modified = F.when(k % 35 == 10, F.lit(None)).otherwise(http_time(ts - 60))
    late = F.when(k % 11 == 0, ts - 1800).otherwise(ts + 1800)
    revisit = pages.select(
        (k * 2 + 1).alias("record_id"), spelt.alias("url"), late.alias("ts"), F.lit("revisit").alias("type"),
        F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("Date"), http_time(late), F.lit("ETag"), changed, F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.concat(F.lit("max-age="), (k % 100).cast("string"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)


def op1_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    """The capture log of all pages, every revisit resolved or told why not."""
    out = resolve_revisits(archive_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    shown = F.array_join(F.array_sort(F.transform(F.filter(F.map_entries("headers"), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "canonical_url", "response_id", "outcome", shown.alias("headers"), "digest")


def _oracle() -> str:
    def key(url: str) -> str:
        named = rf"regexp_replace(lower(regexp_extract({url}, '{URL}', 1)), '{HOST}', '')"
        cases = " ".join(f"WHEN '{name}' THEN regexp_replace({named}, '{port}', '')" for name, port in PORTS.items())
        host = f"CASE lower(regexp_extract({url}, '{SCHEME}', 1)) {cases} ELSE {named} END"
        path = rf"regexp_replace(regexp_extract({url}, '{URL}', 2), '/+$', '')"
        query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '{URL}', 3), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&')"
        return f"CASE WHEN {host} = '' THEN {url} ELSE {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"

    return rf"""
WITH base AS (SELECT page_id AS k, url, md5(html) AS tag, page_id * 3600 AS ts FROM pages),
responses AS (
  SELECT k * 2 AS id, {key("trim(url)")} AS url, ts, tag, 't' || (ts - 60) AS modified FROM base),
spelt AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', 'HTTP://WWW.') ||
         CASE WHEN contains(url, '?') THEN '&utm_source=log' ELSE '?utm_source=log' END || '#again' AS again FROM base),
revisits AS (
  SELECT k * 2 + 1 AS id, {key("trim(again)")} AS url,
         CASE WHEN k % 11 = 0 THEN ts - 1800 ELSE ts + 1800 END AS ts,
         CASE WHEN k % 7 = 0 THEN 'x' || tag WHEN k % 5 = 0 THEN NULL ELSE 'W/' || tag END AS etag,
         CASE WHEN k % 35 = 10 THEN NULL ELSE 't' || (ts - 60) END AS modified, k % 100 AS age FROM spelt),
ranked AS (
  SELECT v.*, r.id AS rid, r.tag, r.modified AS rmodified, r.ts AS rts,
         row_number() OVER (PARTITION BY v.id ORDER BY r.ts DESC NULLS LAST, r.id DESC) AS n
  FROM revisits v LEFT JOIN responses r ON v.url = r.url AND r.ts < v.ts),
judged AS (
  SELECT *, coalesce(regexp_replace(etag, '^W/', '') = tag, modified = rmodified) AS agrees FROM ranked WHERE n = 1)
SELECT id AS record_id, url AS canonical_url, id AS response_id, 'response' AS outcome,
       'content-type=text/html;date=t' || ts || ';etag=' || tag || ';last-modified=' || modified AS headers, tag AS digest FROM responses
UNION ALL
SELECT id, url, CASE WHEN agrees THEN rid END, CASE WHEN rid IS NULL THEN 'missing' WHEN agrees IS NULL THEN 'unchecked' WHEN agrees THEN 'resolved' ELSE 'changed' END,
       'cache-control=max-age=' || age || ';content-type=' || CASE WHEN agrees THEN 'text/html' ELSE 'text/plain' END || ';date=t' || ts ||
       CASE WHEN agrees THEN ';etag=' || coalesce(etag, tag) WHEN etag IS NULL THEN '' ELSE ';etag=' || etag END ||
       CASE WHEN agrees THEN ';last-modified=' || coalesce(modified, rmodified) WHEN modified IS NULL THEN '' ELSE ';last-modified=' || modified END,
       CASE WHEN agrees THEN tag END
FROM judged
"""


ORACLE = _oracle()
