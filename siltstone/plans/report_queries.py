"""Queries over joins of several tables, reports and search policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import requests as R
from siltstone.operators import search as S
from siltstone.plans.registry import Registry
from siltstone.tables import latest, table

query = Registry()


def assets(spark, d, *columns):
    return latest(table(spark, d, "source_assets").select("id", *columns, "updated_at"), "id", "updated_at")


@query(
    """WITH m AS (SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)) AS top FROM orders GROUP BY 1)
SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN m ON m.o_custkey = o.o_custkey AND m.top.k = o.o_orderkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate WHERE o.o_orderstatus <> 'P'"""
)
def current_revision_join(spark, d):
    """Only the current revision of each source, joined on a composite condition."""
    orders = table(spark, d, "orders")
    current = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))
    kept = orders.join(current, ["o_custkey", "o_orderkey"]).where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return kept.join(lines, "o_orderkey").where("l_shipdate >= o_orderdate").select("o_orderkey", "l_linenumber")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON r_regionkey = n_regionkey")
def left_join_chain(spark, d):
    even = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return table(spark, d, "customer").join(S.small(even), "c_nationkey", "left").join(S.small(table(spark, d, "region")), "r_regionkey", "left").select("c_custkey", "n_name", "r_name")


@query("SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'click' AND d.user_id = e.user_id AND d.ts >= e.ts - INTERVAL '1 hour' AND d.ts <= e.ts)")
def cross_source_anti(spark, d):
    """Rows without a partner of another source in the hour before: an interval anti-join through hour buckets."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = 3_600_000_000
    views = e.where("event_type = 'view'").select("event_id", "user_id", "us", F.explode(F.array(F.floor(F.col("us") / hour), F.floor(F.col("us") / hour) - 1)).alias("h"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("us").alias("cu"), F.floor(F.col("us") / hour).alias("h"))
    met = views.join(clicks, ["user_id", "h"]).where((F.col("cu") >= F.col("us") - hour) & (F.col("cu") <= F.col("us"))).select("event_id").distinct()
    return e.where("event_type = 'view'").select("event_id").join(met, "event_id", "left_anti")


@query(
    """WITH a AS (SELECT id, arg_max(root_id, updated_at) AS root_id, arg_max(file_kind, updated_at) AS fk FROM source_assets GROUP BY id), s AS (SELECT DISTINCT id, source_asset_id, parser_status FROM code_symbols)
SELECT m.name AS root, coalesce(x.assets, 0) AS assets, coalesce(y.symbols, 0) AS symbols, coalesce(y.fallback, 0) AS fallback FROM monitored_roots m
LEFT JOIN (SELECT root_id, count(*) AS assets FROM a WHERE fk = 'code' GROUP BY 1) x ON x.root_id = m.id
LEFT JOIN (SELECT root_id, count(*) AS symbols, count(*) FILTER (WHERE parser_status LIKE 'fallback%') AS fallback FROM s JOIN a ON a.id = s.source_asset_id GROUP BY 1) y ON y.root_id = m.id"""
)
def code_index_status(spark, d):
    """Code assets and symbols per root, each branch counted before it is joined."""
    a = assets(spark, d, "root_id", "file_kind")
    files = a.where("file_kind = 'code'").groupBy("root_id").agg(F.count(F.lit(1)).alias("assets"))
    s = table(spark, d, "code_symbols").select("id", F.col("source_asset_id").alias("aid"), "parser_status").distinct()
    symbols = s.join(a.select(F.col("id").alias("aid"), "root_id"), "aid").groupBy("root_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("parser_status").startswith("fallback")).alias("fallback"))
    roots = table(spark, d, "monitored_roots").select(F.col("id").alias("root_id"), F.col("name").alias("root"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return roots.join(files, "root_id", "left").join(symbols, "root_id", "left").select("root", zero("assets"), zero("symbols"), zero("fallback"))


@query(
    """SELECT event_type AS lane, count(*) AS tasks, count(*) FILTER (WHERE value < 20) AS ready, count(*) FILTER (WHERE value BETWEEN 20 AND 60) AS active, min(date_diff('second', ts, TIMESTAMP '2024-02-01')) AS heartbeat_age FROM events WHERE user_id % 5 <> 0 GROUP BY 1"""
)
def lane_counts(spark, d):
    now = F.unix_seconds(F.expr("timestamp_ntz'2024-02-01 00:00:00'").cast("timestamp"))
    v = F.col("value")
    open_ = table(spark, d, "events").where("user_id % 5 <> 0")
    # whole seconds are counted as boundaries crossed, so both times are cut to the second first
    return open_.groupBy(F.col("event_type").alias("lane")).agg(F.count(F.lit(1)).alias("tasks"), F.count_if(v < 20).alias("ready"), F.count_if(v.between(20, 60)).alias("active"), F.min(now - F.unix_seconds(F.col("ts").cast("timestamp"))).alias("heartbeat_age"))


@query(
    """SELECT extraction_status AS state, count(*) AS assets, count(*) FILTER (WHERE chunks > 0) AS indexed FROM (SELECT a.id, a.extraction_status, coalesce(c.n, 0) AS chunks FROM (SELECT id, arg_max(extraction_status, updated_at) AS extraction_status FROM source_assets GROUP BY id) a
LEFT JOIN (SELECT asset_id, count(DISTINCT id) AS n FROM asset_chunks GROUP BY 1) c ON c.asset_id = a.id) GROUP BY 1"""
)
def overview_rollup(spark, d):
    """Assets per state and how many of them have chunks: two levels of aggregates."""
    chunks = table(spark, d, "asset_chunks").select(F.col("asset_id").alias("id"), F.col("id").alias("chunk")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return assets(spark, d, "extraction_status").join(chunks, "id", "left").groupBy(F.col("extraction_status").alias("state")).agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("indexed"))


@query("SELECT id, title FROM (SELECT id, arg_max(title, updated_at) AS title, arg_max(summary, updated_at) AS summary FROM episodes GROUP BY id) WHERE title ILIKE '%queue%' OR summary ILIKE '%quarantined%' ORDER BY id LIMIT 200")
def claim_list(spark, d):
    """Case-insensitive search over several columns; a list report of at most 200 rows."""
    e = latest(table(spark, d, "episodes").select("id", "title", "summary", "updated_at"), "id", "updated_at")
    return e.where(F.col("title").ilike("%queue%") | F.col("summary").ilike("%quarantined%")).orderBy("id").limit(200).select("id", "title")


@query("SELECT event_id, split_part(event_type, 'c', 1) AS family, coalesce(json_extract_string(props, '$.severity'), 'information') AS severity FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 4000) ORDER BY ts DESC, event_id DESC LIMIT 26")
def event_page(spark, d):
    """A page of events below a cursor, with the family and a default severity."""
    cursor = F.struct(F.expr("timestamp_ntz'2024-01-20 00:00:00'").alias("ts"), F.lit(4000).cast("long").alias("event_id"))
    rows = table(spark, d, "events").where(F.struct("ts", "event_id") < cursor).orderBy(F.desc("ts"), F.desc("event_id")).limit(26)
    return rows.select("event_id", F.split_part("event_type", F.lit("c"), F.lit(1)).alias("family"), F.coalesce(F.get_json_object("props", "$.severity"), F.lit("information")).alias("severity"))


@query(
    """WITH d AS (SELECT doc_id, source, kind, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents)
SELECT source, bool_and(coalesce(kind, '') = 'code_doc') AS rerun FROM d WHERE k <= 5 GROUP BY 1"""
)
def all_code_rerun(spark, d):
    """Whether the first five results of each source are all code, so that the search runs again without it."""
    order = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), F.asc("doc_id"))
    best = table(spark, d, "documents").select("doc_id", "source", "kind", "n_chars").withColumn("k", F.row_number().over(order)).where("k <= 5")
    return best.groupBy("source").agg(F.bool_and(F.coalesce("kind", F.lit("")) == "code_doc").alias("rerun"))


@query("SELECT doc_id FROM documents WHERE (source = 'agent-sessions' AND contains(lower(coalesce(text, '')), 'quarantined')) OR (NOT EXISTS (SELECT 1 FROM documents WHERE source = 'agent-sessions' AND contains(lower(coalesce(text, '')), 'quarantined')) AND contains(lower(coalesce(text, '')), 'quarantined'))")
def local_first_fallback(spark, d):
    """Local results if there are any, else those of all scopes: decided once on the driver, then one plan."""
    hits = table(spark, d, "documents").where(F.lower("text").contains("quarantined")).select("doc_id", "source")
    local = hits.where("source = 'agent-sessions'")
    return (hits if local.isEmpty() else local).select("doc_id")


@query("SELECT doc_id, regexp_replace(substring(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '^[#\\s]+', ''), '\\s+$', ''), 1, 80), '\\s+$', '') AS title FROM documents WHERE source = 'agent-sessions' AND text IS NOT NULL AND length(regexp_replace(text, '\\s', '', 'g')) > 0")
def session_titles(spark, d):
    """Titles inferred from the first line of session files."""
    first = F.regexp_replace(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"(?U)^[#\s]+", ""), r"(?U)\s+$", "")
    rows = table(spark, d, "documents").where("source = 'agent-sessions' and text is not null").where(F.length(X.strip("text")) > 0)
    return rows.select("doc_id", F.regexp_replace(F.substring(first, 1, 80), r"(?U)\s+$", "").alias("title"))


@query("SELECT id FROM (SELECT id, arg_max(file_kind, updated_at) AS k FROM source_assets GROUP BY id) WHERE k <> 'code' OR k IS NULL")
def implicit_code_exclusion(spark, d):
    wanted = R.request({"query": "watcher queue"})
    return assets(spark, d, "file_kind").where(R.predicate(wanted)).select("id")


@query("SELECT id, round(0.5 + CASE WHEN symbol_kind IN ('class', 'function') AND exported THEN 0.1 WHEN symbol_kind = 'method' THEN 0.025 ELSE 0 END, 6)::DOUBLE AS score FROM (SELECT DISTINCT id, symbol_kind, exported FROM code_symbols)")
def code_rank_adjustment(spark, d):
    """Definitions that are exported rank a little higher, methods a touch."""
    s = table(spark, d, "code_symbols").select("id", "symbol_kind", "exported").distinct()
    bonus = F.when(F.col("symbol_kind").isin("class", "function") & F.col("exported"), 0.1).when(F.col("symbol_kind") == "method", 0.025).otherwise(0.0)
    return s.select("id", F.round(bonus + 0.5, 6).alias("score"))


QUERIES, SQL = query.queries, query.sql
