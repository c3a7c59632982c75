"""Queries over aggregates, windows, sorting, pages and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.scores import status_group
from siltstone.operators import measures as M
from siltstone.plans.registry import Registry
from siltstone.tables import latest, table

query = Registry()


def events(spark, d):
    return table(spark, d, "events")


def calls(spark, d, *columns):
    """Some columns of the model activity, each event once: as it started last, ties by the greatest values."""
    return latest(table(spark, d, "model_activity_events").select("id", *columns, "started_at"), "id", "started_at")


_CALLS = "calls AS (SELECT DISTINCT ON (id) * FROM model_activity_events ORDER BY id)"


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low FROM events GROUP BY event_type")
def conditional_counts(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"))


@query("SELECT event_type, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def percentile_stats(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").cast("double").alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_counter_sums(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT event_type, event_id, value, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS position FROM events) WHERE position <= 10")
def top_n_per_group(spark, d):
    return M.top_rows(events(spark, d), ["event_type"], [F.desc("value"), F.asc("event_id")], 10).select("event_type", "event_id", "value", "position")


@query(f"WITH {_CALLS} SELECT lower(trim(service)) AS service, count(*) AS n, count(*) FILTER (WHERE status = 'running') AS active, count(*) FILTER (WHERE status = 'failed') AS failures FROM calls GROUP BY 1")
def breakdown_service(spark, d):
    return calls(spark, d, "service", "status").groupBy(F.lower(F.trim("service")).alias("service")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "running").alias("active"), F.count_if(F.col("status") == "failed").alias("failures"))


@query(f"WITH {_CALLS} SELECT activity_class, count(*) AS n, count(DISTINCT lower(trim(service))) AS services FROM calls WHERE activity_class NOT IN ('health', 'control_plane') GROUP BY 1")
def breakdown_class(spark, d):
    """Without control-plane traffic."""
    shown = calls(spark, d, "service", "activity_class").where(~F.col("activity_class").isin("health", "control_plane"))
    return shown.groupBy("activity_class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim("service"))).alias("services"))


@query(
    f"""WITH {_CALLS} SELECT CASE WHEN status LIKE 'blocked%' THEN 'blocked' WHEN status IN ('failed', 'error', 'dead_letter') THEN 'failed' WHEN status IN ('running', 'busy', 'claimed') THEN 'running'
WHEN status IN ('pending', 'queued') OR status LIKE 'retrying%' THEN 'pending' ELSE 'completed' END AS status_group, count(*) AS n FROM calls GROUP BY 1"""
)
def status_groups(spark, d):
    return calls(spark, d, "status").groupBy(status_group(F.col("status")).alias("status_group")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_CALLS}
SELECT 'status' AS facet, status AS value, count(*) AS n FROM calls WHERE activity_class IN ('retrieval', 'sidecar') AND endpoint IS NOT NULL GROUP BY 2
UNION ALL SELECT 'activity_class', activity_class, count(*) FROM calls WHERE status IN ('failed', 'busy') GROUP BY 2"""
)
def facets(spark, d):
    rows = calls(spark, d, "status", "activity_class")
    return M.facets(rows, {"status": ["failed", "busy"], "activity_class": ["retrieval", "sidecar"]})


@query(
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority) AS gp, grouping(o_orderstatus) AS gs FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())"""
)
def grouping_set_counters(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("siltstone_orders")
    return spark.sql(
        "SELECT o_orderpriority, o_orderstatus, count(*) AS n, cast(grouping(o_orderpriority) AS bigint) AS gp, cast(grouping(o_orderstatus) AS bigint) AS gs FROM siltstone_orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())"
    )


@query(
    """WITH a AS (SELECT id, arg_max(replace(path, chr(92), '/'), updated_at) AS p, arg_max(extraction_status, updated_at) AS s FROM source_assets GROUP BY id)
SELECT split_part(p, '/', 1) AS folder, count(*) AS n, count(*) FILTER (WHERE s = 'indexed') AS current, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s LIKE 'blocked%') AS blocked FROM a GROUP BY 1"""
)
def folder_rollup(spark, d):
    a = latest(table(spark, d, "source_assets").select("id", "path", "extraction_status", "updated_at"), "id", "updated_at")
    s = F.col("extraction_status")
    return a.groupBy(F.split_part(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "indexed").alias("current"), F.count_if(s == "failed").alias("failed"), F.count_if(s.startswith("blocked")).alias("blocked")
    )


@query("SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (WHERE any_open) AS with_open FROM (SELECT c_custkey, c_mktsegment, coalesce(bool_or(o_orderstatus = 'O'), false) AS any_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1")
def any_state_rollup(spark, d):
    """Two levels: whether any child is in a state, then how many parents have one."""
    child = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"))
    joined = table(spark, d, "customer").join(child, "c_custkey", "left")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.coalesce("any_open", F.lit(False))).alias("with_open"))


@query(
    """SELECT n_nationkey, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"""
)
def per_branch_counts(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey")
    return M.branch_counts(nations, "n_nationkey", {"customers": (table(spark, d, "customer"), "c_nationkey"), "suppliers": (table(spark, d, "supplier"), "s_nationkey")})


@query("SELECT strftime(time_bucket(INTERVAL '60 minutes', ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_activity(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "60 minutes")
    return events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n", "total")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, min(value) AS low, max(value) AS high, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id")
def feedback_summary(spark, d):
    rows = events(spark, d).where("event_type = 'error'")
    return rows.groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 6) AS value_delta FROM events")
def metric_deltas(spark, d):
    rows = M.with_previous(events(spark, d), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")], ["value"])
    return rows.select("event_id", F.round("value_delta", 6).alias("value_delta"))


@query(
    """WITH r AS (SELECT event_id, user_id, event_type, ts, 1000.0::DOUBLE / value AS v FROM events WHERE value > 0), p AS (SELECT event_id, v, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM r)
SELECT event_id, round(v, 6) AS per_second, round(before, 6) AS previous, round(v - before, 6) AS delta FROM p"""
)
def throughput_prev(spark, d):
    """Throughput of each run beside that of the run before of the same group."""
    runs = events(spark, d).where("value > 0").select("event_id", "user_id", "event_type", "ts", (F.lit(1000.0) / F.col("value")).alias("v"))
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    told = runs.select("event_id", "v", F.lag("v").over(order).alias("before"))
    return told.select("event_id", F.round("v", 6).alias("per_second"), F.round("before", 6).alias("previous"), F.round(F.col("v") - F.col("before"), 6).alias("delta"))


@query(
    f"""WITH {_CALLS} SELECT status AS state, coalesce(nullif(trim(error_class), ''), 'unspecified') AS reason, count(*) AS n FROM calls WHERE status NOT IN ('completed', 'running') GROUP BY 1, 2 ORDER BY n DESC, state, reason LIMIT 20"""
)
def reason_top20(spark, d):
    rows = calls(spark, d, "status", "error_class").where(~F.col("status").isin("completed", "running"))
    return rows.groupBy(F.col("status").alias("state"), F.coalesce(F.nullif(F.trim("error_class"), F.lit("")), F.lit("unspecified")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "state", "reason").limit(20)


@query("SELECT c_custkey, o.o_orderkey AS latest FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def latest_per_root(spark, d):
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return table(spark, d, "customer").select("c_custkey").join(best, "c_custkey", "left")


@query(
    "SELECT event_id, prior FROM (SELECT e.event_id, lag(e.event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior FROM events e)"
)
def lateral_top1(spark, d):
    """The last earlier event of the same user and type: an as-of join on one table is a lag."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return events(spark, d).select("event_id", F.lag("event_id").over(order).alias("prior"))


@query(
    """SELECT e.event_id, arg_max(p.event_id, struct_pack(t := p.ts, i := p.event_id)) AS before FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'signup' AND p.ts < e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id"""
)
def asof_previous_signup(spark, d):
    """As-of join of two streams: one union, sorted per key, and the last value carried forward."""
    rows = events(spark, d).where("event_type in ('purchase', 'signup')")
    side = F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))
    # equal times do not count as earlier, so the frame ends before the peers of the row
    micros = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("side", side)
    before = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    return micros.select("event_id", "event_type", F.max("side").over(before)["event_id"].alias("before")).where("event_type = 'purchase'").select("event_id", "before")


_SWEEP = """
WITH p AS (SELECT a.vec_id % 50 = b.vec_id % 50 AS dup, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
t AS (SELECT CAST(unnest([0.82, 0.86, 0.90]) AS DOUBLE) AS threshold),
w AS (SELECT threshold, count(*) FILTER (WHERE s >= threshold AND NOT dup) AS false_positives, count(*) FILTER (WHERE s < threshold AND dup) AS false_negatives, count(*) FILTER (WHERE (s >= threshold) = dup) AS passes FROM p, t GROUP BY 1)
"""


THRESHOLDS = (0.82, 0.86, 0.90)


def _swept(spark, d):
    """Pairs close enough for any threshold come from the tiled join; how many there are in all follows from the sizes of the groups."""
    from siltstone.functions.vectors import norm
    from siltstone.operators.similarity import cosine_pairs

    v = table(spark, d, "embeddings")
    dup = F.col("a") % 50 == F.col("b") % 50
    close = cosine_pairs(v, min(THRESHOLDS)).select(dup.alias("dup"), F.col("similarity").alias("s"))
    two = lambda c: F.sum(c * (c - 1) / 2).cast("long")
    groups = v.where(norm("embedding") > 0).groupBy("label", (F.col("vec_id") % 50).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    same = groups.agg(two(F.col("n"))).first()[0] or 0
    every = groups.groupBy("label").agg(F.sum("n").alias("n")).agg(two(F.col("n"))).first()[0] or 0
    return M.sweep_from(close, "s", "dup", (same, every - same), THRESHOLDS)


@query(_SWEEP + "SELECT * FROM w")
def threshold_sweep(spark, d):
    return _swept(spark, d)


@query(_SWEEP + "SELECT threshold FROM w ORDER BY false_positives + false_negatives, passes DESC, abs(threshold - 0.86) LIMIT 1")
def threshold_argmin(spark, d):
    return _swept(spark, d).orderBy(F.col("false_positives") + F.col("false_negatives"), F.desc("passes"), F.abs(F.col("threshold") - 0.86)).limit(1).select("threshold")


@query(
    """SELECT root, CASE WHEN NOT enabled THEN 'blocked' WHEN failed > 0 OR blocked > 0 THEN 'partial' WHEN pending > 0 THEN 'partial' WHEN n > 0 THEN 'ready' ELSE 'not_run' END AS readiness FROM (
SELECT m.name AS root, m.enabled, count(a.id) AS n, count(*) FILTER (WHERE a.s = 'failed') AS failed, count(*) FILTER (WHERE a.s LIKE 'blocked%') AS blocked, count(*) FILTER (WHERE a.s = 'pending') AS pending
FROM monitored_roots m LEFT JOIN (SELECT id, arg_max(root_id, updated_at) AS root_id, arg_max(extraction_status, updated_at) AS s FROM source_assets GROUP BY id) a ON a.root_id = m.id GROUP BY ALL)"""
)
def root_readiness(spark, d):
    a = latest(table(spark, d, "source_assets").select("id", "root_id", "extraction_status", "updated_at"), "id", "updated_at")
    s = F.col("extraction_status")
    counted = a.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "failed").alias("failed"), F.count_if(s.startswith("blocked")).alias("blocked"), F.count_if(s == "pending").alias("pending"))
    roots = table(spark, d, "monitored_roots").select(F.col("id").alias("root_id"), F.col("name").alias("root"), "enabled")
    c = lambda x: F.coalesce(x, F.lit(0))
    state = F.when(~F.col("enabled"), "blocked").when((c("failed") + c("blocked") + c("pending")) > 0, "partial").when(c("n") > 0, "ready").otherwise("not_run")
    return roots.join(counted, "root_id", "left").select("root", state.alias("readiness"))


# ------------------------------------------------------------------ order and pages


@query("SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 100")
def sort_tiebreak(spark, d):
    return events(spark, d).orderBy(F.desc("value"), "event_id").limit(100).select("event_id")


@query("SELECT event_id, n FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100), (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) AS n FROM events)")
def offset_page(spark, d):
    pages = events(spark, d).agg(F.ceil(F.count(F.lit(1)) / 50).cast("long").alias("n"))
    page = events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50).select("event_id")
    return page.join(F.broadcast(pages))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND (ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 5000)) ORDER BY ts DESC, event_id DESC LIMIT 51")
def keyset_page(spark, d):
    """One page and one row more, below a cursor of time and id."""
    cursor = F.struct(F.expr("timestamp_ntz'2024-01-15 00:00:00'").alias("ts"), F.lit(5000).cast("long").alias("event_id"))
    rows = events(spark, d).where("event_type = 'error'").where(F.struct("ts", "event_id") < cursor)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(51).select("event_id")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, sum(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) - s_acctbal AS before FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 10 <> 0) WHERE before < 20000")
def lru_eviction(spark, d):
    """Candidates in order until the deficit is covered, by a prefix sum over range partitions."""
    idle = table(spark, d, "supplier").where("s_acctbal > 0 and s_suppkey % 10 <> 0").select("s_suppkey", "s_acctbal")
    return M.running_total(idle, ["s_acctbal", "s_suppkey"], "s_acctbal").where("before < 20000").select("s_suppkey")


# ------------------------------------------------------------------ sets and joins


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'event', event_id FROM events WHERE event_type = 'error'")
def union_sources(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return a.unionByName(events(spark, d).where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_unseen(spark, d):
    """Parts that no large order line names."""
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersect_streams(spark, d):
    e = events(spark, d)
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT DISTINCT id FROM asset_chunks c WHERE NOT EXISTS (SELECT 1 FROM code_symbols s WHERE s.asset_chunk_id = c.id)")
def anti_missing_index(spark, d):
    chunks = table(spark, d, "asset_chunks").select("id").distinct()
    return chunks.join(table(spark, d, "code_symbols").select(F.col("asset_chunk_id").alias("id")), "id", "left_anti")


@query("SELECT DISTINCT id, qualified_name FROM code_symbols s WHERE EXISTS (SELECT 1 FROM asset_chunks c WHERE c.id = s.asset_chunk_id AND c.asset_id = s.source_asset_id)")
def semi_references(spark, d):
    """Symbols whose chunk exists in the asset they name."""
    s = table(spark, d, "code_symbols").select("id", "qualified_name", "asset_chunk_id", F.col("source_asset_id").alias("asset_id"))
    chunks = table(spark, d, "asset_chunks").select(F.col("id").alias("asset_chunk_id"), "asset_id")
    return s.join(chunks, ["asset_chunk_id", "asset_id"], "left_semi").select("id", "qualified_name").distinct()


QUERIES, SQL = query.queries, query.sql
