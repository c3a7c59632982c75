"""Queries over search policies, filters, reports and schedules that shape what a search or an operator sees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import scores as SC
from siltstone.operators import queues as Q
from siltstone.operators import requests as R
from siltstone.operators import search as S
from siltstone.plans import search_queries as SQ
from siltstone.plans.measure_queries import _CALLS, calls, root_readiness
from siltstone.plans.registry import Registry
from siltstone.tables import latest, table

query = Registry()

# ------------------------------------------------------------------ search policies


@query(
    """WITH e AS (SELECT id, arg_max(coalesce(superseded_by, ''), updated_at) AS s, arg_max(coalesce(usage_count, 0), updated_at) AS u, arg_max(coalesce(confidence, 0), updated_at) AS c FROM episodes GROUP BY id),
r AS (SELECT id, list_filter([CASE WHEN s <> '' THEN 'non_current' END, CASE WHEN u = 0 THEN 'state:stale' END, CASE WHEN c < 0.3 THEN 'retention:deprioritize' END, CASE WHEN c < 1 THEN 'penalty:confidence' END, CASE WHEN u = 0 THEN 'penalty:usage' END], lambda x: x IS NOT NULL) AS reasons FROM e)
SELECT id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0"""
)
def deprioritisation(spark, d):
    """Why an episode stands lower than its text deserves: not current, its state, its retention, the factors below 1."""
    e = latest(table(spark, d, "episodes").select("id", "superseded_by", "usage_count", "confidence", "updated_at"), "id", "updated_at")
    used, sure = F.coalesce("usage_count", F.lit(0)), F.coalesce("confidence", F.lit(0.0))
    reasons = SC.deprioritised(
        F.col("superseded_by").isNull(), F.when(used == 0, "stale").otherwise("active"), F.when(sure < 0.3, "deprioritize").otherwise("keep"),
        {"confidence": sure, "usage": F.when(used == 0, 0.5).otherwise(1.0)},
    )
    return e.select("id", reasons.alias("r")).where("size(r) > 0").select("id", F.array_join("r", ",").alias("reasons"))


@query(
    SQ._BM25
    + """, k AS (SELECT r.query_id, r.doc_id, r.score, row_number() OVER (PARTITION BY query_id ORDER BY r.score DESC, r.doc_id) AS n FROM r JOIN documents d USING (doc_id) WHERE r.rank <= greatest(5 * 4, 20) AND starts_with(lower(d.lang), 'en'))
SELECT query_id, doc_id, CAST(n AS INTEGER) AS rank FROM k WHERE n <= 5"""
)
def over_fetch(spark, d):
    """Four times the page, at least twenty, are fetched, so that a page remains after the filter."""
    limit = 5
    fetched = S.top_k(SQ.bm25_scores(spark, d), max(limit * 4, 20)).drop("rank")
    kept = fetched.join(SQ.docs(spark, d).where(F.lower("lang").startswith("en")).select("doc_id"), "doc_id")
    return S.top_k(kept, limit).select("query_id", "doc_id", "rank")


@query("SELECT query_id, doc_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM (" + SQ.SQL["hybrid_weighted"].strip() + ")) WHERE n <= 10")
def two_phase_rank(spark, d):
    """The fifty best by words are ranked again by the hybrid score; the dear second phase never sees the rest."""
    return S.top_k(SQ.hybrid_weighted(spark, d), 10)


@query(
    """WITH t AS (SELECT doc_id, kind, captured_at, trust_rank FROM documents JOIN monitored_roots ON name = source),
n AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY captured_at DESC NULLS LAST, doc_id) AS a, row_number() OVER (PARTITION BY kind ORDER BY trust_rank DESC NULLS LAST, doc_id) AS b FROM t),
s AS (SELECT doc_id, kind, round(CASE WHEN a <= 100 THEN 1.0::DOUBLE / (60 + a) ELSE 0 END + CASE WHEN b <= 100 THEN 1.0::DOUBLE / (60 + b) ELSE 0 END, 9) AS score FROM n WHERE a <= 100 OR b <= 100)
SELECT kind, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 10 AND kind IS NOT NULL"""
)
def freshness_and_trust(spark, d):
    """Two streams of each kind of document, the newest hundred and the hundred of the most trusted roots, fused."""
    roots = S.small(table(spark, d, "monitored_roots").select(F.col("name").alias("source"), "trust_rank"))
    known = SQ.docs(spark, d).where("kind is not null").select("doc_id", "kind", "source", "captured_at").join(roots, "source")

    def stream(name, column):
        order = Window.partitionBy("kind").orderBy(F.desc_nulls_last(column), F.asc("doc_id"))
        return known.select("kind", "doc_id", F.lit(name).alias("stream"), F.row_number().over(order).alias("rank")).where("rank <= 100")

    fused = S.reciprocal_rank_fusion(stream("fresh", "captured_at").unionByName(stream("trust", "trust_rank")), by=["kind"]).withColumn("score", F.round("score", 9))
    return S.top_k(fused, 10, "kind").select("kind", "doc_id", "score")


@query(
    """SELECT id, nullif(coalesce(nullif(qualified_name, ''), name), '') AS symbol, symbol_kind AS kind, lower(language) AS language, nullif(regexp_extract(replace(path, chr(92), '/'), '[^/]*$'), '') AS path, line_start FROM
(SELECT DISTINCT id, qualified_name, name, symbol_kind, language, path, line_start FROM code_symbols)"""
)
def code_allow_list(spark, d):
    """The fields of a symbol that may be shown, empty ones as null, the path as its leaf."""
    s = table(spark, d, "code_symbols").select("id", "qualified_name", "name", "symbol_kind", "language", "path", "line_start").distinct()
    shown = lambda c: F.nullif(c, F.lit(""))
    return s.select("id", shown(F.coalesce(shown(F.col("qualified_name")), F.col("name"))).alias("symbol"), F.col("symbol_kind").alias("kind"), F.lower("language").alias("language"), shown(P.leaf("path")).alias("path"), "line_start")


@query(
    """SELECT doc_id, CASE WHEN source = 'agent-sessions' THEN 'local' WHEN source IS NULL THEN 'unknown' ELSE 'global' END AS scope, concat(coalesce(source, ''), '/', CAST(doc_id AS VARCHAR)) AS reference, coalesce(kind, 'document') AS logical_kind, coalesce(n_chars, 0) AS size FROM documents"""
)
def result_projection(spark, d):
    """Search results decorated with scope, reference and logical kind."""
    scope = F.when(F.col("source") == "agent-sessions", "local").when(F.col("source").isNull(), "unknown").otherwise("global")
    reference = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    return SQ.docs(spark, d).select("doc_id", scope.alias("scope"), reference.alias("reference"), F.coalesce("kind", F.lit("document")).alias("logical_kind"), F.coalesce("n_chars", F.lit(0)).alias("size"))


# ------------------------------------------------------------------ filters and pages


@query(
    f"""WITH {_CALLS} SELECT id FROM calls WHERE status IN ('failed', 'busy') AND lower(trim(service)) IN ('model-runner', 'indexer', 'watcher', 'embedder') AND started_at >= (SELECT max(started_at) - INTERVAL '30 days' FROM model_activity_events)"""
)
def jobs_filter(spark, d):
    """Several values per field and a window of time; an empty list of values would not filter."""
    rows = calls(spark, d, "status", "service").withColumn("service", F.lower(F.trim("service")))
    newest = table(spark, d, "model_activity_events").agg(F.max("started_at")).first()[0]
    kept = rows.where(R.matches({"status": "failed, busy", "service": ["model-runner", "indexer", "watcher", "embedder"], "activity_class": []}))
    return kept.where(F.col("started_at") >= F.lit(newest).cast("timestamp_ntz") - F.expr("interval 30 days")).select("id")


@query(
    f"""WITH {_CALLS}, s AS (SELECT CASE WHEN activity_class = 'retrieval' THEN 'retrieval' WHEN lower(trim(service)) = 'model-runner' THEN 'workers' ELSE 'jobs' END AS section, status FROM calls
UNION ALL SELECT 'watcher', event_type FROM events UNION ALL SELECT 'mail', CASE WHEN received_at IS NULL THEN 'undated' ELSE 'dated' END FROM (SELECT export_id, arg_max(received_at, exported_at_epoch) AS received_at FROM parsed_email GROUP BY 1))
SELECT section, status, count(*) AS n FROM s WHERE section <> 'mail' OR status = 'dated' GROUP BY 1, 2"""
)
def diagnostics(spark, d):
    """Counts of each section of the operations by status, with a filter of one section only."""
    rows = calls(spark, d, "activity_class", "service", "status")
    section = F.when(F.col("activity_class") == "retrieval", "retrieval").when(F.lower(F.trim("service")) == "model-runner", "workers").otherwise("jobs")
    mails = latest(table(spark, d, "parsed_email").select("export_id", "received_at", "exported_at_epoch"), "export_id", "exported_at_epoch")
    parts = rows.select(section.alias("section"), "status").unionByName(table(spark, d, "events").select(F.lit("watcher").alias("section"), F.col("event_type").alias("status")))
    parts = parts.unionByName(mails.where("received_at is not null").select(F.lit("mail").alias("section"), F.lit("dated").alias("status")))
    return parts.groupBy("section", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '|', event_id, '|', sha256('{"event_type": ["error", "view"], "user_id": []}')) AS next FROM events WHERE event_type IN ('error', 'view') AND (ts, event_id) < (TIMESTAMP '2024-01-15', 5000) ORDER BY ts DESC, event_id DESC LIMIT 51"""
)
def keyset_fingerprint(spark, d):
    """A page below a cursor that names the filter it was made for; a cursor of another filter is refused."""
    filters = {"user_id": [], "event_type": ["view", "error"]}
    cursor = R.cursor("2024-01-15 00:00:00", 5000, filters)
    at, key = R.position(cursor, filters)
    below = F.struct("ts", "event_id") < F.struct(F.lit(at).cast("timestamp_ntz").alias("ts"), F.lit(key).cast("long").alias("event_id"))
    page = table(spark, d, "events").where(R.matches(filters)).where(below).orderBy(F.desc("ts"), F.desc("event_id")).limit(51)
    following = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id").cast("string"), F.lit(R.fingerprint(filters)))
    return page.select("event_id", following.alias("next"))


# ------------------------------------------------------------------ reports


@query(
    """WITH a AS (SELECT id, arg_max(root_id, updated_at) AS root_id, arg_max(extraction_status, updated_at) AS s FROM source_assets GROUP BY id),
c AS (SELECT m.name AS root, m.enabled, count(a.id) AS n, count(*) FILTER (WHERE a.s = 'failed' OR a.s LIKE 'blocked%' OR a.s = 'pending') AS bad FROM monitored_roots m LEFT JOIN a ON a.root_id = m.id GROUP BY ALL),
r AS (SELECT root, CASE WHEN NOT enabled THEN 'blocked' WHEN bad > 0 THEN 'partial' WHEN n > 0 THEN 'ready' ELSE 'not_run' END AS readiness FROM c)
SELECT root, readiness, CASE readiness WHEN 'blocked' THEN 0 WHEN 'partial' THEN 1 WHEN 'not_run' THEN 2 ELSE 3 END AS place, CASE readiness WHEN 'blocked' THEN 'Enable the root.' WHEN 'partial' THEN 'Look at failed and pending assets.' WHEN 'not_run' THEN 'Run a first crawl.' ELSE 'No action required.' END AS required_action,
count(*) OVER (PARTITION BY readiness) AS alike FROM r ORDER BY place, root"""
)
def roots_report(spark, d):
    """Roots in the order of their need, with what is to be done and how many share the state; a report of as many rows as there are roots."""
    state = F.col("readiness")
    place = F.when(state == "blocked", 0).when(state == "partial", 1).when(state == "not_run", 2).otherwise(3)
    action = F.when(state == "blocked", "Enable the root.").when(state == "partial", "Look at failed and pending assets.").when(state == "not_run", "Run a first crawl.").otherwise("No action required.")
    told = root_readiness(spark, d).select("root", "readiness", place.alias("place"), action.alias("required_action"))
    return told.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("readiness"))).orderBy("place", "root")


@query(
    f"""WITH {_CALLS}, l AS (SELECT max(started_at) AS now FROM model_activity_events), w AS (SELECT lower(trim(service)) AS service, status, started_at >= now - INTERVAL '336 hours' AS fresh FROM calls, l)
SELECT service, count(*) FILTER (WHERE fresh) AS runs, count(*) FILTER (WHERE fresh AND status = 'failed') AS failed,
CASE WHEN count(*) FILTER (WHERE fresh) = 0 THEN 'not_run' WHEN count(*) FILTER (WHERE fresh AND status = 'completed') = 0 THEN 'blocked' WHEN count(*) FILTER (WHERE fresh AND status = 'failed') > 0 THEN 'partial' ELSE 'ready' END AS readiness FROM w GROUP BY 1"""
)
def reliability_readiness(spark, d):
    """What the runs of the last 336 hours say about each service."""
    newest = table(spark, d, "model_activity_events").agg(F.max("started_at")).first()[0]
    fresh = F.col("started_at") >= F.lit(newest).cast("timestamp_ntz") - F.expr("interval 336 hours")
    n = calls(spark, d, "service", "status").groupBy(F.lower(F.trim("service")).alias("service")).agg(
        F.count_if(fresh).alias("runs"), F.count_if(fresh & (F.col("status") == "failed")).alias("failed"), F.count_if(fresh & (F.col("status") == "completed")).alias("_done")
    )
    readiness = F.when(F.col("runs") == 0, "not_run").when(F.col("_done") == 0, "blocked").when(F.col("failed") > 0, "partial").otherwise("ready")
    return n.select("service", "runs", "failed", readiness.alias("readiness"))


@query(
    f"""WITH {_CALLS} SELECT activity_class, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS proposals, count(*) FILTER (WHERE status = 'completed') AS passed,
round(CASE WHEN count(*) FILTER (WHERE status IN ('completed', 'failed')) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE status = 'completed')::DOUBLE / count(*) FILTER (WHERE status IN ('completed', 'failed')) END, 6)::DOUBLE AS precision FROM calls GROUP BY 1"""
)
def decision_precision(spark, d):
    """Passed over decided proposals of each class; 1 where nothing was decided."""
    decided, passed = F.count_if(F.col("status").isin("completed", "failed")), F.count_if(F.col("status") == "completed")
    counted = calls(spark, d, "activity_class", "status").groupBy("activity_class").agg(decided.alias("proposals"), passed.alias("passed"))
    return counted.withColumn("precision", F.round(F.coalesce(F.col("passed") / F.nullif(F.col("proposals"), F.lit(0)), F.lit(1.0)), 6))


@query(
    """WITH a AS (SELECT id, arg_max(root_id, updated_at) AS root_id FROM source_assets WHERE file_kind = 'code' GROUP BY id), s AS (SELECT DISTINCT id, source_asset_id, parser_status FROM code_symbols),
f AS (SELECT 'fallback' AS gap, m.name AS subject, count(*) AS n FROM s JOIN a ON a.id = s.source_asset_id JOIN monitored_roots m ON m.id = a.root_id WHERE parser_status LIKE 'fallback%' GROUP BY ALL),
e AS (SELECT 'feedback' AS gap, concat('user-', user_id) AS subject, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT gap, subject, n, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS priority FROM (SELECT * FROM f UNION ALL SELECT * FROM e) ORDER BY n DESC, gap, subject LIMIT 8"""
)
def code_gap_priority(spark, d):
    """The eight largest gaps of code understanding, from fallback parsers and from feedback."""
    a = latest(table(spark, d, "source_assets").where("file_kind = 'code'").select("id", "root_id", "updated_at"), "id", "updated_at")
    s = table(spark, d, "code_symbols").where(F.col("parser_status").startswith("fallback")).select("id", F.col("source_asset_id").alias("aid")).distinct()
    roots = S.small(table(spark, d, "monitored_roots").select(F.col("id").alias("root_id"), F.col("name").alias("subject")))
    fallback = s.join(a.select(F.col("id").alias("aid"), "root_id"), "aid").join(roots, "root_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n")).select(F.lit("fallback").alias("gap"), "subject", "n")
    errors = table(spark, d, "events").where("event_type = 'error'").groupBy(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    gaps = fallback.unionByName(errors.select(F.lit("feedback").alias("gap"), "subject", "n"))
    return gaps.withColumn("priority", F.when(F.col("n") >= 3, "high").otherwise("medium")).orderBy(F.desc("n"), "gap", "subject").limit(8)


# ------------------------------------------------------------------ queues and schedules


@query(
    """WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) AS k FROM events)
SELECT event_type, count(*) FILTER (WHERE k <= 3) AS taken, count(*) FILTER (WHERE k > 3) AS dropped FROM n GROUP BY 1"""
)
def bounded_queue(spark, d):
    """A queue that is drained every hour holds three events of a type; what arrives later is dropped and counted."""
    taken = Q.bounded(table(spark, d, "events").withColumn("w", F.date_trunc("hour", F.col("ts").cast("timestamp"))), ["event_type", "w"], [F.asc("ts"), F.asc("event_id")], 3)
    return taken.groupBy("event_type").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("dropped"))


@query(
    """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, CAST(date_diff('second', date_trunc('second', last), TIMESTAMP '2024-02-01') // 86400 - 1 AS BIGINT) AS missed FROM l WHERE date_diff('second', date_trunc('second', last), TIMESTAMP '2024-02-01') >= 86400"""
)
def interval_schedule(spark, d):
    """Schedules that are due after a day, with the number of runs missed since."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return Q.due(last, F.unix_seconds(F.col("last").cast("timestamp")), F.unix_seconds(F.expr("timestamp_ntz'2024-02-01 00:00:00'").cast("timestamp")), 86400).select("user_id", "missed")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
w(user_id, event_type, n, last, miss) AS (SELECT user_id, event_type, n, t, true FROM o WHERE n = 1 UNION ALL
 SELECT o.user_id, o.event_type, o.n, CASE WHEN o.t - w.last >= 43200 THEN o.t ELSE w.last END, o.t - w.last >= 43200 FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.n = w.n + 1)
SELECT event_type, count(*) FILTER (WHERE miss) AS misses, count(*) FILTER (WHERE NOT miss) AS hits FROM w GROUP BY 1"""
)
def ttl_cache(spark, d):
    """Hits and misses of a cache whose entries live half a day after they were computed."""
    e = table(spark, d, "events")
    missed = Q.accepted(e, ["user_id", "event_type"], F.unix_seconds(F.col("ts").cast("timestamp")), "event_id", 43200).groupBy("event_type").agg(F.count(F.lit(1)).alias("misses"))
    asked = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(missed, "event_type").select("event_type", "misses", (F.col("n") - F.col("misses")).alias("hits"))


QUERIES, SQL = query.queries, query.sql
