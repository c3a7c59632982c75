"""Queries over lifecycles, graphs, queues and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import scores as SC
from siltstone.operators import graph as G
from siltstone.operators import queues as Q
from siltstone.plans.registry import Registry
from siltstone.tables import table

query = Registry()
NOW = "timestamp_ntz'2024-02-01 00:00:00'"


def events(spark, d):
    return table(spark, d, "events")


def orders(spark, d):
    return table(spark, d, "orders")


@query(
    """
WITH o AS (SELECT o_orderkey, o_totalprice / 500000 AS conf, date_diff('day', o_orderdate, DATE '2002-01-01')::DOUBLE AS age, (o_custkey % 30)::DOUBLE AS ca, o_custkey % 3 AS has, o_orderkey % 25 AS usage, o_orderstatus AS st FROM orders),
s AS (SELECT o_orderkey, greatest(0, least(1, (greatest(0, least(1, conf)) * 0.4::DOUBLE + exp(-age / 120) * 0.2::DOUBLE + (CASE WHEN has = 0 THEN 0.35::DOUBLE ELSE exp(-ca / 90) END) * 0.2::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE + least(ln(1 + usage::DOUBLE) / ln(21::DOUBLE), 1) * 0.05::DOUBLE)
  * (CASE st WHEN 'F' THEN 0.5::DOUBLE WHEN 'P' THEN 0.8::DOUBLE ELSE 1 END))) AS score FROM o)
SELECT o_orderkey, round(score, 9) AS score FROM s
"""
)
def lifecycle_score(spark, d):
    c = F.col
    age = F.datediff(F.lit("2002-01-01").cast("date"), c("o_orderdate").cast("date")).cast("double")
    confirmed = F.when(c("o_custkey") % 3 != 0, (c("o_custkey") % 30).cast("double"))
    penalty = F.when(c("o_orderstatus") == "F", 0.5).when(c("o_orderstatus") == "P", 0.8).otherwise(1.0)
    score = SC.lifecycle_score(c("o_totalprice") / 500000, age, confirmed, F.lit(0.5), c("o_orderkey") % 25, penalty)
    return orders(spark, d).select("o_orderkey", F.round(score, 9).alias("score"))


@query("SELECT o_custkey, o_orderpriority, arg_max(o_totalprice, struct_pack(t := o_orderdate, k := o_orderkey)) AS price, max(o_orderkey) AS seen FROM orders GROUP BY 1, 2")
def claim_merge(spark, d):
    """A keyed merge of two halves of a log into one row per key, newest first."""
    o = orders(spark, d).withColumn("version", F.struct("o_orderdate", "o_orderkey"))
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    merged = Q.upsert(old.select("o_custkey", "o_orderpriority", "version", "o_totalprice"), new.select("o_custkey", "o_orderpriority", "version", "o_totalprice"), ["o_custkey", "o_orderpriority"], "version")
    seen = o.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("seen"))
    return merged.join(seen, ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority", F.col("o_totalprice").alias("price"), "seen")


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, k := event_id)) AS state, count(*) AS transitions, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id")
def transitions_fold(spark, d):
    """The current state of each key from its log, with counts per transition."""
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("transitions"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'stale' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'retention:deprioritize' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '5%'")
def review_reasons(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "stale"), F.when(F.col("o_orderpriority").startswith("5"), "retention:deprioritize")))
    return orders(spark, d).select("o_orderkey", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS current, count(*) FILTER (WHERE o_orderstatus <> 'O') AS needs_review, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders")
def review_counts(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return orders(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "O").alias("current"), F.count_if(s != "O").alias("needs_review"), F.count_if(p.startswith("1")).alias("urgent"))


@query(
    """SELECT class, bucket, count(*) AS n FROM (SELECT 'claim' AS class, CASE WHEN o_totalprice < 100000 THEN 'deprioritize' WHEN o_orderstatus = 'F' THEN 'review' ELSE 'keep' END AS bucket FROM orders
UNION ALL SELECT 'episode', CASE WHEN c_acctbal < 0 THEN 'deprioritize' ELSE 'keep' END FROM customer UNION ALL SELECT 'corpus', CASE WHEN p_size < 10 THEN 'review' ELSE 'keep' END FROM part) GROUP BY 1, 2"""
)
def retention_report(spark, d):
    c = F.col
    claims = orders(spark, d).select(F.lit("claim").alias("class"), F.when(c("o_totalprice") < 100000, "deprioritize").when(c("o_orderstatus") == "F", "review").otherwise("keep").alias("bucket"))
    memories = table(spark, d, "customer").select(F.lit("episode").alias("class"), F.when(c("c_acctbal") < 0, "deprioritize").otherwise("keep").alias("bucket"))
    corpus = table(spark, d, "part").select(F.lit("corpus").alias("class"), F.when(c("p_size") < 10, "review").otherwise("keep").alias("bucket"))
    return claims.unionByName(memories).unionByName(corpus).groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION SELECT DISTINCT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier UNION SELECT DISTINCT concat('s', s_suppkey), concat('r', s_suppkey % 5) FROM supplier),
w(node, depth, path) AS (SELECT 'r0', 0, ['r0'] UNION ALL SELECT e.dst, depth + 1, list_append(path, e.dst) FROM w JOIN e ON e.src = w.node WHERE depth < 4 AND NOT list_contains(path, e.dst)),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
SELECT node, CAST(depth AS INTEGER) AS depth FROM m
"""
)
def graph_traverse(spark, d):
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    edge = lambda f, a, x, b, y, k: f.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), y.cast("string")).alias("dst"), F.lit(k).alias("kind"))
    edges = edge(nation, "r", "n_regionkey", "n", F.col("n_nationkey"), "has").union(edge(supplier, "n", "s_nationkey", "s", F.col("s_suppkey"), "has")).union(edge(supplier, "s", "s_suppkey", "r", F.col("s_suppkey") % 5, "serves"))
    start = spark.createDataFrame([("r0",)], "node string")
    return G.traverse(edges, start, 4).select("node", "depth")


# ------------------------------------------------------------------ queues


@query(
    """
WITH b AS (SELECT event_type, count(*) AS busy FROM events WHERE event_id % 2000 = 1 GROUP BY 1),
r AS (SELECT e.event_type, event_id, value, ts, row_number() OVER (PARTITION BY e.event_type ORDER BY value DESC, ts, event_id) AS n FROM events e WHERE event_id % 2000 <> 1)
SELECT event_id, r.event_type FROM r LEFT JOIN b USING (event_type) WHERE n <= greatest(0, 5 - coalesce(busy, 0)) ORDER BY value DESC, ts, event_id LIMIT 12
"""
)
def family_capped_claim(spark, d):
    e = events(spark, d)
    return Q.claim(e.where("event_id % 2000 <> 1"), e.where("event_id % 2000 = 1"), "event_type", "event_id", "value", "ts", 5, 12).select("event_id", "event_type")


@query("SELECT event_id FROM events e WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99)")
def running_guard(spark, d):
    """Work of users for whom nothing of the kind runs already."""
    e = events(spark, d)
    busy = e.where("event_type = 'error' and value > 99").select("user_id")
    return e.where("event_type = 'click'").join(busy, "user_id", "left_anti").select("event_id")


_ROUTES = {"view": ("light", 1), "click": ("light", 1), "signup": ("ingest", 2), "purchase": ("ingest", 3), "error": ("repair", 5)}


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'light' WHEN 'click' THEN 'light' WHEN 'signup' THEN 'ingest' WHEN 'purchase' THEN 'ingest' WHEN 'error' THEN 'repair' END AS family, CAST(CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 5 ELSE 1 END AS INTEGER) AS priority FROM events")
def routing_case(spark, d):
    """Family and priority by type, from a literal table."""
    family = F.create_map(*[F.lit(x) for k, v in _ROUTES.items() for x in (k, v[0])])
    priority = F.create_map(*[F.lit(x) for k, v in _ROUTES.items() for x in (k, v[1])])
    return events(spark, d).select("event_id", family[F.col("event_type")].alias("family"), priority[F.col("event_type")].alias("priority"))


@query("SELECT event_id, least(3600.0, 60.0 * pow(2, least(greatest(event_id % 9 - 1, 0), 16)))::DOUBLE AS wait FROM events")
def backoff(spark, d):
    return events(spark, d).select("event_id", SC.backoff(60.0, F.col("event_id") % 9, 3600.0).alias("wait"))


@query("SELECT event_id, CASE WHEN date_diff('second', ts, TIMESTAMP '2024-02-01') > 1209600 THEN 'stale' ELSE 'running' END AS state FROM events WHERE event_type = 'view'")
def stale_recovery(spark, d):
    age = F.unix_seconds(F.expr(NOW).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return events(spark, d).where("event_type = 'view'").select("event_id", F.when(age > 1209600, "stale").otherwise("running").alias("state"))


@query(
    """
WITH l AS (SELECT * FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) ORDER BY o_orderdate, o_orderkey LIMIT 16),
c AS (SELECT *, sum(CASE WHEN o_orderstatus IS DISTINCT FROM f THEN 1 ELSE 0 END) OVER o AS odd, sum(o_totalprice) OVER o AS bytes FROM (SELECT *, first_value(o_orderstatus) OVER (ORDER BY o_orderdate, o_orderkey) AS f FROM l) WINDOW o AS (ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey FROM c WHERE odd = 0 AND bytes <= 1000000
"""
)
def strict_priority_prefix(spark, d):
    return Q.head_batch(orders(spark, d), "o_orderpriority", [F.asc("o_orderdate"), F.asc("o_orderkey")], F.col("o_orderstatus"), F.col("o_totalprice"), 16, 1_000_000).select("o_orderkey")


@query("SELECT user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS INTEGER) AS batch, event_id FROM events WHERE event_type = 'signup'")
def path_batches(spark, d):
    """Pending work of a key in batches of eight."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return events(spark, d).where("event_type = 'signup'").select("user_id", ((F.row_number().over(order) - 1) / 8).cast("int").alias("batch"), "event_id")


@query("SELECT event_id, CAST(turn AS INTEGER) AS turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events) WHERE turn <= 20")
def index_sync_order(spark, d):
    """Round-robin over owner classes, so that none starves."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return events(spark, d).select("event_id", F.row_number().over(order).alias("turn")).where("turn <= 20")


@query(
    """
WITH m AS (SELECT event_id, user_id, event_type, ts, value > 50 AS c, lag(value > 50) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
k AS (SELECT *, CASE WHEN n = 1 THEN 'added' WHEN c IS DISTINCT FROM p THEN 'updated' ELSE 'unchanged' END AS event FROM m)
SELECT event_id, event, CAST(sum(CASE WHEN event <> 'unchanged' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS revision FROM k
"""
)
def latest_revision(spark, d):
    return Q.revisions(events(spark, d), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")], F.col("value") > 50).select("event_id", "event", "revision")


@query("SELECT event_type, max(value) AS most FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50 GROUP BY 1")
def calibration_latest(spark, d):
    """The largest of the latest fifty samples of each shape."""
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, d).withColumn("n", F.row_number().over(newest)).where("n <= 50").groupBy("event_type").agg(F.max("value").alias("most"))


@query(
    """
WITH a AS (SELECT sum(value) AS used FROM events WHERE event_id % 997 = 0)
SELECT event_id, CASE WHEN value > 95 THEN 'unschedulable' WHEN used + value > 600 THEN 'budget_exceeded' WHEN user_id % 10 = 0 THEN 'exclusive_conflict' ELSE 'granted' END AS decision FROM events, a WHERE event_type = 'signup'
"""
)
def admission(spark, d):
    """One-shot admission of requests against the sum of active reservations."""
    used = events(spark, d).where("event_id % 997 = 0").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
    v = F.col("value")
    decision = F.when(v > 95, "unschedulable").when(v + float(used) > 600, "budget_exceeded").when(F.col("user_id") % 10 == 0, "exclusive_conflict").otherwise("granted")
    return events(spark, d).where("event_type = 'signup'").select("event_id", decision.alias("decision"))


# ------------------------------------------------------------------ batch twins of streams


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '1 hour' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS n FROM i GROUP BY user_id, k
"""
)
def session_quiet(spark, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "1 hour")
    return events(spark, d).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n")


@query(
    """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events WHERE event_type = 'view'),
w(user_id, n, last, event_id, taken) AS (SELECT user_id, n, t, event_id, true FROM o WHERE n = 1 UNION ALL
 SELECT o.user_id, o.n, CASE WHEN o.t - w.last >= 86400 THEN o.t ELSE w.last END, o.event_id, o.t - w.last >= 86400 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT user_id, event_id FROM w WHERE taken
"""
)
def debounce_accepted(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return Q.accepted(events(spark, d).where("event_type = 'view'"), ["user_id"], seconds, "event_id", 86400).select("user_id", "event_id")


@query("SELECT id, count(*) AS deliveries FROM model_activity_events GROUP BY id")
def inbox_dedupe(spark, d):
    """Each message once with the number of its deliveries."""
    return table(spark, d, "model_activity_events").groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 6 >= 5 THEN 'dead_letter' ELSE 'retry' END AS route FROM events")
def dlq_split(spark, d):
    route = F.when(F.col("event_type") != "error", "ok").when(F.col("event_id") % 6 >= 5, "dead_letter").otherwise("retry")
    return events(spark, d).select("event_id", route.alias("route"))


@query("SELECT DISTINCT id FROM source_assets WHERE last_seen_at < TIMESTAMP '2024-06-01' AND deleted_at IS NULL")
def grace_purge(spark, d):
    return table(spark, d, "source_assets").where("last_seen_at < timestamp_ntz'2024-06-01 00:00:00' and deleted_at is null").select("id").distinct()


@query("SELECT doc_id, '2024-03-02' AS retain_until FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def suppress_unseen(spark, d):
    """What a converged scan did not see is suppressed and kept for thirty days."""
    docs = table(spark, d, "documents").select("doc_id")
    unseen = docs.where("doc_id % 3 = 0").join(docs.where("doc_id % 2 = 0"), "doc_id", "left_anti")
    return unseen.select("doc_id", F.date_format(F.expr(f"{NOW} + interval 30 days"), "yyyy-MM-dd").alias("retain_until"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size = l_linenumber + 10")
def deferred_replay(spark, d):
    """Deferred work whose capability has become available, by several keys."""
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") + 10).alias("p_size"))
    return lines.join(table(spark, d, "part").select("p_partkey", "p_size"), ["p_partkey", "p_size"]).select("l_orderkey", "l_linenumber").distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'deprioritize' ELSE 'review' END AS action FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice < 20000) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def governance_dedupe(spark, d):
    """Proposed actions without those that are already open."""
    proposed = orders(spark, d).where("o_orderstatus = 'F' or o_totalprice < 20000").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "deprioritize").otherwise("review").alias("action"))
    already = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return proposed.join(already, "o_orderkey", "left_anti")


QUERIES, SQL = query.queries, query.sql
