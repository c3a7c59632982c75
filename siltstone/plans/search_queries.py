"""Queries over ranking, fusion, filtering, collapsing, packing and duplicate detection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import scores as SC
from siltstone.functions import text as X
from siltstone.functions import vectors as V
from siltstone.operators import code as C
from siltstone.operators import measures as M
from siltstone.operators import search as S
from siltstone.operators import similarity as D
from siltstone.operators.rerank import rerank
from siltstone.plans.registry import Registry
from siltstone.session import cut_lineage
from siltstone.tables import latest, table

query = Registry()


def docs(spark, d):
    return table(spark, d, "documents")


def cases(spark, d):
    """The query of every evaluation item."""
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query")


_BM25 = """
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM eval_items),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc)
"""


def bm25_scores(spark, d):
    return S.bm25(docs(spark, d), cases(spark, d)).withColumn("score", F.round("score", 6))


@query(_BM25 + "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    return S.top_k(bm25_scores(spark, d), 10)


@query(
    """
WITH e AS (SELECT id, arg_max(coalesce(title, ''), updated_at) AS title, arg_max(coalesce(summary, ''), updated_at) AS summary FROM episodes GROUP BY id),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM eval_items),
w AS (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term, 1.0::DOUBLE AS w FROM e UNION ALL SELECT id, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')), 0.4::DOUBLE FROM e),
s AS (SELECT query_id, id, round(sum(w), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10
"""
)
def title_body_weighted(spark, d):
    """The ten best episodes of every evaluation item by weighted term counts: titles weigh 1.0, bodies 0.4."""
    e = latest(table(spark, d, "episodes").select("id", "title", "summary", "updated_at"), "id", "updated_at")
    wanted = cases(spark, d).select("query_id", F.explode(F.array_distinct(X.ascii_tokens("query"))).alias("term"))
    fields = [e.select("id", X.ascii_tokens(F.coalesce(c, F.lit(""))).alias("ts"), F.lit(w).alias("w")) for c, w in (("title", 1.0), ("summary", 0.4))]
    terms = fields[0].unionByName(fields[1]).select("id", F.explode("ts").alias("term"), "w")
    weighed = terms.join(S.small(wanted.select("term").distinct()), "term", "left_semi").groupBy("id", "term").agg(F.sum("w").alias("w"))
    scored = weighed.join(S.small(wanted), "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return S.top_k(scored, 10, key="id")


_TRI = "list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3)))))"


@query(
    f"""
WITH n AS (SELECT p_partkey, {_TRI.format(c="p_name")} AS g FROM part), q AS (SELECT p_partkey AS query_id, g FROM n WHERE p_partkey % 100 = 0),
s AS (SELECT query_id, p_partkey, len(list_intersect(n.g, q.g)) AS s, len(n.g) AS a, len(q.g) AS b FROM n, q),
r AS (SELECT query_id, p_partkey, round(s / (a + b - s), 6) AS score FROM s WHERE s > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS rank FROM r WHERE score >= 0.3)
SELECT query_id, p_partkey, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20
"""
)
def trigram_topk(spark, d):
    """Names like those of every part whose key is divisible by 100."""
    asked = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return S.trigram_search(table(spark, d, "part"), asked, "p_partkey", "p_name", "query_id", "query", 0.3, 20)


@query(
    """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS f FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e, f), 6) AS score FROM v, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""
)
def knn_cosine_topk(spark, d):
    """Exact neighbours of every vector whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = S.knn(v, asked, 11).where("query_id <> vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))
    return S.top_k(near, 10, key="vec_id")


_FRESH = "fr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY captured_at DESC NULLS LAST, doc_id) AS rank FROM (SELECT query_id, doc_id FROM r WHERE rank <= 50) JOIN documents USING (doc_id))"


def fused(spark, d):
    """Lexical and freshness ranks of the 50 best documents of each query, fused."""
    lexical = S.top_k(bm25_scores(spark, d), 50)
    dated = lexical.select("query_id", "doc_id").join(docs(spark, d).select("doc_id", "captured_at"), "doc_id")
    newest = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("captured_at"), F.asc("doc_id"))
    fresh = dated.select("query_id", "doc_id", F.lit("fresh").alias("stream"), F.row_number().over(newest).alias("rank"))
    streams = lexical.select("query_id", "doc_id", F.lit("lexical").alias("stream"), "rank").unionByName(fresh)
    return S.reciprocal_rank_fusion(streams, by=["query_id"])


_RRF = (
    _BM25.rstrip()
    + ", "
    + _FRESH
    + """,
u AS (SELECT query_id, doc_id, 'lexical' AS stream, rank FROM r WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 'fresh', rank FROM fr),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, list_sort(list(DISTINCT stream)) AS streams FROM u GROUP BY query_id, doc_id)
"""
)


@query(_RRF + "SELECT query_id, doc_id, round(score, 9) AS score, array_to_string(streams, '+') AS streams FROM f")
def rrf_fusion(spark, d):
    return fused(spark, d).select("query_id", "doc_id", F.round("score", 9).alias("score"), F.array_join("streams", "+").alias("streams"))


@query(_RRF + ", m AS (SELECT query_id, doc_id, round(score, 9) AS score FROM f), w AS (SELECT query_id, doc_id, score, row_number() OVER o AS rank, round(score - lead(score) OVER o, 6) AS margin FROM m WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, doc_id)) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, margin FROM w WHERE rank <= 5")
def rank_margin(spark, d):
    rounded = fused(spark, d).withColumn("score", F.round("score", 9))
    return S.with_margin(rounded, ["query_id"]).where("rank <= 5").select("query_id", "doc_id", "rank", "margin")


@query(_RRF + "SELECT query_id, doc_id, CASE WHEN len(f.streams) >= 2 AND rank <= 3 THEN 'high' WHEN len(f.streams) >= 2 THEN 'medium' ELSE 'low' END AS band FROM f JOIN r USING (query_id, doc_id)")
def confidence_band(spark, d):
    hits = fused(spark, d)
    lexical = F.element_at("ranks", F.array_position("streams", "lexical").cast("int"))
    return hits.select("query_id", "doc_id", SC.confidence_band(F.size("streams"), F.lit(False), lexical).alias("band"))


@query(
    _BM25.rstrip()
    + """,
c AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS lexical FROM r WHERE rank <= 50),
qt AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM eval_items) GROUP BY ALL),
ql AS (SELECT query_id, sqrt(sum(n * n)) AS ql FROM qt GROUP BY 1),
dt AS (SELECT doc_id, term, count(*) AS n FROM p WHERE doc_id IN (SELECT doc_id FROM c) GROUP BY ALL), dl AS (SELECT doc_id, sqrt(sum(n * n)) AS dl FROM dt GROUP BY 1),
x AS (SELECT query_id, doc_id, sum(qt.n * dt.n) AS dot FROM c JOIN qt USING (query_id) JOIN dt USING (doc_id, term) GROUP BY ALL)
SELECT query_id, doc_id, round(0.55 * dot / (ql * dl) + 0.45 * lexical, 6)::DOUBLE AS score FROM c JOIN x USING (query_id, doc_id) JOIN ql USING (query_id) JOIN dl USING (doc_id)
"""
)
def hybrid_weighted(spark, d):
    """0.55 closeness of term vectors and 0.45 BM25 over its best, for the 50 best documents of each query; only these documents' terms are counted."""
    best = S.top_k(bm25_scores(spark, d), 50).withColumn("lexical", F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).select("query_id", "doc_id", "lexical")
    best = cut_lineage(best)

    def terms(frame, key, text):
        split = frame.select(key, X.ascii_tokens(text).alias("_ts"))
        counted = split.select(key, F.explode("_ts").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
        return counted, counted.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))

    texts = docs(spark, d).select("doc_id", "text").join(S.small(best.select("doc_id").distinct()), "doc_id", "left_semi")
    of_doc, doc_length = terms(texts, "doc_id", "text")
    of_query, query_length = terms(cases(spark, d), "query_id", "query")
    of_query = S.small(of_query.withColumnRenamed("n", "m"))
    dot = best.join(of_doc, "doc_id").join(of_query, ["query_id", "term"]).groupBy("query_id", "doc_id", "lexical").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    whole = dot.join(doc_length, "doc_id").join(S.small(query_length.withColumnRenamed("length", "ql")), "query_id")
    return whole.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("ql") * F.col("length")) * 0.55 + F.col("lexical") * 0.45, 6).alias("score"))


# the documents that name the subject of a query, its last two words, are the relevant ones
_JUDGED = (
    _BM25.rstrip()
    + """,
s AS (SELECT item_id AS query_id, category, list_transform(list_reverse(list_slice(list_reverse(regexp_extract_all(lower(query), '[a-z0-9]+')), 1, 2)), lambda w: w) AS subject FROM eval_items),
rel AS (SELECT DISTINCT query_id, doc_id FROM s JOIN tok ON contains(concat(' ', array_to_string(ts, ' '), ' '), concat(' ', array_to_string(subject, ' '), ' ')) WHERE len(subject) = 2),
top AS (SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10),
j AS (SELECT s.query_id, any_value(category) AS category, min(top.rank) FILTER (WHERE rel.doc_id IS NOT NULL) AS first, count(*) FILTER (WHERE rel.doc_id IS NOT NULL AND top.rank <= 5) AS found,
 any_value(coalesce(n.n, 0)) AS relevant, max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2) AS margin, count(top.doc_id) AS results
 FROM s LEFT JOIN top ON top.query_id = s.query_id LEFT JOIN rel ON rel.query_id = s.query_id AND rel.doc_id = top.doc_id LEFT JOIN (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) n ON n.query_id = s.query_id GROUP BY s.query_id)
"""
)


def judged(spark, d):
    """query_id, category, first relevant rank among ten, relevant among the best five, all relevant, margin of the best result, results.

    The subjects are joined with the pairs of neighbouring words of the documents, so that no
    query meets every document.
    """
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "category", X.ascii_tokens("query").alias("w"))
    subject = F.array_join(F.slice("w", F.size("w") - 1, 2), " ")
    asked = items.where("size(w) > 1").select("query_id", subject.alias("pair"))
    words = docs(spark, d).where("text is not null").select("doc_id", X.ascii_tokens("text").alias("w"))
    pairs = words.select("doc_id", F.explode(F.array_distinct(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda x, y: F.concat_ws(" ", x, y)))).alias("pair"))
    relevant = cut_lineage(pairs.join(S.small(asked), "pair").select("query_id", "doc_id").distinct())
    top = S.top_k(bm25_scores(spark, d), 10).select("query_id", "doc_id", "score", "rank")
    told = top.join(relevant.withColumn("yes", F.lit(True)), ["query_id", "doc_id"], "left")
    rank, yes = F.col("rank"), F.col("yes")
    of_top = told.groupBy("query_id").agg(
        F.min(F.when(yes, rank)).alias("first"), F.count_if(yes & (rank <= 5)).alias("found"), F.count(F.lit(1)).alias("results"),
        (F.max(F.when(rank == 1, F.col("score"))) - F.max(F.when(rank == 2, F.col("score")))).alias("margin"),
    )
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    return items.select("query_id", "category").join(of_top, "query_id", "left").join(counts, "query_id", "left").na.fill(0, ["found", "results", "relevant"])


@query(
    _JUDGED
    + """SELECT query_id, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS top1, CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_3, round(coalesce(found::DOUBLE / nullif(relevant, 0), 0), 6) AS recall_at_5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
round(coalesce(CASE WHEN first <= 5 THEN 1.0::DOUBLE / log2(first + 1) END, 0), 6) AS ndcg_at_5 FROM j"""
)
def ir_metrics(spark, d):
    """Measures of the BM25 ranking of every evaluation item over the documents."""
    measured = M.rank_measures(F.col("first"), F.col("found"), F.col("relevant"))
    return judged(spark, d).select("query_id", *[F.round(v, 6).alias(n) for n, v in measured.items()])


@query(
    _JUDGED
    + """SELECT category, count(*) AS cases, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mean_mrr, round(avg(coalesce(found::DOUBLE / nullif(relevant, 0), 0)), 6) AS mean_recall, count(*) FILTER (WHERE first <= 3) AS passed FROM j GROUP BY 1"""
)
def metric_average(spark, d):
    """Mean measures and passed cases of each category."""
    m = M.rank_measures(F.col("first"), F.col("found"), F.col("relevant"))
    return judged(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(m["mrr"]), 6).alias("mean_mrr"), F.round(F.avg(m["recall_at_5"]), 6).alias("mean_recall"), F.count_if(F.col("first") <= 3).alias("passed"))


@query(
    _JUDGED
    + """SELECT category, CASE WHEN results < 2 THEN 'insufficient' WHEN round(margin, 6) >= 0.5 THEN 'high' WHEN round(margin, 6) >= 0.1 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, count(*) FILTER (WHERE first = 1) AS right FROM j GROUP BY 1, 2"""
)
def calibration_bands(spark, d):
    """How often the best result is relevant, by the confidence that its margin shows."""
    margin = F.round("margin", 6)
    band = F.when(F.col("results") < 2, "insufficient").when(margin >= 0.5, "high").when(margin >= 0.1, "medium").otherwise("low")
    return judged(spark, d).groupBy("category", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") == 1).alias("right"))


@query(_RRF + ", t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= least(16, greatest(10, 4))")
def rerank_pool(spark, d):
    """The pool handed to a reranker: first phase by lexical score, second by fusion, then least(ceiling, greatest(limit, 4))."""
    return S.top_k(fused(spark, d).withColumn("score", F.round("score", 9)), min(16, max(10, 4))).select("query_id", "doc_id", "rank")


@query(
    """
SELECT doc_id, CASE WHEN coalesce(kind, '') IN ('log_extract') THEN 'logical_kind' WHEN text IS NULL THEN 'lifecycle_state' WHEN coalesce(lower(lang), '') NOT IN ('en', 'de') THEN 'language' WHEN NOT coalesce(source LIKE '%-notes' OR source LIKE '%-ops', false) THEN 'path_glob' END AS exclusion_reason FROM documents
"""
)
def filter_reasons(spark, d):
    """The first filter that a document fails, null if it passes all."""
    c = F.col
    reason = SC.first_failing(
        (F.coalesce("kind", F.lit("")) != "log_extract", "logical_kind"),
        (c("text").isNotNull(), "lifecycle_state"),
        (F.coalesce(F.lower("lang"), F.lit("")).isin("en", "de"), "language"),
        (P.glob_match(c("source"), "*-notes") | P.glob_match(c("source"), "*-ops"), "path_glob"),
    )
    return docs(spark, d).select("doc_id", reason.alias("exclusion_reason"))


@query("SELECT DISTINCT id FROM (SELECT id, arg_max(extraction_status, updated_at) AS st, arg_max(coalesce(CAST(deleted_at AS VARCHAR), ''), updated_at) AS dl, arg_max(coalesce(canonical_asset_id, ''), updated_at) AS ca, arg_max(file_kind, updated_at) AS fk FROM source_assets GROUP BY id) WHERE st = 'indexed' AND dl = '' AND ca = '' AND fk IN ('text', 'document')")
def index_filter(spark, d):
    """Active, canonical and not deleted assets of some kinds."""
    a = latest(table(spark, d, "source_assets").select("id", "extraction_status", "deleted_at", "canonical_asset_id", "file_kind", "updated_at"), "id", "updated_at")
    return a.where("extraction_status = 'indexed' and deleted_at is null and canonical_asset_id is null and file_kind in ('text', 'document')").select("id")


@query("SELECT id FROM (SELECT id, arg_max(coalesce(superseded_by, ''), updated_at) AS s FROM episodes GROUP BY id) WHERE s = ''")
def current_only(spark, d):
    return latest(table(spark, d, "episodes").select("id", "superseded_by", "updated_at"), "id", "updated_at").where("superseded_by is null").select("id")


@query(
    """
WITH a AS (SELECT id, arg_max(asset_id, updated_at) AS asset_id, arg_max(chunk_index, updated_at) AS chunk_index FROM asset_chunks GROUP BY id),
s AS (SELECT id, arg_max(root_id, updated_at) AS root_id, arg_max(path, updated_at) AS path, arg_max(coalesce(CAST(deleted_at AS VARCHAR), ''), updated_at) AS dl FROM source_assets GROUP BY id)
SELECT a.id AS chunk_id, a.chunk_index, s.path, m.name AS root FROM a JOIN s ON s.id = a.asset_id JOIN monitored_roots m ON m.id = s.root_id WHERE s.dl = '' AND m.enabled
"""
)
def hydrate(spark, d):
    """Candidates with their asset and root; what is deleted or disabled vanishes."""
    chunks = latest(table(spark, d, "asset_chunks").select("id", "asset_id", "chunk_index", "updated_at"), "id", "updated_at")
    assets = latest(table(spark, d, "source_assets").select("id", "root_id", "path", "deleted_at", "updated_at"), "id", "updated_at").where("deleted_at is null")
    roots = S.small(table(spark, d, "monitored_roots").where("enabled").select(F.col("id").alias("root_id"), F.col("name").alias("root")))
    joined = chunks.join(assets.select(F.col("id").alias("asset_id"), "root_id", "path"), "asset_id").join(roots, "root_id")
    return joined.select(F.col("id").alias("chunk_id"), "chunk_index", "path", "root")


@query(
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents),
o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents WHERE source = 'agent-sessions'),
l AS (SELECT doc_id, round(CAST(1.15 AS DOUBLE) / (60 + k), 9) AS score, 0 AS pri FROM o WHERE k <= 50), c AS (SELECT doc_id, round(CAST(1 AS DOUBLE) / (60 + k), 9) AS score, 1 AS pri FROM r WHERE k <= 100),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pri) AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM c))
SELECT doc_id, score FROM u WHERE n = 1
"""
)
def scope_boost_dedupe(spark, d):
    """The 50 best local results, boosted by 1.15, before the 100 best of all scopes; the first occurrence of a document wins."""
    order = [F.desc_nulls_last("n_chars"), F.asc("doc_id")]

    def ranked(frame, k, boost, pri):
        best = frame.select("doc_id", "n_chars").orderBy(*order).limit(k)  # k rows, so one task may number them
        numbered = best.withColumn("k", F.row_number().over(Window.orderBy(*order)))
        return numbered.select("doc_id", F.round(F.lit(boost) / (60 + F.col("k")), 9).alias("score"), F.lit(pri).alias("pri"))

    every = docs(spark, d)
    both = ranked(every.where("source = 'agent-sessions'"), 50, 1.15, 0).unionByName(ranked(every, 100, 1.0, 1))
    return S.keep_best(both, ["doc_id"], [F.asc("pri")]).select("doc_id", "score")


@query("SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY captured_at DESC NULLS LAST, doc_id) AS n FROM documents) WHERE n <= 3")
def freshness_rank(spark, d):
    """The three newest documents of each source."""
    newest = Window.partitionBy("source").orderBy(F.desc_nulls_last("captured_at"), F.asc("doc_id"))
    return docs(spark, d).withColumn("n", F.row_number().over(newest)).where("n <= 3").select("doc_id")


@query("SELECT id FROM (SELECT id, arg_max(path, updated_at) AS p, arg_max(file_kind, updated_at) AS k, arg_max(extraction_status, updated_at) AS s FROM source_assets GROUP BY id) WHERE (contains(lower(p), 'lease') OR contains(lower(p), 'queue')) AND k = 'code' AND s = 'indexed'")
def catalogue_filter(spark, d):
    a = latest(table(spark, d, "source_assets").select("id", "path", "file_kind", "extraction_status", "updated_at"), "id", "updated_at")
    p = F.lower("path")
    return a.where((p.contains("lease") | p.contains("queue")) & (F.col("file_kind") == "code") & (F.col("extraction_status") == "indexed")).select("id")


_PACK = """
, c AS (SELECT query_id, f.doc_id, round(f.score, 9) AS score, coalesce(kind, '') AS title, coalesce(text, '') AS body, row_number() OVER (PARTITION BY query_id ORDER BY round(f.score, 9) DESC, f.doc_id) AS n FROM f JOIN documents USING (doc_id)),
i AS (SELECT query_id, doc_id, title, score, greatest(1, len(list_filter(string_split_regex(concat('### ', title, chr(10), regexp_replace(body, '^\\s+|\\s+$', '', 'g')), '\\s+'), lambda w: w <> ''))) AS cost FROM c WHERE n <= 12),
l AS (SELECT query_id, list(struct_pack(k := doc_id, c := CAST(cost AS BIGINT), used := CAST(0 AS BIGINT), st := '') ORDER BY score DESC, title, doc_id) AS items FROM i GROUP BY query_id),
w AS (SELECT query_id, list_reduce(list_prepend([struct_pack(k := CAST(-1 AS BIGINT), c := CAST(0 AS BIGINT), used := CAST(0 AS BIGINT), st := 'start')], list_transform(items, lambda x: [x])), lambda a, x:
   list_append(a, struct_pack(k := x[1].k, c := x[1].c, used := a[-1].used + CASE WHEN a[-1].used + x[1].c <= 400 THEN x[1].c ELSE 0 END, st := CASE WHEN a[-1].used + x[1].c <= 400 THEN 'packed' ELSE 'over_budget' END))) AS o FROM l),
x AS (SELECT query_id, unnest(o) AS e FROM w)
SELECT query_id, e.k AS doc_id, CAST(e.c AS INTEGER) AS tokens, e.st AS status FROM x WHERE e.st <> 'start'
"""


@query(_RRF + _PACK)
def brief_packing(spark, d):
    """The twelve best results of each query packed into 400 tokens."""
    best = S.top_k(fused(spark, d).withColumn("score", F.round("score", 9)), 12).select("query_id", "doc_id", "score")
    bodies = docs(spark, d).select("doc_id", F.coalesce("kind", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    return S.pack(best.join(bodies, "doc_id"), 400, by=["query_id"]).select("query_id", "doc_id", "tokens", "status")


@query(
    _RRF
    + """,
can AS (SELECT doc_id, duplicates FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) - 1 AS duplicates FROM documents WHERE text IS NOT NULL) WHERE doc_id = canonical),
h AS (SELECT query_id, doc_id, round(score, 9) AS score, duplicates, coalesce(kind, '') AS title, text AS body FROM f JOIN can USING (doc_id) JOIN documents USING (doc_id) WHERE starts_with(lower(lang), 'en')),
m AS (SELECT *, row_number() OVER o AS rank, round(score - lead(score) OVER o, 6) AS margin FROM h WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, doc_id)),
i AS (SELECT query_id, doc_id, title, score, rank, margin, duplicates, greatest(1, len(list_filter(string_split_regex(concat('### ', title, chr(10), regexp_replace(body, '^\\s+|\\s+$', '', 'g')), '\\s+'), lambda w: w <> ''))) AS cost FROM m WHERE rank <= 40),
l AS (SELECT query_id, list(struct_pack(k := doc_id, c := CAST(cost AS BIGINT), used := CAST(0 AS BIGINT), st := '') ORDER BY score DESC, title, doc_id) AS items FROM i GROUP BY query_id),
w AS (SELECT query_id, list_reduce(list_prepend([struct_pack(k := CAST(-1 AS BIGINT), c := CAST(0 AS BIGINT), used := CAST(0 AS BIGINT), st := 'start')], list_transform(items, lambda x: [x])), lambda a, x:
   list_append(a, struct_pack(k := x[1].k, c := x[1].c, used := a[-1].used + CASE WHEN a[-1].used + x[1].c <= 1200 THEN x[1].c ELSE 0 END, st := CASE WHEN a[-1].used + x[1].c <= 1200 THEN 'packed' ELSE 'over_budget' END))) AS o FROM l),
x AS (SELECT query_id, unnest(o) AS e, generate_subscripts(o, 1) - 2 AS position FROM w)
SELECT query_id, CAST(position AS INTEGER) AS position, e.k AS doc_id, CAST(e.c AS INTEGER) AS tokens, e.st AS status, CAST(rank AS INTEGER) AS rank, margin, duplicates FROM x JOIN i ON i.query_id = x.query_id AND i.doc_id = e.k WHERE e.st <> 'start'
""".replace("SELECT query_id, CAST(position", "SELECT x.query_id, CAST(position")
)
def search_brief(spark, d):
    """The flagship: ranked, fused, deduplicated and filtered results of each query, packed into a brief of 1,200 tokens.

    Texts are read for the survivors only; rank, margin and duplicates travel through the packing.
    """
    hits = cut_lineage(fused(spark, d).select("query_id", "doc_id", F.round("score", 9).alias("score")))
    wanted = S.small(hits.select("doc_id").distinct())
    copies = D.exact_duplicates(docs(spark, d), "doc_id", "text").where("doc_id = canonical").join(wanted, "doc_id", "left_semi").select("doc_id", "duplicates")
    english = docs(spark, d).where(F.lower("lang").startswith("en")).select("doc_id", F.coalesce("kind", F.lit("")).alias("title"))
    ranked = S.with_margin(hits.join(copies, "doc_id").join(english, "doc_id"), ["query_id"]).where("rank <= 40")
    bodies = docs(spark, d).select("doc_id", F.col("text").alias("body"))
    return S.pack(ranked.join(bodies, "doc_id"), 1200, by=["query_id"], carry=["rank", "margin", "duplicates"])


@query(name="rerank_scores")
def rerank_scores(spark, d):
    """The fused pool of each query in the order of a deterministic scorer."""
    pool = S.top_k(fused(spark, d).withColumn("score", F.round("score", 9)), 10).select("query_id", "doc_id", "rank")
    rows = pool.join(docs(spark, d).select("doc_id", "text"), "doc_id").join(cases(spark, d), "query_id")
    return rerank(rows)


@query(name="explain_struct")
def explain_struct(spark, d):
    """Why a result stands where it does: streams, raw scores, margin, scope, filters."""
    hits = S.with_margin(fused(spark, d).withColumn("score", F.round("score", 9)), ["query_id"]).where("rank <= 5")
    meta = docs(spark, d).select("doc_id", "source", "lang", "kind")
    raw = F.map_from_arrays(F.array(F.lit("rrf")), F.array(F.col("score")))
    told = F.struct("streams", raw.alias("raw_scores"), "rank", "margin", F.struct(F.col("source").alias("root"), F.lit("local_first").alias("mode")).alias("scope"), F.struct("lang", "kind").alias("filters"))
    return hits.join(meta, "doc_id").select("query_id", "doc_id", F.to_json(told).alias("explanation"))


@query(name="code_symbols")
def code_symbols(spark, d):
    """Declarations in the code assets' chunks."""
    assets = latest(table(spark, d, "source_assets").where("file_kind = 'code'").select("id", "path", "updated_at"), "id", "updated_at").select(F.col("id").alias("asset_id"), "path")
    of_code = table(spark, d, "asset_chunks").select("id", "asset_id", "body", "updated_at").join(S.small(assets.select("asset_id")), "asset_id", "left_semi")
    chunks = latest(of_code, "id", "updated_at")
    return C.code_symbols(chunks.join(assets, "asset_id"), text="body")


# ------------------------------------------------------------------ duplicates


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) - 1 AS duplicates FROM documents WHERE text IS NOT NULL")
def exact_duplicates(spark, d):
    return D.exact_duplicates(docs(spark, d), "doc_id", "text")


@query(
    f"""
WITH e AS (SELECT id, arg_max(title, updated_at) AS title, arg_max(confidence, updated_at) AS confidence, arg_max(usage_count, updated_at) AS usage_count FROM episodes GROUP BY id),
k AS (SELECT id, title, confidence, usage_count, lower(title) AS low, trim(regexp_replace(regexp_replace(lower(title), '{P.VERSION_MARKS}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS b FROM e),
f AS (SELECT *, CASE WHEN b = '' THEN low ELSE b END AS family FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY usage_count DESC NULLS LAST, confidence DESC NULLS LAST, lower(title), id) AS n, count(*) OVER (PARTITION BY family) - 1 AS suppressed FROM f)
SELECT family, id, suppressed FROM r WHERE n = 1
"""
)
def version_collapse(spark, d):
    e = latest(table(spark, d, "episodes").select("id", "title", "usage_count", "confidence", "updated_at"), "id", "updated_at")
    return S.collapse_versions(e, P.family_key("title"), "id", "usage_count", "confidence", "title").select("family", "id", "suppressed")


@query(
    """
WITH m AS (SELECT export_id, arg_max(regexp_replace(lower(coalesce(subject, '')), '^((re|aw|fwd|wg|fw)(\\[\\d+\\])?:\\s*)+', ''), exported_at_epoch) AS thread FROM parsed_email GROUP BY export_id)
SELECT thread, min(export_id) AS canonical, count(*) AS related FROM m GROUP BY thread
"""
)
def sibling_collapse(spark, d):
    """Mails of one thread as one result with the number of related mails."""
    m = latest(table(spark, d, "parsed_email").select("export_id", "subject", "exported_at_epoch"), "export_id", "exported_at_epoch")
    thread = F.regexp_replace(F.lower(F.coalesce("subject", F.lit(""))), r"^((re|aw|fwd|wg|fw)(\[\d+\])?:\s*)+", "")
    return m.groupBy(thread.alias("thread")).agg(F.min("export_id").alias("canonical"), F.count(F.lit(1)).alias("related"))


@query(
    """
WITH g AS (SELECT message_id, count(DISTINCT sha256(coalesce(text_body, ''))) AS prints, max(struct_pack(e := exported_at_epoch, id := export_id)) AS newest, count(DISTINCT export_id) AS exports
 FROM parsed_email WHERE message_id IS NOT NULL GROUP BY message_id)
SELECT message_id, newest.id AS keep, exports FROM g WHERE prints = 1 AND exports > 1
"""
)
def spool_dedupe(spark, d):
    """Messages exported several times with equal bodies: the newest export is kept."""
    m = table(spark, d, "parsed_email").where("message_id is not null")
    g = m.groupBy("message_id").agg(
        F.count_distinct(F.sha2(F.coalesce("text_body", F.lit("")), 256)).alias("prints"), F.max(F.struct("exported_at_epoch", "export_id")).alias("newest"), F.count_distinct("export_id").alias("exports")
    )
    return g.where("prints = 1 and exports > 1").select("message_id", F.col("newest.export_id").alias("keep"), "exports")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def identity_keep_best(spark, d):
    """The latest event of each identity, by aggregate."""
    best = F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(best)


_PAIRS = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)
"""


@query(_PAIRS + "SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.35")
def cosine_pairs(spark, d):
    return D.cosine_pairs(table(spark, d, "embeddings"), 0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "WITH RECURSIVE "
    + _PAIRS.strip().removeprefix("WITH ")
    + """, e AS (SELECT a AS u, b AS v FROM p WHERE s >= 0.35 UNION SELECT b, a FROM p WHERE s >= 0.35),
w(u, m) AS (SELECT u, u FROM e UNION SELECT e.v, w.m FROM w JOIN e ON e.u = w.u)
SELECT u AS node, min(m) AS component FROM w GROUP BY u
"""
)
def semantic_clusters(spark, d):
    return D.connected_components(D.cosine_links(table(spark, d, "embeddings"), 0.35))


_CLUSTERS = (
    "WITH RECURSIVE "
    + _PAIRS.strip().removeprefix("WITH ")
    + """, e AS (SELECT a AS u, b AS v FROM p WHERE s >= 0.35 UNION SELECT b, a FROM p WHERE s >= 0.35),
w(u, m) AS (SELECT u, u FROM e UNION SELECT e.v, w.m FROM w JOIN e ON e.u = w.u), c AS (SELECT u AS node, min(m) AS component FROM w GROUP BY u)
"""
)


@query(_CLUSTERS + "SELECT component, arg_max(node, struct_pack(n := coalesce(n_chars, 0), k := -node)) AS canonical, count(*) AS members, count(*) - 1 AS suppressed FROM c LEFT JOIN documents ON doc_id = node GROUP BY 1")
def cluster_canonical(spark, d):
    """The member that stands for each cluster, the one with the longest text, and how many it suppresses."""
    clusters = D.connected_components(D.cosine_links(table(spark, d, "embeddings"), 0.35))
    sized = clusters.join(docs(spark, d).select(F.col("doc_id").alias("node"), "n_chars"), "node", "left")
    rank = F.struct(F.coalesce("n_chars", F.lit(0)).alias("n"), (-F.col("node")).alias("k"))
    return sized.groupBy("component").agg(F.max_by("node", rank).alias("canonical"), F.count(F.lit(1)).alias("members"), (F.count(F.lit(1)) - 1).alias("suppressed"))


@query(
    """
WITH s AS (SELECT DISTINCT id, root_id, path, size_bytes, mtime_ns, quick_hash, content_hash FROM source_assets), m AS (SELECT * FROM s WHERE hash(id) IS NOT NULL AND mtime_ns % 3 <> 0)
SELECT s.id, CASE WHEN m.id IS NOT NULL AND m.size_bytes = s.size_bytes AND m.quick_hash = s.quick_hash AND coalesce(m.content_hash, '') <> '' THEN 'unchanged' ELSE 'changed' END AS action
FROM (SELECT id, any_value(root_id) AS root_id, any_value(path) AS path, any_value(size_bytes) AS size_bytes, any_value(mtime_ns) AS mtime_ns, any_value(quick_hash) AS quick_hash, any_value(content_hash) AS content_hash FROM s GROUP BY id) s
LEFT JOIN (SELECT id, any_value(size_bytes) AS size_bytes, any_value(quick_hash) AS quick_hash, any_value(content_hash) AS content_hash FROM m GROUP BY id) m ON m.id = s.id
"""
)
def manifest_skip(spark, d):
    """A scan against the manifest of the last one: unchanged files with a known hash are skipped."""
    columns = ["id", "size_bytes", "mtime_ns", "quick_hash", "content_hash"]
    scan = latest(table(spark, d, "source_assets").select(*columns, "updated_at"), "id", "updated_at").select(*columns)
    manifest = scan.where("mtime_ns % 3 <> 0").select(F.col("id").alias("mid"), F.col("size_bytes").alias("ms"), F.col("quick_hash").alias("mq"), F.col("content_hash").alias("mc"))
    same = F.col("mid").isNotNull() & (F.col("ms") == F.col("size_bytes")) & (F.col("mq") == F.col("quick_hash")) & (F.coalesce("mc", F.lit("")) != "")
    return scan.join(manifest, scan.id == manifest.mid, "left").select("id", F.when(same, "unchanged").otherwise("changed").alias("action"))


@query(
    """
WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'edited' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM b FULL JOIN c ON b.doc_id = c.doc_id WHERE b.h IS DISTINCT FROM c.h
"""
)
def snapshot_diff(spark, d):
    """Two snapshots of fingerprints: what was deleted, and what changed or was added."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    before = docs(spark, d).where("doc_id % 5 <> 0").select("doc_id", h.alias("hb"))
    after = docs(spark, d).where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "edited").otherwise(h).alias("ha"))
    both = before.join(after, "doc_id", "full_outer").where(~F.col("hb").eqNullSafe(F.col("ha")))
    return both.select("doc_id", F.when(F.col("ha").isNull(), "deleted").otherwise("changed").alias("change"))


QUERIES, SQL = query.queries, query.sql
