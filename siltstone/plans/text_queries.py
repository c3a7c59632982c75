"""Queries over text, hash, redaction and path expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import paths as P
from siltstone.functions import text as X
from siltstone.functions.scores import first_failing, range_label
from siltstone.plans.registry import Registry
from siltstone.tables import table

query = Registry()


def documents(spark, d):
    return table(spark, d, "documents")


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS stripped FROM documents")
def strip_text(spark, d):
    return documents(spark, d).select("doc_id", F.length(X.strip("text")).cast("long").alias("stripped"))


@query("SELECT doc_id, greatest(1, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))) AS words FROM documents")
def word_count(spark, d):
    return documents(spark, d).select("doc_id", X.token_estimate("text").cast("long").alias("words"))


_CHUNK_SQL = """
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, regexp_replace(substring(t, CAST(i * {n} + 1 AS BIGINT), {n}), '^\\s+|\\s+$', '', 'g') AS body,
       concat('char:', i * {n}, '-', least((i + 1) * {n}, length(t))) AS locator
FROM (SELECT doc_id, t, unnest(range(0, (length(t) + {n} - 1) // {n})) AS i
      FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) > 0)
WHERE length(regexp_replace(substring(t, CAST(i * {n} + 1 AS BIGINT), {n}), '^\\s+|\\s+$', '', 'g')) > 0
"""


def chunks(frame, key, text, size):
    """Fixed windows of ``size`` code points over the stripped text, each stripped; blank windows keep their number free."""
    stripped = frame.where(F.col(text).isNotNull()).select(key, X.strip(text).alias("t")).where(F.length("t") > 0)
    starts = stripped.select(key, "t", F.explode(X.chunk_starts("t", size)).alias("s"))
    cut = starts.select(
        key,
        (F.col("s") / size).cast("int").alias("chunk_index"),
        X.strip(F.substring("t", F.col("s") + 1, F.lit(size))).alias("body"),
        F.concat(F.lit("char:"), "s", F.lit("-"), F.least(F.col("s") + size, F.length("t"))).alias("locator"),
    )
    return cut.where(F.length("body") > 0)


@query(_CHUNK_SQL.format(n=4000))
def chunk_4000(spark, d):
    return chunks(documents(spark, d), "doc_id", "text", 4000)


@query(_CHUNK_SQL.format(n=2048))
def chunk_2048(spark, d):
    return chunks(documents(spark, d), "doc_id", "text", 2048)


_TERMS = "list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9_.-]*'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: length(t) >= 2)"


@query(f"SELECT item_id, term FROM (SELECT DISTINCT item_id, unnest({_TERMS.format(c='query')}) AS term FROM eval_items)")
def query_terms(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.explode(X.query_terms("query")).alias("term"))


@query(
    """
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, length(t) AS n, coalesce(list_min(list_filter([instr(lower(t), 'watcher'), instr(lower(t), 'queue')], lambda x: x > 0)), 1) - 1 AS f FROM c),
s AS (SELECT *, greatest(0, least(f - 60, n - 240)) AS st FROM p)
SELECT doc_id, CASE WHEN n <= 240 THEN t ELSE concat(CASE WHEN st > 0 THEN '...' ELSE '' END, regexp_replace(substring(t, st + 1, 240), '^\\s+|\\s+$', '', 'g'), CASE WHEN st + 240 < n THEN '...' ELSE '' END) END AS snippet FROM s
"""
)
def snippet_window(spark, d):
    terms = F.array(F.lit("watcher"), F.lit("queue"))
    clean = documents(spark, d).where("text is not null").select("doc_id", X.collapse_space("text").alias("clean"))
    return clean.select("doc_id", "clean", F.lower("clean").alias("lower")).select("doc_id", X.snippet("clean", "lower", terms).alias("snippet"))


@query(
    "SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE concat(substring(t, 1, 280), '…') END AS snippet FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)"
)
def native_snippet(spark, d):
    clean = documents(spark, d).where("text is not null").select("doc_id", X.collapse_space("text").alias("clean"))
    return clean.select("doc_id", X.short_snippet("clean").alias("snippet"))


@query("SELECT export_id, sha256(regexp_replace(text_body, '\\r\\n?', chr(10), 'g')) AS body_hash FROM (SELECT DISTINCT export_id, text_body FROM parsed_email) WHERE text_body IS NOT NULL")
def newline_normalise(spark, d):
    mails = table(spark, d, "parsed_email").select("export_id", "text_body").distinct()
    return mails.where("text_body is not null").select("export_id", H.sha(X.newline_normalise("text_body")).alias("body_hash"))


@query("SELECT doc_id, sha256(substring(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), 1, 12000)) AS body_hash FROM documents WHERE text IS NOT NULL")
def control_char_cleanup(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", H.sha(X.bound(X.clean_controls("text"), 12000)).alias("body_hash"))


@query("SELECT doc_id, replace(text, chr(0), '') = text AS clean FROM documents WHERE text IS NOT NULL")
def nul_strip(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", (X.strip_nul("text") == F.col("text")).alias("clean"))


@query("SELECT doc_id, regexp_matches(array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)), '(?i)@generated|auto-?generated|code generated by|do not edit|generated by .* do not modify') AS generated FROM documents WHERE text IS NOT NULL")
def generated_marker(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", X.generated_marker("text").alias("generated"))


@query(
    """SELECT DISTINCT export_id, concat_ws(' | ', 'From: ' || (coalesce(nullif(regexp_extract(sender, '<([^<>]+)>', 1), ''), sender)), 'To: ' || array_to_string(recipients, ', '), 'Received: ' || received_at) AS summary FROM parsed_email"""
)
def mail_summary(spark, d):
    """Address, recipients and time of a mail in one line; missing parts are left out."""
    address = F.coalesce(F.nullif(F.regexp_extract("sender", "<([^<>]+)>", 1), F.lit("")), F.col("sender"))
    parts = [F.concat(F.lit("From: "), address), F.concat(F.lit("To: "), F.array_join("recipients", ", ")), F.concat(F.lit("Received: "), "received_at")]
    return table(spark, d, "parsed_email").select("export_id", F.concat_ws(" | ", *parts).alias("summary")).distinct()


@query(
    """SELECT item_id, CASE WHEN length(trim(query)) = 0 THEN 'empty_prompt' WHEN starts_with(trim(query), '/') THEN 'slash_command' WHEN length(trim(query)) < 60 THEN 'prompt_too_short' WHEN lower(trim(query)) IN ('ok', 'thanks', 'yes') THEN 'trivial_prompt' END AS reason FROM eval_items"""
)
def skip_reason(spark, d):
    q = F.trim("query")
    reason = first_failing((F.length(q) > 0, "empty_prompt"), (~q.startswith("/"), "slash_command"), (F.length(q) >= 60, "prompt_too_short"), (~F.lower(q).isin("ok", "thanks", "yes"), "trivial_prompt"))
    return table(spark, d, "eval_items").select("item_id", reason.alias("reason"))


@query("SELECT DISTINCT id, coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72), '-+$', ''), ''), 'memory') AS slug FROM episodes")
def wiki_slug(spark, d):
    return table(spark, d, "episodes").select("id", X.slug("title").alias("slug")).distinct()


# ------------------------------------------------------------------ hashes


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", H.sha("text").alias("content_hash"))


@query("SELECT DISTINCT id, sha256(concat_ws(':', regexp_extract(replace(path, chr(92), '/'), '[^/]*$'), size_bytes, mtime_ns)) AS quick FROM source_assets")
def quick_hash(spark, d):
    return table(spark, d, "source_assets").select("id", H.quick_hash(P.leaf("path"), "size_bytes", "mtime_ns").alias("quick")).distinct()


@query("SELECT doc_id, sha256(concat_ws(chr(0), 'token-hash', '256', sha256(text))) AS cache_key FROM documents WHERE text IS NOT NULL")
def cache_key(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", H.cache_key(F.lit("token-hash"), 256, "text").alias("cache_key"))


@query("SELECT DISTINCT regexp_replace(concat_ws('--', 'source_assets', coalesce(source_id, path)), '[^A-Za-z0-9_-]', '_', 'g') AS document_id FROM source_assets")
def document_id(spark, d):
    return table(spark, d, "source_assets").select(H.document_id(F.lit("source_assets"), F.coalesce("source_id", "path")).alias("document_id")).distinct()


@query("SELECT event_id, sha256(concat_ws(chr(0), event_type, CAST(user_id AS VARCHAR), coalesce(json_extract_string(props, '$.k'), ''))) AS identity FROM events")
def job_identity(spark, d):
    return table(spark, d, "events").select("event_id", H.job_identity("event_type", "user_id", F.get_json_object("props", "$.k")).alias("identity"))


@query("SELECT item_id, concat('sha256:', sha256(query)) AS query_hash FROM eval_items")
def query_hash(spark, d):
    return table(spark, d, "eval_items").select("item_id", H.query_hash("query").alias("query_hash"))


# ------------------------------------------------------------------ redaction


@query(
    """SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\\bsk-[A-Za-z0-9_-]{20,}\\b', '[REDACTED:openai_api_key]', 'g'), '(?i)\\b(password|passwd|pwd)(\\s*[:=]\\s*)([^\\s;,''"]+)', '\\1\\2[REDACTED:password_assignment]', 'g')) AS redacted
FROM documents WHERE text IS NOT NULL"""
)
def redact_secrets(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", H.sha(X.redact_secrets("text")).alias("redacted"))


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_MAIL}')) AS found, sha256(regexp_replace(text, '{_MAIL}', '[REDACTED:email]', 'g')) AS redacted FROM documents WHERE text IS NOT NULL")
def redact_email(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", F.regexp_count("text", F.lit(_MAIL)).cast("long").alias("found"), H.sha(X.redact_emails("text")).alias("redacted"))


@query(
    """SELECT id, regexp_replace(error_message, '(?i)\\b(password|secret|token|api_key|authorization|credential)(\\s*[:=]\\s*)(\\S+)', '\\1\\2***', 'g') AS message
FROM (SELECT DISTINCT id, error_message FROM model_activity_events WHERE error_message IS NOT NULL)"""
)
def redact_assignment(spark, d):
    rows = table(spark, d, "model_activity_events").where("error_message is not null").select("id", "error_message").distinct()
    return rows.select("id", X.redact_assignments("error_message").alias("message"))


@query(
    """SELECT event_id, k AS key, left(v, 200) AS value FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events) t, LATERAL (SELECT json_extract_string(props, concat('$.', k)) AS v)
WHERE NOT regexp_matches(lower(k), 'raw|body|content|text|prompt|query|snippet|error|token|secret|password')"""
)
def metadata_sanitise(spark, d):
    """Metadata entries without payloads and secrets, values cut to 200 characters, in long form."""
    rows = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.where(~F.lower("key").rlike("raw|body|content|text|prompt|query|snippet|error|token|secret|password")).select("event_id", "key", F.substring("value", 1, 200).alias("value"))


# ------------------------------------------------------------------ paths


@query(
    """SELECT DISTINCT id, regexp_extract(p, '[^/]*$') AS leaf, regexp_replace(regexp_extract(p, '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS stem, lower(regexp_extract(regexp_extract(p, '[^/]*$'), '.(\\.[^.]+)$', 1)) AS ext
FROM (SELECT id, replace(path, chr(92), '/') AS p FROM source_assets)"""
)
def path_parts(spark, d):
    return table(spark, d, "source_assets").select("id", P.leaf("path").alias("leaf"), P.stem("path").alias("stem"), P.extension("path").alias("ext")).distinct()


def _kind_sql() -> str:
    cases = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in extensions.split())}) THEN '{name}'" for name, extensions in P.KINDS.items())
    return f"""
WITH a AS (SELECT DISTINCT id, size_bytes, lower(regexp_extract(regexp_extract(replace(path, chr(92), '/'), '[^/]*$'), '.(\\.[^.]+)$', 1)) AS ext FROM source_assets),
k AS (SELECT id, size_bytes, CASE {cases} ELSE 'binary' END AS kind FROM a)
SELECT id, kind, CASE WHEN kind IN ({", ".join(repr(k) for k in P.DEFERRED)}) OR size_bytes > {P.HEAVY_BYTES} THEN 'deferred' WHEN kind IN ('text', 'code') AND size_bytes <= {P.INLINE_BYTES} THEN 'inline' ELSE 'metadata_only' END AS tier FROM k
"""


@query(_kind_sql())
def file_kind(spark, d):
    assets = table(spark, d, "source_assets").select("id", "size_bytes", P.file_kind("path").alias("kind")).distinct()
    return assets.select("id", "kind", P.tier(F.col("kind"), F.col("size_bytes")).alias("tier"))


@query(
    """SELECT DISTINCT id, CASE WHEN regexp_matches(p, '/keep\\.py$') THEN true WHEN contains(concat('/', p), '/node_modules/') THEN false WHEN regexp_matches(p, '\\.min\\.js$') THEN false
WHEN regexp_matches(p, '\\.(py|js)$') THEN true ELSE false END AS included FROM (SELECT id, replace(path, chr(92), '/') AS p FROM source_assets)"""
)
def glob_include(spark, d):
    """Order-sensitive include and exclude patterns; the last one that matches decides."""
    state = P.included("path", ["*.py", "*.js"], ["*.min.js", "**/node_modules/", "!*/keep.py"])
    return table(spark, d, "source_assets").select("id", state.alias("included")).distinct()


@query("SELECT DISTINCT id FROM source_assets WHERE NOT regexp_matches(concat('/', replace(path, chr(92), '/')), '/(node_modules|vendor|third_party|__pycache__|\\.git)/')")
def dir_prune(spark, d):
    """Files below none of the pruned folders."""
    parts = F.split(P.folder("path"), "/")
    pruned = F.exists(parts, lambda p: p.isin("node_modules", "vendor", "third_party", "__pycache__", ".git"))
    return table(spark, d, "source_assets").where(~F.coalesce(pruned, F.lit(False))).select("id").distinct()


@query("SELECT DISTINCT id FROM source_assets WHERE replace(path, chr(92), '/') LIKE '%/src/%' ESCAPE '!' AND path LIKE '%!_%' ESCAPE '!'")
def glob_like(spark, d):
    """A glob rewritten to LIKE with its own characters escaped."""
    p = P.normal("path")
    return table(spark, d, "source_assets").where(F.expr("replace(path, '\\\\', '/') like '%/src/%'") & F.expr("path like '%!_%' escape '!'") & p.isNotNull()).select("id").distinct()


@query(
    """
WITH r AS (SELECT name, lower(regexp_replace(replace(root_path, chr(92), '/'), '/+$', '')) AS rp FROM monitored_roots WHERE enabled),
a AS (SELECT DISTINCT s.id, lower(concat(regexp_replace(replace(m.root_path, chr(92), '/'), '/+$', ''), '/', replace(s.path, chr(92), '/'))) AS p FROM source_assets s JOIN monitored_roots m ON m.id = s.root_id)
SELECT a.id, arg_max(r.name, length(r.rp) * 1000 + length(r.name)) AS root FROM a JOIN r ON a.p = r.rp OR starts_with(a.p, concat(r.rp, '/')) GROUP BY a.id
"""
)
def longest_prefix_root(spark, d):
    """The enabled root with the longest path that contains a file: an equi join on the prefixes of the file's folder."""
    roots = table(spark, d, "monitored_roots")
    plain = F.regexp_replace(P.normal("root_path"), "/+$", "")
    assets = table(spark, d, "source_assets").join(roots.select(F.col("id").alias("root_id"), plain.alias("base")), "root_id")
    full = assets.select("id", F.lower(F.concat("base", F.lit("/"), P.normal("path"))).alias("p")).distinct()
    parts = F.split("p", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    candidates = full.select("id", F.explode(prefixes).alias("prefix"))
    enabled = roots.where("enabled").select("name", F.lower(plain).alias("prefix"))
    best = F.max_by("name", F.length("prefix") * 1000 + F.length("name"))
    return candidates.join(enabled, "prefix").groupBy("id").agg(best.alias("root"))


@query("SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars < 256 THEN '0-255' WHEN n_chars < 1024 THEN '256-1023' WHEN n_chars < 4096 THEN '1024-4095' ELSE '4096+' END AS bucket FROM documents")
def shape_bucket(spark, d):
    return documents(spark, d).select("doc_id", range_label(F.col("n_chars"), [256, 1024, 4096]).alias("bucket"))


@query(
    """
WITH once AS (SELECT id, min(received_at) AS raw FROM (SELECT export_id AS id, received_at FROM parsed_email) GROUP BY id)
SELECT id, CAST(coalesce(try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(raw, '%Y-%m-%dT%H:%M:%S'), try_strptime(raw, '%d.%m.%Y %H:%M'), try_strptime(raw, '%Y-%m-%d %H:%M:%S')) AS VARCHAR) AS at FROM once
"""
)
def timestamp_parse(spark, d):
    """Times in several notations; null where none fits."""
    once = table(spark, d, "parsed_email").groupBy(F.col("export_id").alias("id")).agg(F.min("received_at").alias("raw"))
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd HH:mm:ss"]
    parsed = F.coalesce(*[F.try_to_timestamp("raw", F.lit(f)) for f in forms])
    return once.select("id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(name="token_hash_embedding")
def token_hash_embedding(spark, d):
    return documents(spark, d).select("doc_id", H.token_hash_embedding("text").alias("embedding"))


@query(name="nfkc_text")
def nfkc_text(spark, d):
    return documents(spark, d).select("doc_id", H.sha(H.nfkc("text")).alias("hash"))


def _html_sql() -> str:
    body = "html_body"
    for tag in ("script", "style", "noscript", "svg", "head"):
        body = f"regexp_replace({body}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    body = f"regexp_replace({body}, '(?s)<!--.*?-->|<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        body = f"replace({body}, '{entity}', '{char}')"
    return f"SELECT DISTINCT export_id, trim(regexp_replace({body}, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS text FROM parsed_email WHERE html_body IS NOT NULL"


@query(_html_sql())
def html_text(spark, d):
    return table(spark, d, "parsed_email").where("html_body is not null").select("export_id", X.html_text("html_body").alias("text")).distinct()


QUERIES, SQL = query.queries, query.sql
