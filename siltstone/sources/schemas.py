"""Schemas of the engine's tables, as DDL, with their creation and the fitting of foreign rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "monitored_roots": "id string, workspace_scope_id string, name string, root_path string, enabled boolean, recursive boolean, watch_enabled boolean, trust_rank int, include_globs array<string>, exclude_globs array<string>, max_inline_bytes int, heavy_threshold_bytes int, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "entities": "id string, type string, name string, attributes string, created_at timestamp_ntz",
    "source_assets": "id string, root_id string, source_id string, path string, uri string, file_kind string, mime_type string, extension string, size_bytes bigint, mtime_ns bigint, quick_hash string, content_hash string, canonical_asset_id string, extraction_status string, extraction_tier string, last_seen_at timestamp_ntz, indexed_at timestamp_ntz, deleted_at timestamp_ntz, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "asset_chunks": "id string, asset_id string, chunk_index int, title string, body string, modality string, locator string, token_estimate int, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "code_symbols": "id string, source_asset_id string, asset_chunk_id string, language string, symbol_kind string, name string, qualified_name string, path string, line_start int, line_end int, byte_start int, byte_end int, parent_symbol string, exported boolean, signature string, parser_status string, confidence double, scope_hash string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "episodes": "id string, source_id string, title string, summary string, source_kind string, metadata string, confidence double, usage_count int, superseded_by string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "parsed_email": "export_id string, profile_name string, source_folder string, subject string, sender string, recipients array<string>, message_id string, received_at string, text_body string, html_body string, attachments array<struct<filename:string,content_type:string>>, exported_at_epoch bigint",
    "model_activity_events": "id string, service string, endpoint string, action string, activity_class string, caller_surface string, model string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, duration_ms int, error_class string, error_message string, metadata string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, captured_at timestamp_ntz",
    "eval_items": "item_id bigint, case_key string, category string, query string, passage string, split string, expected_scope string, created_at timestamp_ntz",
}
#: Columns by which large tables are laid out, so that joins on them meet without a shuffle.
BUCKETS = {"asset_chunks": "asset_id", "source_assets": "id", "code_symbols": "source_asset_id"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def create_tables(spark: SparkSession, database: str, buckets: int = 0) -> list[str]:
    """Creates the tables that are missing, bucketed by their join keys if ``buckets`` is given; what exists stays as it is."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        laid = f" CLUSTERED BY ({BUCKETS[name]}) INTO {buckets} BUCKETS" if buckets and name in BUCKETS else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet{laid}")
    return list(TABLES)


def conform(frame: DataFrame, name: str) -> DataFrame:
    """The rows in the table's columns, order and types: missing columns are null, values that do not fit become null, further columns go."""
    known = {f.name: f.dataType for f in frame.schema.fields}

    def fitted(field: T.StructField):
        if field.name not in known:
            return F.lit(None).cast(field.dataType).alias(field.name)
        same = known[field.name] == field.dataType
        column = F.col(f"`{field.name}`")
        return column if same else column.try_cast(field.dataType).alias(field.name)

    return frame.select(*[fitted(f) for f in schema(name).fields])
