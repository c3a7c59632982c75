"""Sinks: a search index table, immutable generations, content-addressed artifacts and pages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as X


def index_documents(rows: DataFrame, table: str, key: str, columns: list[str]) -> DataFrame:
    """Documents of a search index under stable ids."""
    return rows.select(H.document_id(F.lit(table), key).alias("document_id"), *columns)


def apply_feed(current: DataFrame, feed: DataFrame, key: str = "document_id", operation: str = "operation", at: str = "at") -> DataFrame:
    """The index after a feed of puts and removes: per id the last operation wins; ids without any stay."""
    rest = [c for c in feed.columns if c not in (key, operation, at)]
    last = feed.groupBy(key).agg(F.max(F.struct(at, operation, *rest)).alias("l")).select(key, F.col(f"l.{operation}").alias("_op"), *[f"l.{c}" for c in rest])
    kept = current.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("_op = 'put'").select(key, *rest), allowMissingColumns=True)


def write_generation(rows: DataFrame, folder: str, key: str) -> dict:
    """Writes an immutable generation and returns its receipt; it becomes current only by ``activate``.

    The checksum does not depend on the order or the partitioning of the rows.
    """
    name = uuid.uuid4().hex
    path = f"{folder}/generation={name}"
    rows.write.parquet(path)
    written = rows.sparkSession.read.parquet(path)
    columns = [F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in sorted(written.columns)]
    row = written.select(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"), F.count(F.lit(1)).alias("rows")).first()
    return {"generation": name, "path": path, "rows": row["rows"], "checksum": str(row["checksum"]), "key": key}


def activate(spark: SparkSession, folder: str, receipt: dict) -> None:
    """Points the store to a generation; the pointer is one small file, replaced as a whole."""
    spark.createDataFrame([(json.dumps(receipt, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_current")


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    receipt = json.loads(spark.read.text(f"{folder}/_current").first()[0])
    return spark.read.parquet(receipt["path"])


def store_artifacts(rows: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """Content under its hash, each content once, in folders by the hash's first two digits; gives the receipts."""
    hashed = rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    known = hashed.groupBy("sha256").agg(F.first(F.col(content)).alias("content")).withColumn("shard", F.substring("sha256", 1, 2))
    try:
        present = rows.sparkSession.read.parquet(folder).select("sha256")
        known = known.join(present, "sha256", "left_anti")
    except Exception as problem:  # noqa: BLE001 - a store that does not exist yet holds nothing
        if "PATH_NOT_FOUND" not in str(problem):
            raise
    known.write.mode("append").partitionBy("shard").parquet(folder)
    return hashed.drop(content)


def export_pages(rows: DataFrame, folder: str, title: str, body: str, limit: int | None = None) -> DataFrame:
    """One Markdown page per row under its slug, all of them unless ``limit`` bounds the export; equal slugs share a folder."""
    chosen = rows if limit is None else rows.orderBy(title, body).limit(limit)
    pages = chosen.select(X.slug(title).alias("slug"), F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))).alias("value"))
    pages.write.mode("overwrite").partitionBy("slug").text(folder, lineSep="\n")
    return pages
