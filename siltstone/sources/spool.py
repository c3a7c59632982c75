"""Mail spools: one folder per exported message, with a manifest beside its bodies and attachments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import files

MANIFEST = "export_id string, profile_name string, source_folder string, subject string, sender string, recipients array<string>, message_id string, received_at string, exported_at_epoch bigint"


def read_spool(spark: SparkSession, folder: str) -> DataFrame:
    """The exported messages below ``folder``, one row each, with the names of their attachments.

    A folder without a readable manifest, one still being written for example, gives no row; a
    missing body is null. Attachments are listed, not read.
    """
    known = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    part = F.regexp_replace("path", "/(?:attachments/)?[^/]+$", "")
    told = known.option("pathGlobFilter", "{manifest.json,body.txt,body.html}").load(folder).select(part.alias("place"), F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("text"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    mails = told.groupBy("place").agg(F.from_json(of("manifest.json"), MANIFEST).alias("m"), of("body.txt").alias("text_body"), of("body.html").alias("html_body"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.col("path").rlike("/attachments/[^/]+$"))
    attached = listed.groupBy(part.alias("place")).agg(F.array_sort(F.collect_list(F.substring_index("path", "/", -1))).alias("attachments"))
    found = mails.where("m.export_id is not null").join(attached, "place", "left")
    return found.select("m.*", "text_body", "html_body", F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments"))


EXPORT = "path string, number int, message_id string, subject string, sender string, recipients array<string>, received_at string, text_body string, html_body string, attachments array<struct<filename:string,content_type:string>>"


def exported(mail_files: DataFrame, profile: str, source_folder: str) -> DataFrame:
    """The rows of parsed_email for the messages of mail files (path, content).

    The export id is a hash of profile, folder and message id (or the place in its file where it
    has none), so exporting again gives the same ids and a keyed merge changes nothing.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for number, message in enumerate(files.messages(bytes(content) if content is not None else b""), 1):
                    text, html = files.mail_bodies(message)
                    parts = [{"filename": p.get_filename() or "", "content_type": p.get_content_type()} for p in message.walk() if p.get_content_disposition() == "attachment"]
                    people = [a.strip() for name in ("To", "Cc") for a in files.header(message, name).split(",") if a.strip()]
                    row = (path, number, files.header(message, "Message-ID") or None, files.header(message, "Subject"), files.header(message, "From"), people, files.header(message, "Date") or None, text, html, parts)
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in "path,number,message_id,subject,sender,recipients,received_at,text_body,html_body,attachments".split(",")])

    rows = mail_files.select("path", "content").mapInPandas(parse, EXPORT)
    name = F.coalesce("message_id", F.concat_ws("#", "path", "number"))
    key = F.sha2(F.concat_ws("\x1f", F.lit(profile), F.lit(source_folder), name), 256)
    return rows.select(key.alias("export_id"), F.lit(profile).alias("profile_name"), F.lit(source_folder).alias("source_folder"), "subject", "sender", "recipients", "message_id", "received_at", "text_body", "html_body", "attachments")
