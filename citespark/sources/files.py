"""Paper files: intake by extension and size, content hash, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted file types and the size limit.
EXTENSIONS = [".pdf", ".docx", ".doc", ".txt", ".rtf"]
MAX_BYTES = 50 * 1024 * 1024


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as path, length and content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def classify_files(files: DataFrame) -> DataFrame:
    """Adds file name, extension and the reason of a refusal (NULL when accepted)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(F.col("filename"), r"(\.[^.]*)$", 1))
    reason = F.when(~F.col("extension").isin(EXTENSIONS), "file type not allowed").when(
        F.col("length") > MAX_BYTES, "file too large"
    )
    return (
        files.withColumn("filename", name).withColumn("extension", ext).withColumn("reason", reason)
    )


def ingest_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files with their hash, and refused ones with a reason."""
    rows = classify_files(files)
    good = rows.filter("reason IS NULL").withColumn("file_hash", F.sha2("content", 256)).drop("reason")
    return good, rows.filter("reason IS NOT NULL").drop("content")


def dedupe_by_hash(
    files: DataFrame, papers: DataFrame, order: str = "path"
) -> tuple[DataFrame, DataFrame]:
    """New paper rows (first file per hash) and an answer for every other file.

    Duplicates are files whose hash a paper has (``paper_id``) and later files of
    a hash that is new here: their ``paper_id`` is NULL, ``first_path`` names the
    file whose row they share. First means smallest ``order``; it is found by an aggregate that combines on
    the map side, so a hash shared by very many files is no hot spot.
    """
    known = papers.filter("file_hash IS NOT NULL").groupBy("file_hash").agg(
        F.min("paper_id").alias("paper_id")
    )
    first = files.groupBy("file_hash").agg(F.min(order).alias("_first"), F.min_by("filename", order).alias("title"))
    fresh = first.join(known, "file_hash", "left_anti").select(
        "title",
        "file_hash",
        F.col("_first").alias("file_path"),
        F.lit("upload").alias("source"),
        F.lit(False).alias("is_processed"),
    )
    marks = first.join(known, "file_hash", "left").select("file_hash", "paper_id", "_first")
    later = files.select("file_hash", F.col(order).alias("file_path")).join(marks, "file_hash")
    later = later.filter(F.col("paper_id").isNotNull() | (F.col("file_path") != F.col("_first")))
    own = F.when(F.col("paper_id").isNull(), F.col("_first"))
    return fresh, later.select("file_hash", "file_path", "paper_id", own.alias("first_path"))


def decode_text(files: DataFrame) -> DataFrame:
    """Text of plain-text files; other formats need a decoder given by the caller.

    A file that is not valid UTF-8 has no text and gets the error, like an empty one.
    """
    text = F.when(F.col("extension") == ".txt", F.try_validate_utf8(F.col("content").cast("string")))
    error = F.when(F.coalesce(F.col("full_text"), F.lit("")) == "", "Failed to extract text from file")
    return files.withColumn("full_text", text).withColumn("processing_error", error)
