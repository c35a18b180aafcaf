"""Items of a reference-manager library as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions.identifiers import item_year
from citespark.functions.text import empty_to_null

ITEM_SCHEMA = (
    "key string, version int, library_id string, data struct<itemType:string, title:string, "
    "creators:array<struct<creatorType:string,firstName:string,lastName:string>>, abstractNote:string, "
    "date:string, dateAdded:string, publicationTitle:string, bookTitle:string, DOI:string, url:string, "
    "collections:array<string>, contentType:string, parentItem:string>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item records, one JSON object per line, with a fixed schema."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def split_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paper items, and PDF attachments with a parent; notes and other files drop out."""
    kind = F.coalesce(F.col("data.itemType"), F.lit(""))
    pdf = (
        (kind == "attachment")
        & (F.col("data.contentType") == "application/pdf")
        & (F.coalesce(F.col("data.parentItem"), F.lit("")) != "")
    )
    return items.filter(~kind.isin("attachment", "note")), items.filter(pdf)


def author_names(creators):
    """'first last' of author creators; the last name alone without a first one."""
    authors = F.filter(creators, lambda c: c["creatorType"] == "author")

    def name(c):
        first, last = (F.coalesce(c[n], F.lit("")) for n in ("firstName", "lastName"))
        return F.when(first != "", F.trim(F.concat(first, F.lit(" "), last))).otherwise(last)

    names = F.filter(F.transform(authors, name), lambda n: n != "")
    return F.coalesce(names, F.array().cast("array<string>"))


def map_items(items: DataFrame, source: str = "zotero") -> DataFrame:
    """Paper columns of library items."""
    d = lambda c: F.col(f"data.{c}")
    keep = [c for c in ("seq", "library_id") if c in items.columns]
    return items.select(
        F.coalesce("key", F.lit("")).alias("item_key"),
        F.coalesce("version", F.lit(0)).alias("version"),
        *keep,
        F.coalesce(d("title"), F.lit("")).alias("title"),
        author_names(d("creators")).alias("authors"),
        empty_to_null(d("abstractNote")).alias("abstract"),
        item_year(d("date"), d("dateAdded")).alias("year"),
        F.coalesce(empty_to_null(d("publicationTitle")), empty_to_null(d("bookTitle"))).alias("journal"),
        empty_to_null(d("DOI")).alias("doi"),
        empty_to_null(d("url")).alias("source_url"),
        F.lit(source).alias("source"),
        F.lit(0).alias("citation_count"),
    )


def map_attachments(attachments: DataFrame) -> DataFrame:
    keep = [c for c in ("seq",) if c in attachments.columns]
    return attachments.select(
        F.col("data.parentItem").alias("parent_key"), F.col("key").alias("attachment_key"), *keep
    )
