"""Listing, searching and paging of papers and documents; library statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import contains_pattern, word_count

CHUNK_ESTIMATE_WORDS = 500
RETRY_MINUTES = 30


def search_papers(papers: DataFrame, needle: str) -> DataFrame:
    """Substring of title, abstract or the authors as text, case-insensitive."""
    return papers.filter(
        contains_pattern(F.col("title"), needle)
        | F.coalesce(contains_pattern(F.col("abstract"), needle), F.lit(False))
        | F.coalesce(contains_pattern(F.to_json("authors"), needle), F.lit(False))
    )


def has_error() -> Column:
    return F.coalesce(F.col("processing_error"), F.lit("")) != ""


def status_filter(papers: DataFrame, status: str) -> DataFrame:
    """indexed, processing or error; an empty error text counts as an error here."""
    conditions = {
        "indexed": F.col("is_processed"),
        "processing": ~F.col("is_processed") & F.col("processing_error").isNull(),
        "error": F.col("processing_error").isNotNull(),
    }
    return papers.filter(conditions[status])


def status_column() -> Column:
    """Status as shown: indexed wins, then a non-empty error, else processing."""
    return F.when(F.col("is_processed"), "indexed").when(has_error(), "error").otherwise("processing")


def has_pdf(file_path: Column) -> Column:
    """True for a '.pdf' extension; a name that is only dots and an extension has none."""
    name = F.regexp_extract(file_path, r"([^/]*)$", 1)
    return F.coalesce(F.lower(name).rlike(r"[^.].*\.pdf$"), F.lit(False))


def estimated_chunks(is_processed: Column, text: Column) -> Column:
    """At least one per processed text, one per 500 words; 0 otherwise."""
    n = F.greatest(F.lit(1), F.floor(word_count(text) / CHUNK_ESTIMATE_WORDS))
    usable = is_processed & (F.coalesce(text, F.lit("")) != "")
    return F.when(usable, n).otherwise(0).cast("int")


def visible_documents(documents: DataFrame, user_id=None, public_only: bool = False) -> DataFrame:
    """Own or public documents of a user; public ones only without a user."""
    if user_id is None or public_only:
        return documents.filter("is_public")
    return documents.filter((F.col("owner_id") == user_id) | F.col("is_public"))


def search_documents(documents: DataFrame, needle: str) -> DataFrame:
    return documents.filter(
        contains_pattern(F.col("title"), needle)
        | F.coalesce(contains_pattern(F.col("description"), needle), F.lit(False))
    )


def by_share_token(documents: DataFrame, token: str) -> DataFrame:
    return documents.filter(F.col("is_public") & (F.col("share_token") == token))


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def pending_papers(papers: DataFrame, as_of: str, retry_minutes: int = RETRY_MINUTES) -> DataFrame:
    """Papers with a file to process: never failed, or failed long enough ago."""
    cutoff = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{retry_minutes}' MINUTE")
    return papers.filter(
        F.col("file_path").isNotNull()
        & ~F.col("is_processed")
        & (~has_error() | (F.col("updated_at") < cutoff))
    )


def next_batch(papers: DataFrame, size: int = 5) -> DataFrame:
    """Error-free papers first; failed ones only when no error-free paper is left."""
    open_papers = papers.filter(F.col("file_path").isNotNull() & ~F.col("is_processed"))
    best = open_papers.agg(F.min(has_error().cast("int"))).scalar()
    return open_papers.filter(has_error().cast("int") == best).orderBy("paper_id").limit(size)


def _matches_words(needle: str, columns: list[Column], authors: Column) -> Column:
    low = needle.lower()
    tests = [F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False)) for c in columns]
    tests.append(
        F.coalesce(F.exists(authors, lambda a: F.contains(F.lower(a), F.lit(low))), F.lit(False))
    )
    return reduce(lambda a, b: a | b, tests)


def filter_library(papers: DataFrame, needle: str = "", status: str | None = None) -> DataFrame:
    """Shown status, and title or any author containing the text literally."""
    out = papers if status is None else papers.filter(status_column() == status)
    return out.filter(_matches_words(needle, [F.col("title")], F.col("authors"))) if needle else out


def assignable_papers(
    papers: DataFrame, assignments: DataFrame, document_id, needle: str = ""
) -> DataFrame:
    """Indexed papers the document does not hold yet, filtered by text."""
    taken = assignments.filter(F.col("document_id") == document_id).select("paper_id")
    free = papers.filter("is_processed").join(taken, "paper_id", "left_anti")
    if not needle:
        return free
    return free.filter(_matches_words(needle, [F.col("title"), F.col("journal")], F.col("authors")))


def filter_papers(
    papers: DataFrame, *, tag: str | None = None, year: int | None = None, tags: DataFrame | None = None
) -> DataFrame:
    """Papers of one year and/or with a tag in a library (``tags``: paper_id, tags)."""
    out = papers if year is None else papers.filter(F.col("year") == year)
    if tag is not None:
        tagged = tags.filter(F.array_contains("tags", tag)).select("paper_id")
        out = out.join(tagged, "paper_id", "left_semi")
    return out


def with_embedding(table: DataFrame) -> DataFrame:
    return table.filter(F.col("embedding").isNotNull())


def from_source(papers: DataFrame, source: str) -> DataFrame:
    return papers.filter(F.col("source") == source)


def patch_rows(table: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New snapshot with the set fields of a patch table.

    ``patches`` holds the key, new values and a boolean ``set_<field>`` for each
    field, so that NULL can be a new value. Of several patches that set a field of
    one row the largest value counts.
    """
    chosen = [F.max(F.struct(F.when(F.col(f"set_{f}"), F.struct(f)).alias("v")))["v"].alias(f"_set_{f}") for f in fields]
    p = patches.groupBy(key).agg(*chosen).select(
        key, *[F.col(f"_set_{f}")[f].alias(f"_new_{f}") for f in fields],
        *[F.col(f"_set_{f}").isNotNull().alias(f"set_{f}") for f in fields],
    )
    out = table.join(p, key, "left")
    for f in fields:
        flag = F.coalesce(F.col(f"set_{f}"), F.lit(False))
        out = out.withColumn(f, F.when(flag, F.col(f"_new_{f}")).otherwise(F.col(f)))
    return out.select(*table.columns)


def page(
    table: DataFrame, order: str, key: str, skip: int = 0, limit: int = 50, descending: bool = True
) -> DataFrame:
    """One page in a stable order (ties by key)."""
    first = F.desc(order) if descending else F.asc(order)
    return table.orderBy(first, F.col(key)).offset(skip).limit(limit)


def page_after(
    table: DataFrame, order: str, key: str, last_order, last_key, limit: int = 50
) -> DataFrame:
    """The page after a known row; deep pages cost no more than the first."""
    after = (F.col(order) < last_order) | ((F.col(order) == last_order) & (F.col(key) > last_key))
    return table.filter(after).orderBy(F.desc(order), F.col(key)).limit(limit)


def page_totals(table: DataFrame, limit: int) -> DataFrame:
    """Row count and number of pages, 0 pages for no rows."""
    return table.agg(F.count("*").alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / limit).cast("long")
    )


def sort_library(papers: DataFrame, by: str = "date", collation: str = "UNICODE") -> DataFrame:
    """date (newest first), title (by collation) or citations (most first, NULL as 0)."""
    if by == "date":
        return papers.orderBy(F.desc("created_at"), "paper_id")
    if by == "title":
        return papers.orderBy(F.collate("title", collation), "paper_id")
    return papers.orderBy(F.desc(F.coalesce("citation_count", F.lit(0))), "paper_id")


def most_recent(papers: DataFrame, n: int = 5) -> DataFrame:
    return papers.orderBy(F.desc("created_at"), "paper_id").limit(n)


# statistics -----------------------------------------------------------------


def queue_status(papers: DataFrame) -> DataFrame:
    """Papers with a file: total, processed, failed, pending, share processed."""
    counts = papers.filter(F.col("file_path").isNotNull()).agg(
        F.count("*").alias("total"),
        F.count_if("is_processed").alias("processed"),
        F.count_if(has_error()).alias("failed"),
    )
    share = F.when(F.col("total") > 0, F.col("processed") / F.col("total") * 100).otherwise(0.0)
    return counts.withColumn("pending", F.col("total") - F.col("processed")).withColumn(
        "progress_percentage", share
    )


def processing_statistics(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts over papers with a file, the chunk count, and the progress in percent."""
    one = papers.filter(F.col("file_path").isNotNull()).agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col("is_processed"), 1).otherwise(0)).alias("processed"),
        F.sum(F.when(has_error(), 1).otherwise(0)).alias("errors"),
        F.sum(F.when(~F.col("is_processed") & ~has_error(), 1).otherwise(0)).alias("pending"),
    )
    n = chunks.agg(F.count("*")).scalar()
    share = F.when(F.col("total") > 0, F.col("processed") * 100.0 / F.col("total")).otherwise(0.0)
    return one.withColumn("chunks", n).withColumn("progress", share)


def counts_by_processed(papers: DataFrame) -> DataFrame:
    return papers.groupBy("is_processed").agg(
        F.count("*").alias("papers"), F.count("processing_error").alias("errors")
    )


def duplicate_titles(papers: DataFrame, top: int | None = 5) -> DataFrame:
    found = papers.groupBy("title").agg(F.count("*").alias("copies")).filter("copies > 1")
    return found if top is None else found.orderBy(F.desc("copies"), "title").limit(top)


def embedding_coverage(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows with and without a vector, per table."""

    def one(name: str, table: DataFrame) -> DataFrame:
        have = F.col("embedding").isNotNull()
        return table.agg(
            F.lit(name).alias("table_name"),
            F.count_if(have).alias("with_embedding"),
            F.count_if(~have).alias("without_embedding"),
        )

    return one("papers", papers).unionByName(one("chunks", chunks))


def user_papers(papers: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Papers with the users that synchronised them."""
    return papers.join(sync_state.select("user_id", "paper_id").distinct(), "paper_id")


def user_processing_status(papers: DataFrame, sync_state: DataFrame) -> DataFrame:
    out = user_papers(papers, sync_state).groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("file_path"), F.lit("")) != "").alias("with_file"),
        F.count_if("is_processed").alias("processed"),
        F.count_if(has_error()).alias("errors"),
    )
    return out.withColumn("remaining", F.col("total") - F.col("processed") - F.col("errors"))


def paper_categories(papers: DataFrame) -> DataFrame:
    """no file / processed / error / unprocessed."""
    kind = (
        F.when(F.coalesce(F.col("file_path"), F.lit("")) == "", "no_file")
        .when(F.col("is_processed"), "processed")
        .when(has_error(), "error")
        .otherwise("unprocessed")
    )
    return papers.groupBy(kind.alias("category")).agg(F.count("*").alias("papers"))


def orphan_papers(papers: DataFrame, sync_state: DataFrame) -> DataFrame:
    return papers.join(sync_state.select("paper_id"), "paper_id", "left_anti")

