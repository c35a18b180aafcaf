"""Listing, statistics, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from citespark.functions import text as tx
from citespark.operators import library as lb
from citespark.operators import logs as lg
from suite import sqltext as q
from suite.registry import query

_ERR = "coalesce(processing_error, '') <> ''"
_STATUS = f"CASE WHEN is_processed THEN 'indexed' WHEN {_ERR} THEN 'error' ELSE 'processing' END"


@query("read_table", "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND n_chars > 500")
def read_table(t):
    from citespark.sources.tables import read_table as scan

    table = scan(t.spark, f"{t.sf_dir}/documents.parquet")
    return table.filter((F.col("lang") == "de") & (F.col("n_chars") > 500)).select("doc_id", "n_chars")


@query(
    "search_papers",
    """SELECT paper_id FROM papers WHERE title ILIKE '%an_ar%' OR abstract ILIKE '%an_ar%'
  OR array_to_string(authors, '|') ILIKE '%an_ar%'""",
    "papers",
)
def search_papers(t):
    return lb.search_papers(t.papers, "an_ar").select("paper_id")


@query(
    "paper_status_filters",
    """SELECT paper_id, 'indexed' AS list FROM papers WHERE is_processed
UNION ALL SELECT paper_id, 'processing' FROM papers WHERE NOT is_processed AND processing_error IS NULL
UNION ALL SELECT paper_id, 'error' FROM papers WHERE processing_error IS NOT NULL""",
    "papers",
)
def paper_status_filters(t):
    parts = [
        lb.status_filter(t.papers, s).select("paper_id", F.lit(s).alias("list"))
        for s in ("indexed", "processing", "error")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("paper_status_column", f"SELECT paper_id, {_STATUS} AS status FROM papers", "papers")
def paper_status_column(t):
    return t.papers.select("paper_id", lb.status_column().alias("status"))


@query(
    "has_pdf",
    r"SELECT paper_id, coalesce(regexp_matches(lower(regexp_extract(file_path, '([^/]*)$', 1)), '[^.].*\.pdf$'), false) AS has_pdf FROM papers",
    "papers",
)
def has_pdf(t):
    return t.papers.select("paper_id", lb.has_pdf(F.col("file_path")).alias("has_pdf"))


@query(
    "estimated_chunks",
    f"""SELECT paper_id, CASE WHEN is_processed AND coalesce(full_text, '') <> ''
  THEN greatest(1, len({q.words('full_text')}) // 500) ELSE 0 END AS chunk_count FROM papers""",
    "papers",
)
def estimated_chunks(t):
    return t.papers.select(
        "paper_id", lb.estimated_chunks(F.col("is_processed"), F.col("full_text")).alias("chunk_count")
    )


@query(
    "visible_documents",
    """SELECT document_id, 'own or public' AS list FROM user_documents WHERE owner_id = 7 OR is_public
UNION ALL SELECT document_id, 'public' FROM user_documents WHERE is_public""",
    "user_documents",
)
def visible_documents(t):
    mine = lb.visible_documents(t.user_documents, 7).select("document_id", F.lit("own or public").alias("list"))
    public = lb.visible_documents(t.user_documents).select("document_id", F.lit("public").alias("list"))
    return mine.unionByName(public)


@query(
    "search_documents",
    "SELECT document_id FROM user_documents WHERE title ILIKE '%urgent%' OR description ILIKE '%urgent%'",
    "user_documents",
)
def search_documents(t):
    return lb.search_documents(t.user_documents, "URGENT").select("document_id")


@query(
    "share_token_lookup",
    "SELECT document_id, title FROM user_documents WHERE is_public AND share_token = md5('10')",
    "user_documents",
)
def share_token_lookup(t):
    import hashlib

    token = hashlib.md5(b"10").hexdigest()
    return lb.by_share_token(t.user_documents, token).select("document_id", "title")


@query("paper_by_id", "SELECT paper_id, title FROM papers WHERE paper_id = 42", "papers")
def paper_by_id(t):
    return lb.by_id(t.papers, "paper_id", 42).select("paper_id", "title")


_PENDING_AT = "2024-01-01 10:00:00"


@query(
    "pending_papers",
    f"""SELECT paper_id FROM papers WHERE file_path IS NOT NULL AND NOT is_processed
  AND (coalesce(processing_error, '') = '' OR updated_at < TIMESTAMP '{_PENDING_AT}' - INTERVAL 30 MINUTE)""",
    "papers",
)
def pending_papers(t):
    return lb.pending_papers(t.papers, _PENDING_AT).select("paper_id")


@query(
    "next_batch",
    f"""SELECT paper_id FROM (SELECT paper_id, {_ERR} AS failed FROM papers WHERE file_path IS NOT NULL AND NOT is_processed)
WHERE failed = (SELECT min({_ERR}) FROM papers WHERE file_path IS NOT NULL AND NOT is_processed) ORDER BY paper_id LIMIT 5""",
    "papers",
)
def next_batch(t):
    return lb.next_batch(t.papers).select("paper_id")


@query(
    "filter_library",
    f"""SELECT paper_id FROM papers WHERE {_STATUS} = 'indexed' AND (contains(lower(title), 'ana')
  OR coalesce(len(list_filter(authors, lambda a: contains(lower(a), 'ana'))), 0) > 0)""",
    "papers",
)
def filter_library(t):
    return lb.filter_library(t.papers, "Ana", "indexed").select("paper_id")


@query(
    "assignable_papers",
    """SELECT paper_id FROM bib_papers p WHERE is_processed
  AND NOT EXISTS (SELECT 1 FROM assignments a WHERE a.document_id = 3 AND a.paper_id = p.paper_id)
  AND (contains(lower(title), 'red') OR coalesce(contains(lower(journal), 'red'), false)
    OR coalesce(len(list_filter(authors, lambda a: contains(lower(a), 'red'))), 0) > 0)""",
    "bib_papers assignments",
)
def assignable_papers(t):
    return lb.assignable_papers(t.bib_papers, t.assignments, 3, "red").select("paper_id")


@query(
    "filter_papers_by_tag_year",
    """SELECT p.paper_id FROM papers p WHERE p.year = 2004 AND EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = p.paper_id AND l.quality = 1)""",
    "papers",
)
def filter_papers_by_tag_year(t):
    tags = t.labels.selectExpr("doc_id AS paper_id", "array(IF(quality = 1, 'good', 'poor'), 'x') AS tags")
    return lb.filter_papers(t.papers, tag="good", year=2004, tags=tags).select("paper_id")


@query(
    "papers_by_source",
    "SELECT paper_id, file_path FROM papers WHERE source = 'upload' AND file_path IS NOT NULL",
    "papers",
)
def papers_by_source(t):
    return lb.from_source(t.papers, "upload").filter("file_path IS NOT NULL").select("paper_id", "file_path")


@query(
    "patch_rows",
    """SELECT p.paper_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN concat('New ', CAST(l.doc_id AS VARCHAR)) ELSE p.title END AS title,
  CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN NULL ELSE p.journal END AS journal
FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id""",
    "papers",
)
def patch_rows(t):
    patches = t.labels.selectExpr(
        "doc_id AS paper_id", "concat('New ', CAST(doc_id AS STRING)) AS title", "quality = 1 AS set_title",
        "CAST(NULL AS STRING) AS journal", "toxic = 1 AS set_journal",
    )
    out = lb.patch_rows(t.papers.select("paper_id", "title", "journal"), patches, "paper_id", ["title", "journal"])
    return out


@query(
    "page_of_papers",
    "SELECT paper_id FROM papers ORDER BY created_at DESC, paper_id LIMIT 50 OFFSET 100",
    "papers",
)
def page_of_papers(t):
    return lb.page(t.papers, "created_at", "paper_id", 100, 50).select("paper_id")


@query(
    "page_of_documents_by_title",
    "SELECT document_id FROM user_documents ORDER BY title, document_id LIMIT 20 OFFSET 40",
    "user_documents",
)
def page_of_documents_by_title(t):
    return lb.page(t.user_documents, "title", "document_id", 40, 20, descending=False).select("document_id")


@query(
    "page_after",
    """SELECT document_id FROM user_documents WHERE updated_at < TIMESTAMP '1997-06-01 00:00:00'
  OR (updated_at = TIMESTAMP '1997-06-01 00:00:00' AND document_id > 500)
ORDER BY updated_at DESC, document_id LIMIT 50""",
    "user_documents",
)
def page_after(t):
    last = F.expr("TIMESTAMP_NTZ '1997-06-01 00:00:00'")
    return lb.page_after(t.user_documents, "updated_at", "document_id", last, 500).select("document_id")


@query(
    "page_totals",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM papers WHERE is_processed",
    "papers",
)
def page_totals(t):
    return lb.page_totals(lb.status_filter(t.papers, "indexed"), 50)


@query(
    "sort_library_citations",
    "SELECT paper_id, coalesce(citation_count, 0) AS cites FROM bib_papers ORDER BY 2 DESC, 1",
    "bib_papers",
)
def sort_library_citations(t):
    """The whole library in order; the driver compares rows, the tests compare the order."""
    out = lb.sort_library(t.bib_papers, "citations")
    return out.select("paper_id", F.coalesce("citation_count", F.lit(0)).alias("cites"))


@query("sort_library_date", "SELECT paper_id FROM papers ORDER BY created_at DESC, paper_id", "papers")
def sort_library_date(t):
    return lb.sort_library(t.papers, "date").select("paper_id")


@query("sort_library_title", "SELECT paper_id, title FROM bib_papers ORDER BY title, paper_id", "bib_papers")
def sort_library_title(t):
    return lb.sort_library(t.bib_papers, "title").select("paper_id", "title")


@query("most_recent", "SELECT paper_id FROM papers ORDER BY created_at DESC, paper_id LIMIT 5", "papers")
def most_recent(t):
    return lb.most_recent(t.papers).select("paper_id")


@query(
    "queue_status",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE is_processed) AS processed, count(*) FILTER (WHERE {_ERR}) AS failed,
  count(*) FILTER (WHERE NOT is_processed) AS pending,
  round(count(*) FILTER (WHERE is_processed) / count(*) * 100.0, 6) AS progress_percentage FROM papers WHERE file_path IS NOT NULL""",
    "papers",
)
def queue_status(t):
    return lb.queue_status(t.papers).withColumn("progress_percentage", F.round("progress_percentage", 6))


@query(
    "processing_statistics",
    f"""SELECT *, round(processed * 100.0 / total, 6) AS progress FROM (SELECT count(*) AS total,
  CAST(sum(CASE WHEN is_processed THEN 1 ELSE 0 END) AS BIGINT) AS processed, CAST(sum(CASE WHEN {_ERR} THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN NOT is_processed AND NOT ({_ERR}) THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM papers WHERE file_path IS NOT NULL),
  (SELECT count(*) AS chunks FROM paper_chunks)""",
    "papers paper_chunks",
)
def processing_statistics(t):
    out = lb.processing_statistics(t.papers, t.paper_chunks)
    return out.withColumn("progress", F.round(F.col("progress").cast("double"), 6))


@query(
    "counts_by_processed",
    "SELECT is_processed, count(*) AS papers, count(processing_error) AS errors FROM papers GROUP BY is_processed",
    "papers",
)
def counts_by_processed(t):
    return lb.counts_by_processed(t.papers)


@query(
    "duplicate_titles",
    "SELECT title, count(*) AS copies FROM papers GROUP BY title HAVING count(*) > 1 ORDER BY copies DESC, title LIMIT 5",
    "papers",
)
def duplicate_titles(t):
    return lb.duplicate_titles(t.papers)


@query(
    "duplicate_titles_all",
    "SELECT title, count(*) AS copies FROM papers GROUP BY title HAVING count(*) > 1",
    "papers",
)
def duplicate_titles_all(t):
    return lb.duplicate_titles(t.papers, None)


_EMBEDDED_PAPERS = """SELECT d.doc_id AS paper_id, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def _embedded_papers(t):
    vectors = t.embeddings.selectExpr("vec_id AS paper_id", "embedding")
    return t.papers.select("paper_id").join(vectors, "paper_id", "left")


@query(
    "embedding_coverage",
    f"""SELECT 'papers' AS table_name, count(embedding) AS with_embedding, count(*) - count(embedding) AS without_embedding FROM ({_EMBEDDED_PAPERS})
UNION ALL SELECT 'chunks', count(embedding), count(*) - count(embedding) FROM embeddings""",
)
def embedding_coverage(t):
    return lb.embedding_coverage(_embedded_papers(t), t.paper_chunks)


@query("papers_with_embedding", f"SELECT paper_id FROM ({_EMBEDDED_PAPERS}) WHERE embedding IS NOT NULL")
def papers_with_embedding(t):
    return lb.with_embedding(_embedded_papers(t)).select("paper_id")


# users synchronise papers: the first lines of an order are the user's papers
_SYNCED = """synced AS (SELECT DISTINCT o.o_custkey % 50 AS user_id, l.l_partkey AS paper_id
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R')"""


def _synced(t):
    orders = t.orders.selectExpr("o_orderkey AS l_orderkey", "o_custkey % 50 AS user_id")
    lines = t.lineitem.filter("l_returnflag = 'R'").selectExpr("l_orderkey", "l_partkey AS paper_id")
    return lines.join(orders, "l_orderkey").select("user_id", "paper_id").distinct()


@query(
    "user_papers",
    f"WITH {_SYNCED} SELECT s.user_id, p.paper_id FROM papers p JOIN synced s ON s.paper_id = p.paper_id",
    "papers",
)
def user_papers(t):
    return lb.user_papers(t.papers.select("paper_id"), _synced(t)).select("user_id", "paper_id")


@query(
    "user_processing_status",
    f"""WITH {_SYNCED} SELECT user_id, count(*) AS total, count(*) FILTER (WHERE coalesce(file_path, '') <> '') AS with_file,
  count(*) FILTER (WHERE is_processed) AS processed, count(*) FILTER (WHERE {_ERR}) AS errors,
  count(*) - count(*) FILTER (WHERE is_processed) - count(*) FILTER (WHERE {_ERR}) AS remaining
FROM papers p JOIN synced s ON s.paper_id = p.paper_id GROUP BY user_id""",
    "papers",
)
def user_processing_status(t):
    return lb.user_processing_status(t.papers, _synced(t))


@query(
    "paper_categories",
    f"""SELECT CASE WHEN coalesce(file_path, '') = '' THEN 'no_file' WHEN is_processed THEN 'processed'
  WHEN {_ERR} THEN 'error' ELSE 'unprocessed' END AS category, count(*) AS papers FROM papers GROUP BY 1""",
    "papers",
)
def paper_categories(t):
    return lb.paper_categories(t.papers)


@query(
    "orphan_papers",
    """SELECT paper_id FROM bib_papers p WHERE NOT EXISTS (
  SELECT 1 FROM assignments a WHERE a.paper_id = p.paper_id AND a.quantity > 49)""",
    "bib_papers assignments",
)
def orphan_papers(t):
    return lb.orphan_papers(t.bib_papers, t.assignments.filter("quantity > 49")).select("paper_id")


# logs ---------------------------------------------------------------------------

_AS_OF = "2024-01-30 00:00:00"


@query(
    "filter_logs",
    """SELECT log_id FROM logs WHERE level = 'ERROR' AND category = 'SYNC' AND entity_type = 'paper'
  AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 12:00:00' AND message ILIKE '%k": 1%'""",
    "logs",
)
def filter_logs(t):
    return lg.filter_logs(
        t.logs, level="ERROR", category="SYNC", entity_type="paper", start="2024-01-05 00:00:00",
        end="2024-01-25 12:00:00", search='K": 1',
    ).select("log_id")


@query(
    "filter_logs_entity",
    "SELECT log_id FROM logs WHERE user_id = 17 AND entity_type = 'paper' AND entity_id = '8'",
    "logs",
)
def filter_logs_entity(t):
    return lg.filter_logs(t.logs, user_id=17, entity_type="paper", entity_id="8").select("log_id")


@query(
    "own_logs",
    """SELECT log_id, 'user' AS viewer FROM logs WHERE user_id = 5
UNION ALL SELECT log_id, 'superuser' FROM logs""",
    "logs",
)
def own_logs(t):
    a = lg.own_logs(t.logs, 5, False, 9).select("log_id", F.lit("user").alias("viewer"))
    return a.unionByName(lg.own_logs(t.logs, 5, True).select("log_id", F.lit("superuser").alias("viewer")))


@query(
    "page_of_logs",
    "SELECT log_id FROM logs WHERE level = 'ERROR' ORDER BY created_at DESC, log_id LIMIT 50 OFFSET 50",
    "logs",
)
def page_of_logs(t):
    return lb.page(lg.filter_logs(t.logs, level="ERROR"), "created_at", "log_id", 50, 50).select("log_id")


@query(
    "log_stats",
    f"""WITH recent AS (SELECT * FROM logs WHERE created_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 7 DAY)
SELECT 'total' AS kind, 'all' AS name, count(*) AS logs FROM recent
UNION ALL SELECT 'level', level, count(*) FROM recent GROUP BY level
UNION ALL SELECT 'category', category, count(*) FROM recent GROUP BY category""",
    "logs",
)
def log_stats(t):
    return lg.log_stats(t.logs, _AS_OF, 7)


@query(
    "log_windows",
    """SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, level, category, count(*) AS logs
FROM logs GROUP BY 1, 2, 3""",
    "logs",
)
def log_windows(t):
    out = lg.windowed_counts(t.logs)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "logs_with_users",
    """SELECT l.log_id, u.c_name AS email FROM logs l LEFT JOIN customer u
  ON u.c_custkey = l.user_id AND u.c_mktsegment = 'BUILDING'""",
    "logs",
)
def logs_with_users(t):
    users = t.customer.filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS user_id", "c_name AS email")
    return lg.logs_with_users(t.logs, users).select("log_id", "email")


@query(
    "purge_logs",
    f"""SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 10 DAY) AS kept,
  count(*) FILTER (WHERE created_at < TIMESTAMP '{_AS_OF}' - INTERVAL 10 DAY) AS deleted_count FROM logs""",
    "logs",
)
def purge_logs(t):
    rest, deleted = lg.purge_logs(t.logs, _AS_OF, 10)
    return deleted.withColumn("kept", rest.agg(F.count("*")).scalar())


@query(
    "export_logs",
    """SELECT log_id, concat('{"level":"', level, '","category":"', category, '","message":"', replace(message, '"', '\\"'), '"}') AS line
FROM logs WHERE level = 'WARNING'""",
    "logs",
)
def export_logs(t):
    return lg.log_json(lg.filter_logs(t.logs, level="WARNING"))


_QUOTED = "concat('\"', replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), '\"')"


def _json_sql(**fields: str) -> str:
    """A JSON object in SQL; NULL fields are left out."""
    parts = ", ".join(f"""'"{name}":' || {value}""" for name, value in fields.items())
    return f"concat('{{', concat_ws(',', {parts}), '}}')"


@query(
    "export_logs_full",
    f"""SELECT log_id, {_json_sql(
        log_id="CAST(log_id AS VARCHAR)", level=_QUOTED.format("level"), category=_QUOTED.format("category"), message=_QUOTED.format("message"),
        details=_QUOTED.format("details"), entity_type=_QUOTED.format("entity_type"), entity_id=_QUOTED.format("entity_id"),
        user_id="CAST(user_id AS VARCHAR)", created_at=_QUOTED.format("strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g')"),
    )} AS line FROM logs""",
    "logs",
)
def export_logs_full(t):
    """Every log row with all its fields, as the export writes it."""
    stamped = t.logs.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    fields = ["log_id", "level", "category", "message", "details", "entity_type", "entity_id", "user_id", "created_at"]
    return lg.log_json(lg.filter_logs(stamped), fields)


@query(
    "log_outcomes",
    f"""SELECT CAST(paper_id AS VARCHAR) AS entity_id, CASE WHEN {_ERR} THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN {_ERR} THEN concat('{{"error_type":"IOError","error_message":"', processing_error, '"}}') END AS details FROM papers""",
    "papers",
)
def log_outcomes(t):
    outcomes = t.papers.select(
        F.col("paper_id").alias("entity_id"),
        F.when(lb.has_error(), "IOError").alias("error_type"),
        F.when(lb.has_error(), F.col("processing_error")).alias("error_message"),
        F.lit(None).cast("string").alias("error_trace"),
    )
    rows = lg.log_rows(outcomes, "PDF_PROCESSING", F.lit("processed"), _AS_OF)
    return rows.select("entity_id", "level", "details")


@query(
    "normalise_empty",
    "SELECT paper_id, nullif(doi, '') AS doi, nullif(pubmed_id, '') AS pubmed_id FROM papers",
    "papers",
)
def normalise_empty(t):
    return t.papers.select(
        "paper_id", tx.empty_to_null(F.col("doi")).alias("doi"), tx.empty_to_null(F.col("pubmed_id")).alias("pubmed_id")
    )
