"""Logical tables over the driver's tables.

A view is a base table plus named expressions. The expressions are written so
that Spark SQL and DuckDB both run them, so one text defines both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citespark.sources.tables import read_table

# work on these is per-row text processing
TEXT_TABLES = {"documents"}
BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_START = "TIMESTAMP '2024-01-01 00:00:00'"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "papers": (
        "documents",
        {
            "paper_id": "doc_id",
            "title": "split_part(text, chr(10), 1)",
            "abstract": "text",
            "full_text": "text",
            "year": "CAST(CASE WHEN doc_id % 53 = 0 THEN NULL ELSE 1985 + doc_id % 41 END AS INT)",
            "citation_count": "CAST((doc_id * 37) % 300 AS INT)",
            "is_processed": "doc_id % 10 <> 0",
            "authors": (
                "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN "
                "split(concat('Ada ', source), ';') WHEN doc_id % 4 = 2 THEN "
                "split(concat('Ana María ', upper(lang), '-Berg;Bo ', source), ';') ELSE "
                "split(concat(source, ', Chi;Bo ', lang, ';Dee O''Neil'), ';') END"
            ),
            "journal": (
                "CASE doc_id % 5 WHEN 0 THEN 'arXiv' WHEN 1 THEN concat('Journal of ', source) "
                "WHEN 2 THEN NULL WHEN 3 THEN 'bioRxiv' ELSE concat('Annals ', lang) END"
            ),
            "doi": (
                "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN NULL "
                "ELSE concat('10.1234/', CAST(doc_id % 700 AS STRING)) END"
            ),
            "arxiv_id": (
                "CASE WHEN doc_id % 6 = 0 THEN concat(CAST(2000 + doc_id % 600 AS STRING), '.', "
                "lpad(CAST(doc_id AS STRING), 5, '0')) END"
            ),
            "pubmed_id": (
                "CASE WHEN doc_id % 8 = 0 THEN CAST(30000000 + doc_id AS STRING) "
                "WHEN doc_id % 8 = 1 THEN '' END"
            ),
            "semantic_scholar_id": "CASE WHEN doc_id % 9 = 0 THEN concat('s', CAST(doc_id % 90 AS STRING)) END",
            "source": "CASE doc_id % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'library' ELSE 'bibtex' END",
            "source_url": "CASE WHEN doc_id % 5 = 2 THEN concat('https://example.org/', CAST(doc_id AS STRING)) END",
            "file_path": (
                "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('/p/', CAST(doc_id AS STRING), '.PDF') "
                "WHEN 2 THEN '/p/.pdf' WHEN 3 THEN concat('/p/', CAST(doc_id AS STRING), '.docx') "
                "ELSE concat('/p/', CAST(doc_id AS STRING), '.pdf') END"
            ),
            "file_hash": "md5(text)",
            "processing_error": (
                "CASE doc_id % 11 WHEN 0 THEN 'bad file' WHEN 1 THEN '' ELSE NULL END"
            ),
            "created_at": f"{_START} + INTERVAL '1' HOUR * CAST((doc_id * 7) % 997 AS INT)",
            "updated_at": f"{_START} + INTERVAL '1' MINUTE * CAST((doc_id * 13) % 1009 AS INT)",
        },
    ),
    "paper_chunks": (
        "embeddings",
        {
            "chunk_id": "vec_id",
            "paper_id": "vec_id % 100",
            "chunk_index": "CAST(floor(vec_id / 100) AS INT)",
            "content": "concat('chunk ', CAST(vec_id AS STRING), ' ', repeat('word ', CAST(vec_id % 60 AS INT)))",
            "section_title": "CASE WHEN vec_id % 3 = 0 THEN 'Introduction' END",
            "embedding": "embedding",
        },
    ),
    "logs": (
        "events",
        {
            "log_id": "event_id",
            "level": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END",
            "category": (
                "CASE event_id % 7 WHEN 0 THEN 'SYNC' WHEN 1 THEN 'PDF_PROCESSING' WHEN 2 THEN 'SEARCH' "
                "WHEN 3 THEN 'AUTH' WHEN 4 THEN 'API' WHEN 5 THEN 'SYSTEM' ELSE 'CITATION' END"
            ),
            "message": "concat(event_type, ' ', props)",
            "details": "props",
            "entity_type": "CASE WHEN event_id % 2 = 0 THEN 'paper' ELSE 'document' END",
            "entity_id": "CAST(event_id % 50 AS STRING)",
            "user_id": "user_id",
            "created_at": "ts",
        },
    ),
    "user_documents": (
        "orders",
        {
            "document_id": "o_orderkey",
            "owner_id": "o_custkey",
            "title": "concat('Draft ', CAST(o_orderkey AS STRING), ' on ', lower(o_orderpriority))",
            "description": (
                "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' "
                "ELSE concat('costs $', CAST(o_orderkey AS STRING), ' & 5% of {x}_y') END"
            ),
            "plain_text": "concat('Body of ', CAST(o_orderkey AS STRING), '. 50% done.')",
            "is_public": "o_orderkey % 5 = 0",
            "share_token": "CASE WHEN o_orderkey % 5 = 0 THEN md5(CAST(o_orderkey AS STRING)) END",
            "updated_at": "o_orderdate",
        },
    ),
    "assignments": (
        "lineitem",
        {
            "document_id": "l_orderkey",
            "paper_id": "l_partkey",
            "line": "l_linenumber",
            "notes": "CASE WHEN l_quantity > 40 THEN concat('see ', l_returnflag) END",
            "added_at": "l_shipdate",
            "quantity": "l_quantity",
            "suppkey": "l_suppkey",
        },
    ),
    "bib_papers": (
        "part",
        {
            "paper_id": "p_partkey",
            "title": "concat('The ', p_name, ' of ', lower(p_type))",
            "authors": (
                "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN "
                "split(concat('Ada ', replace(p_brand, '#', '')), ';') ELSE "
                "split(concat('Ana ', replace(p_brand, '#', '-'), ';Bo Lee'), ';') END"
            ),
            "year": "CAST(CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 1990 + p_size % 35 END AS INT)",
            "journal": (
                "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'medRxiv' ELSE concat('J ', p_type) END"
            ),
            "doi": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('10.5555/', CAST(p_partkey AS STRING)) END",
            "arxiv_id": "CASE WHEN p_partkey % 6 = 0 THEN concat('2101.', lpad(CAST(p_partkey AS STRING), 5, '0')) END",
            "pubmed_id": "CASE WHEN p_partkey % 10 = 0 THEN CAST(p_partkey AS STRING) END",
            "source_url": "CASE WHEN p_partkey % 7 = 0 THEN concat('https://x.org/', CAST(p_partkey AS STRING)) END",
            "abstract": (
                "CASE WHEN p_partkey % 4 = 3 THEN concat('A \"', p_name, '\"', chr(10), 'second line') END"
            ),
            "is_processed": "p_partkey % 4 <> 1",
            "citation_count": "CAST(CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size * 3 END AS INT)",
        },
    ),
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view as a DataFrame."""
    base, columns = VIEWS.get(name, (name, {}))
    # the driver's text tables are one row group each: one task, unless they are dealt out
    partitions = spark.sparkContext.defaultParallelism if base in TEXT_TABLES else None
    table = read_table(spark, f"{sf_dir}/{base}.parquet", partitions=partitions)
    if not columns:
        return table
    return table.selectExpr(*[f"{_spark_text(e)} AS {c}" for c, e in columns.items()])


def _spark_text(expression: str) -> str:
    """Naive timestamps are a type of their own in Spark."""
    return expression.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def duck_view(name: str) -> str:
    base, columns = VIEWS[name]
    body = ",\n    ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"{name} AS (\n  SELECT {body}\n  FROM {base}\n)"


def with_views(sql: str, *names: str) -> str:
    """A query text with the named views in front as common table expressions."""
    if not names:
        return sql
    head = ",\n".join(duck_view(n) for n in names)
    recursive = "RECURSIVE " if "/*recursive*/" in sql else ""
    body = sql.strip()
    joiner = ",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body
    return f"WITH {recursive}{head}{joiner}"


class Tables:
    """Attribute access to views of one data folder: ``t.papers``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in BASE:
            raise AttributeError(name)
        return spark_view(self.spark, self.sf_dir, name)
