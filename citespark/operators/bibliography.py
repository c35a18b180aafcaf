"""Papers assigned to documents: assigning, ordering, flags, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions.citations import bibtex_of, escape_latex
from citespark.operators import timeline

NO_PAPERS = "% No papers assigned to this document\n"


def bibliography(assignments: DataFrame, papers: DataFrame) -> DataFrame:
    """Assignment rows with their papers."""
    return assignments.join(papers, "paper_id")


def owned(assignments: DataFrame, documents: DataFrame, user_id) -> DataFrame:
    """Assignments in documents of one user."""
    mine = documents.filter(F.col("owner_id") == user_id).select("document_id")
    return assignments.join(mine, "document_id", "left_semi")


def already_assigned(requests: DataFrame, assignments: DataFrame) -> DataFrame:
    """Requested pairs that exist; only the distinct pairs are compared."""
    return requests.join(assignments.select("document_id", "paper_id"), ["document_id", "paper_id"], "left_semi")


def new_assignments(requests: DataFrame, assignments: DataFrame) -> DataFrame:
    """Requested pairs that do not exist yet; order and duplicates stay."""
    return requests.join(assignments.select("document_id", "paper_id"), ["document_id", "paper_id"], "left_anti")


def check_requests(requests: DataFrame, papers: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every request with a verdict: new, unknown paper, already assigned."""
    known = papers.select("paper_id", F.lit(True).alias("_known"))
    taken = assignments.select("document_id", "paper_id").distinct().withColumn("_taken", F.lit(True))
    verdict = (
        F.when(F.col("_known").isNull(), "unknown_paper")
        .when(F.col("_taken").isNotNull(), "already_assigned")
        .otherwise("new")
    )
    return (
        requests.join(known, "paper_id", "left")
        .join(taken, ["document_id", "paper_id"], "left")
        .withColumn("verdict", verdict)
        .drop("_known", "_taken")
    )


def max_positions(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("document_id").agg(F.max("position").alias("max_position"))


def assign_positions(
    requests: DataFrame,
    assignments: DataFrame,
    order: str,
    legacy_positions: bool = False,
) -> DataFrame:
    """Positions of new rows: highest position of the document + 1, 2, ... in request order, ties by paper.

    A ``position`` column of the requests wins where it is not NULL.
    ``legacy_positions`` treats a highest position of 0 as none at all, which
    gives the second paper of a document position 0 again.
    """
    highest = F.coalesce("max_position", F.lit(-1))
    if legacy_positions:
        highest = F.when(highest == 0, -1).otherwise(highest)
    wanted = F.col("position") if "position" in requests.columns else F.lit(None).cast("int")
    numbered = timeline.running_number(requests, ["document_id"], [order, "paper_id"], None, "_nth")
    return (
        numbered.join(max_positions(assignments), "document_id", "left")
        .withColumn("position", F.coalesce(wanted, (highest + F.col("_nth")).cast("int")))
        .drop("_nth", "max_position")
    )


def reorder(assignments: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New positions for listed papers (document_id, paper_id, new_position from 0).

    Returns the snapshot, in which other papers keep theirs, and the listed
    pairs that do not exist. Of several positions for one paper the largest counts.
    """
    keys = ["document_id", "paper_id"]
    wanted = wanted.groupBy(*keys).agg(F.max("new_position").alias("new_position"))
    snapshot = (
        assignments.join(wanted.select(*keys, "new_position"), keys, "left")
        .withColumn("position", F.coalesce("new_position", "position").cast("int"))
        .drop("new_position")
    )
    return snapshot, wanted.join(assignments.select(*keys), keys, "left_anti")


def order_rows(orders: DataFrame) -> DataFrame:
    """(document_id, array of paper ids) as rows with positions from 0."""
    return orders.select("document_id", F.posexplode("paper_ids").alias("new_position", "paper_id"))


def update_assignments(assignments: DataFrame, patches: DataFrame) -> DataFrame:
    """Notes and positions from patches where those are not NULL; of several for one paper the largest of each."""
    keys = ["document_id", "paper_id"]
    p = patches.groupBy(*keys).agg(F.max("notes").alias("_notes"), F.max("position").alias("_position"))
    return assignments.join(p, keys, "left").withColumns(
        {"notes": F.coalesce("_notes", "notes"), "position": F.coalesce("_position", "position")}
    ).drop("_notes", "_position")


def flag_suggestions(suggestions: DataFrame, assignments: DataFrame, cited: DataFrame) -> DataFrame:
    """``in_bibliography`` and ``is_cited`` of each (document_id, paper_id) suggestion."""
    keys = ["document_id", "paper_id"]
    out = suggestions
    for table, flag in ((assignments, "in_bibliography"), (cited, "is_cited")):
        known = table.select(*keys).distinct().withColumn("_hit", F.lit(True))
        out = out.join(known, keys, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")
    return out


def first_citations(citations: DataFrame, order: str = "path") -> DataFrame:
    """Distinct cited papers of a document with the place of their first citation."""
    return citations.groupBy("document_id", "paper_id").agg(F.min(order).alias(order))


def citation_counts(citations: DataFrame) -> DataFrame:
    return citations.groupBy("document_id").agg(F.count("*").alias("citation_count"))


# exports ----------------------------------------------------------------------
# An export is a table of text parts (document_id, part_no, content). Parts of a
# document stay rows, so a huge bibliography never becomes one value in one task.


def bibtex_parts(
    documents: DataFrame, assignments: DataFrame, papers: DataFrame, generated_at: str
) -> DataFrame:
    """Header (part -1) and one entry per assigned paper at its position."""
    counts = assignments.groupBy("document_id").agg(F.count("*").alias("n"))
    header = F.when(F.col("n").isNull(), F.lit(NO_PAPERS)).otherwise(
        F.concat(
            F.lit("% BibTeX export for document: "), F.col("title"),
            F.lit(f"\n\n% Generated on: {generated_at}\n\n% Total papers: "), F.col("n").cast("string"),
            F.lit("\n\n"),
        )
    )
    heads = documents.join(counts, "document_id", "left").select(
        "document_id", F.lit(-1).alias("part_no"), header.alias("content")
    )
    note = F.when(
        F.coalesce(F.col("notes"), F.lit("")) != "", F.concat(F.lit("% Notes: "), "notes", F.lit("\n"))
    ).otherwise("")
    entries = (
        assignments.select("document_id", "paper_id", "position", "notes")
        .join(documents.select("document_id"), "document_id", "left_semi")
        .join(papers.withColumn("_entry", bibtex_of()).select("paper_id", "_entry"), "paper_id")
        .select("document_id", F.col("position").alias("part_no"), F.concat(note, "_entry").alias("content"))
    )
    return heads.unionByName(entries)


def bibliography_name(title: Column, bib_filename: str | None) -> Column:
    if bib_filename:
        return F.lit(bib_filename)
    return F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit("_bibliography"))


def latex_document(
    documents: DataFrame,
    assignments: DataFrame,
    bodies: DataFrame | None = None,
    author: str = "",
    bib_filename: str | None = None,
) -> DataFrame:
    """(document_id, content): a LaTeX file per document.

    ``bodies`` (document_id, body) holds rendered trees; without one the
    escaped plain text is used. ``author`` fills the author line.
    """
    cited = assignments.select("document_id").distinct().withColumn("_has", F.lit(True))
    rows = documents.join(cited, "document_id", "left")
    if bodies is not None:
        rows = rows.join(bodies.select("document_id", "body"), "document_id", "left")
    else:
        rows = rows.withColumn("body", F.lit(None).cast("string"))
    # The preamble of an exported document.
    preamble = "\n".join(
        [
            "\\documentclass{article}",
            "\\usepackage[utf8]{inputenc}",
            "\\usepackage{hyperref}",
            "\\usepackage{cite}",
            "\\usepackage{graphicx}",
            "\\usepackage{amsmath}",
        ]
    )
    nonempty = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    abstract = F.when(
        nonempty("description"),
        F.concat(
            F.lit("\\begin{abstract}\n"), escape_latex(F.col("description")), F.lit("\n\\end{abstract}\n")
        ),
    )
    body = F.when(F.col("body").isNotNull(), F.col("body")).when(
        nonempty("plain_text"), escape_latex(F.col("plain_text"))
    )
    bib = F.when(
        F.col("_has").isNotNull(),
        F.concat(
            F.lit("\n\\bibliographystyle{plain}\n\\bibliography{"),
            bibliography_name(F.col("title"), bib_filename),
            F.lit("}\n"),
        ),
    )
    content = F.concat_ws(
        "\n",
        F.lit(preamble + "\n"),
        F.concat(F.lit("\\title{"), escape_latex(F.col("title")), F.lit("}")),
        F.lit(f"\\author{{{author}}}\n\\date{{\\today}}\n\n\\begin{{document}}\n\n\\maketitle\n"),
        abstract,
        body,
        bib,
        F.lit("\\end{document}"),
    )
    return rows.select("document_id", content.alias("content"))


def bundle(latex: DataFrame, bibtex: DataFrame) -> DataFrame:
    """Files of a project (document_id, filename, part_no, content).

    The bibliography file is left out for documents without papers, which only
    their header part tells.
    """
    main = latex.select(
        "document_id", F.lit("main.tex").alias("filename"), F.lit(0).alias("part_no"), "content"
    )
    bib = bibtex.filter((F.col("part_no") >= 0) | (F.col("content") != NO_PAPERS)).select(
        "document_id", F.lit("references.bib").alias("filename"), "part_no", "content"
    )
    return main.unionByName(bib)


def write_parts(parts: DataFrame, path: str, by: list[str] | None = None, buckets: int = 64) -> None:
    """Parts as Parquet (keys, part_no, content) in ``buckets`` folders by a hash of the keys, in order within a file.

    The number of folders does not grow with the documents; ``read_parts`` gives one document's text.
    """
    keys = by or ["document_id"]
    # a sampled range partitioning on (bucket, document, part) splits hot documents
    order = ["bucket", *keys, "part_no"]
    (
        parts.withColumn("bucket", _bucket(keys, buckets))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*keys, "part_no", "content", "bucket")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def read_parts(spark: SparkSession, path: str, buckets: int = 64, **key) -> DataFrame:
    """Parts of one document in order; only its bucket's folder is read."""
    values = spark.range(1).select(*[F.lit(str(v)).alias(k) for k, v in key.items()])
    bucket = values.select(_bucket(list(key), buckets)).first()[0]
    found = spark.read.parquet(path).filter(F.col("bucket") == bucket)
    for name, value in key.items():
        found = found.filter(F.col(name) == F.lit(value))
    return found.drop("bucket").orderBy("part_no")
