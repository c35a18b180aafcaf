"""Bibliographies, exports, editor trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from citespark.operators import bibliography as bb
from citespark.operators import timeline, tree
from suite.registry import query
from suite.texts import ENTRY_SQL, latex_sql

# assigned papers of a document: distinct pairs of order and part
_ASSIGNED = """assigned AS (SELECT document_id, paper_id, CAST(min(line) - 1 AS INT) AS position, min(notes) AS notes
  FROM assignments GROUP BY document_id, paper_id)"""


def assigned(t):
    return t.assignments.groupBy("document_id", "paper_id").agg(
        (F.min("line") - 1).cast("int").alias("position"), F.min("notes").alias("notes")
    )


# requests to assign: pairs (order, supplier number as paper), with the line as request order
_REQUESTS = "requests AS (SELECT document_id, suppkey AS paper_id, line, quantity FROM assignments)"


def _requests(t):
    return t.assignments.selectExpr("document_id", "suppkey AS paper_id", "line", "quantity")


@query(
    "bibliography",
    f"""WITH {_ASSIGNED} SELECT a.document_id, a.paper_id, a.position, p.title FROM assigned a
JOIN bib_papers p ON p.paper_id = a.paper_id""",
    "assignments bib_papers",
)
def bibliography(t):
    return bb.bibliography(assigned(t), t.bib_papers).select("document_id", "paper_id", "position", "title")


@query(
    "owned_assignments",
    f"""WITH {_ASSIGNED} SELECT a.document_id, a.paper_id FROM assigned a
WHERE a.document_id IN (SELECT document_id FROM user_documents WHERE owner_id = 42)""",
    "assignments user_documents",
)
def owned_assignments(t):
    return bb.owned(assigned(t), t.user_documents, 42).select("document_id", "paper_id")


@query(
    "already_assigned",
    f"""WITH {_ASSIGNED}, {_REQUESTS} SELECT r.document_id, r.paper_id, r.line FROM requests r
WHERE EXISTS (SELECT 1 FROM assigned a WHERE a.document_id = r.document_id AND a.paper_id = r.paper_id)""",
    "assignments",
)
def already_assigned(t):
    return bb.already_assigned(_requests(t), assigned(t)).select("document_id", "paper_id", "line")


@query(
    "new_assignments",
    f"""WITH {_ASSIGNED}, {_REQUESTS} SELECT r.document_id, r.paper_id, r.line FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.document_id = r.document_id AND a.paper_id = r.paper_id)""",
    "assignments",
)
def new_assignments(t):
    return bb.new_assignments(_requests(t), assigned(t)).select("document_id", "paper_id", "line")


@query(
    "check_requests",
    f"""WITH {_ASSIGNED}, {_REQUESTS} SELECT r.document_id, r.paper_id, r.line,
  CASE WHEN p.paper_id IS NULL THEN 'unknown_paper' WHEN a.paper_id IS NOT NULL THEN 'already_assigned' ELSE 'new' END AS verdict
FROM requests r LEFT JOIN (SELECT paper_id FROM bib_papers WHERE is_processed) p ON p.paper_id = r.paper_id
LEFT JOIN assigned a ON a.document_id = r.document_id AND a.paper_id = r.paper_id""",
    "assignments bib_papers",
)
def check_requests(t):
    known = t.bib_papers.filter("is_processed")
    return bb.check_requests(_requests(t), known, assigned(t)).select("document_id", "paper_id", "line", "verdict")


@query(
    "max_positions",
    f"WITH {_ASSIGNED} SELECT document_id, max(position) AS max_position FROM assigned GROUP BY document_id",
    "assignments",
)
def max_positions(t):
    return bb.max_positions(assigned(t))


def _positions_sql(base: str) -> str:
    return f"""WITH {_ASSIGNED}, old AS (SELECT * FROM assigned WHERE notes IS NOT NULL),
fresh AS (SELECT document_id, paper_id, min(line) * 100000 + paper_id AS seq FROM assignments a
  WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.document_id = a.document_id AND o.paper_id = a.paper_id) GROUP BY document_id, paper_id),
top AS (SELECT document_id, max(position) AS m FROM old GROUP BY document_id)
SELECT f.document_id, f.paper_id, {base} + row_number() OVER (PARTITION BY f.document_id ORDER BY seq) AS position
FROM fresh f LEFT JOIN top ON top.document_id = f.document_id"""


def _assign(t, legacy):
    old = assigned(t).filter("notes IS NOT NULL")
    fresh = (
        t.assignments.join(old, ["document_id", "paper_id"], "left_anti")
        .groupBy("document_id", "paper_id")
        .agg((F.min("line") * 100000 + F.col("paper_id")).alias("seq"))
    )
    return bb.assign_positions(fresh, old, "seq", legacy).select("document_id", "paper_id", "position")


@query("assign_positions", _positions_sql("coalesce(m, -1)"), "assignments")
def assign_positions(t):
    return _assign(t, False)


@query("assign_positions_legacy", _positions_sql("CASE WHEN coalesce(m, 0) = 0 THEN -1 ELSE m END"), "assignments")
def assign_positions_legacy(t):
    return _assign(t, True)


@query(
    "reorder",
    f"""WITH {_ASSIGNED}, wanted AS (SELECT document_id, paper_id, row_number() OVER (PARTITION BY document_id ORDER BY paper_id) - 1 AS pos
  FROM assigned WHERE notes IS NOT NULL)
SELECT a.document_id, a.paper_id, coalesce(w.pos, a.position) AS position FROM assigned a
LEFT JOIN wanted w ON w.document_id = a.document_id AND w.paper_id = a.paper_id""",
    "assignments",
)
def reorder(t):
    listed = timeline.running_number(
        assigned(t).filter("notes IS NOT NULL").select("document_id", "paper_id"), ["document_id"], ["paper_id"],
        timeline.number_bucket("paper_id"), "nth",
    )
    wanted = listed.select("document_id", "paper_id", (F.col("nth") - 1).alias("new_position"))
    snapshot, _ = bb.reorder(assigned(t), wanted)
    return snapshot.select("document_id", "paper_id", "position")


@query(
    "reorder_unknown",
    f"""WITH {_ASSIGNED}, {_REQUESTS} SELECT DISTINCT r.document_id, r.paper_id FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.document_id = r.document_id AND a.paper_id = r.paper_id)""",
    "assignments",
)
def reorder_unknown(t):
    wanted = _requests(t).select("document_id", "paper_id").distinct().withColumn("new_position", F.lit(0))
    return bb.reorder(assigned(t), wanted)[1].select("document_id", "paper_id")


_PATCHES = """patches AS (SELECT document_id, paper_id, CASE WHEN max(quantity) > 30 THEN 'patched' END AS notes,
  CAST(CASE WHEN max(quantity) < 20 THEN 99 END AS INT) AS position FROM assignments GROUP BY document_id, paper_id)"""


@query(
    "update_assignments",
    f"""WITH {_ASSIGNED}, {_PATCHES} SELECT a.document_id, a.paper_id, coalesce(p.notes, a.notes) AS notes,
  coalesce(p.position, a.position) AS position FROM assigned a
LEFT JOIN patches p ON p.document_id = a.document_id AND p.paper_id = a.paper_id""",
    "assignments",
)
def update_assignments(t):
    patches = t.assignments.groupBy("document_id", "paper_id").agg(
        F.expr("CASE WHEN max(quantity) > 30 THEN 'patched' END").alias("notes"),
        F.expr("CAST(CASE WHEN max(quantity) < 20 THEN 99 END AS INT)").alias("position"),
    )
    return bb.update_assignments(assigned(t), patches).select("document_id", "paper_id", "notes", "position")


@query(
    "flag_suggestions",
    f"""WITH {_ASSIGNED}, {_REQUESTS}, cited AS (SELECT DISTINCT document_id, paper_id FROM assignments WHERE quantity > 25)
SELECT r.document_id, r.paper_id, r.line, a.paper_id IS NOT NULL AS in_bibliography, c.paper_id IS NOT NULL AS is_cited
FROM requests r LEFT JOIN assigned a ON a.document_id = r.document_id AND a.paper_id = r.paper_id
LEFT JOIN cited c ON c.document_id = r.document_id AND c.paper_id = r.paper_id""",
    "assignments",
)
def flag_suggestions(t):
    cited = t.assignments.filter("quantity > 25")
    rows = _requests(t).select("document_id", "paper_id", "line")
    return bb.flag_suggestions(rows, assigned(t), cited)


@query(
    "first_citations",
    "SELECT document_id, paper_id, min(line) AS line FROM assignments GROUP BY document_id, paper_id",
    "assignments",
)
def first_citations(t):
    return bb.first_citations(t.assignments, "line")


@query(
    "citation_counts",
    "SELECT document_id, count(*) AS citation_count FROM assignments GROUP BY document_id",
    "assignments",
)
def citation_counts(t):
    return bb.citation_counts(t.assignments)


_AT = "2024-05-06 07:08:09"
_NL2 = "chr(10) || chr(10)"
_BIB = f"""{_ASSIGNED}, counts AS (SELECT document_id, count(*) AS n FROM assigned GROUP BY document_id),
parts AS (SELECT d.document_id, -1 AS part_no, CASE WHEN n IS NULL THEN '% No papers assigned to this document' || chr(10)
    ELSE concat('% BibTeX export for document: ', d.title, {_NL2}, '% Generated on: {_AT}', {_NL2}, '% Total papers: ', n, {_NL2}) END AS content
  FROM user_documents d LEFT JOIN counts c ON c.document_id = d.document_id
  UNION ALL
  SELECT a.document_id, a.position, concat(CASE WHEN coalesce(a.notes, '') <> '' THEN concat('% Notes: ', a.notes, chr(10)) ELSE '' END, e.entry)
  FROM assigned a JOIN user_documents d ON d.document_id = a.document_id
  JOIN (SELECT paper_id, {ENTRY_SQL} AS entry FROM bib_papers) e ON e.paper_id = a.paper_id)"""


@query("export_bibtex", f"WITH {_BIB} SELECT * FROM parts", "assignments bib_papers user_documents")
def export_bibtex(t):
    return bb.bibtex_parts(t.user_documents, assigned(t), t.bib_papers, _AT)


_PREAMBLE = " || chr(10) || ".join(
    f"'{x}'"
    for x in (
        "\\documentclass{article}", "\\usepackage[utf8]{inputenc}", "\\usepackage{hyperref}",
        "\\usepackage{cite}", "\\usepackage{graphicx}", "\\usepackage{amsmath}", "",
    )
)
_LATEX = f"""latex AS (SELECT d.document_id, {_PREAMBLE} || chr(10) || concat('\\title{{', {latex_sql('d.title')}, '}}', chr(10), '\\author{{A. Writer}}', chr(10),
    '\\date{{\\today}}', {_NL2}, '\\begin{{document}}', {_NL2}, '\\maketitle', {_NL2},
    CASE WHEN coalesce(description, '') <> '' THEN concat('\\begin{{abstract}}', chr(10), {latex_sql('description')}, chr(10), '\\end{{abstract}}', {_NL2}) ELSE '' END,
    {latex_sql('plain_text')}, chr(10),
    CASE WHEN a.document_id IS NOT NULL THEN concat(chr(10), '\\bibliographystyle{{plain}}', chr(10), '\\bibliography{{', BIBNAME, '}}', chr(10), chr(10)) ELSE '' END,
    '\\end{{document}}') AS content
  FROM user_documents d LEFT JOIN (SELECT DISTINCT document_id FROM assignments) a ON a.document_id = d.document_id)"""


@query(
    "export_latex",
    "WITH " + _LATEX.replace("BIBNAME", "replace(d.title, ' ', '_'), '_bibliography'") + " SELECT * FROM latex",
    "assignments user_documents",
)
def export_latex(t):
    return bb.latex_document(t.user_documents, assigned(t), author="A. Writer")


@query(
    "bundle_export",
    "WITH " + _BIB + ", " + _LATEX.replace("BIBNAME", "'references'")
    + """ SELECT document_id, 'main.tex' AS filename, 0 AS part_no, content FROM latex
UNION ALL SELECT document_id, 'references.bib', part_no, content FROM parts WHERE part_no >= 0 OR content NOT LIKE '%% No papers assigned%'""",
    "assignments bib_papers user_documents",
)
def bundle_export(t):
    latex = bb.latex_document(t.user_documents, assigned(t), author="A. Writer", bib_filename="references")
    return bb.bundle(latex, bb.bibtex_parts(t.user_documents, assigned(t), t.bib_papers, _AT))


# trees: every line of a text is a paragraph with one text node; odd lines cite the document


def _content(t):
    """Tree JSON of each document, built by Spark from its lines."""
    docs = t.documents.withColumn("key", F.concat(F.lit("Key"), F.col("doc_id").cast("string")))
    node = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    empty = F.lit(None).cast("string")
    text = lambda x, i: node(
        type=F.lit("text"), text=x, format=F.when(i % 2 == 1, i % 4).cast("int"),
        citationKey=empty, paperId=empty, title=empty,
    )
    cite = node(
        type=F.lit("citation"), text=empty, format=F.lit(None).cast("int"), citationKey=F.col("key"),
        paperId=F.col("doc_id").cast("string"), title=F.col("source"),
    )
    blocks = F.transform(
        F.split("text", "\n"),
        lambda x, i: node(
            type=F.lit("paragraph"),
            children=F.when(i % 2 == 1, F.array(text(x, i), cite)).otherwise(F.array(text(x, i))),
        ),
    )
    content = F.to_json(F.struct(F.struct(blocks.alias("children")).alias("root")))
    return docs.select("doc_id", "lang", content.alias("content"))


_LINES = """lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"""


@query(
    "tree_plain_text",
    "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS plain FROM documents",
)
def tree_plain_text(t):
    return _content(t).select("doc_id", F.md5(tree.tree_plain_text(F.col("content"))).alias("plain"))


@query(
    "tree_raw_text",
    f"""WITH {_LINES} SELECT doc_id, md5(string_agg(line || CASE WHEN i % 2 = 1 THEN ' ' ELSE '' END, ' ' ORDER BY i)) AS raw FROM lines GROUP BY doc_id""",
)
def tree_raw_text(t):
    return _content(t).select("doc_id", F.md5(tree.node_text(F.col("content"))).alias("raw"))


@query(
    "tree_citations",
    f"""WITH {_LINES} SELECT doc_id, i AS paragraph, CAST(doc_id AS VARCHAR) AS paper_id, concat('Key', doc_id) AS citation_key, source AS title
FROM lines WHERE i % 2 = 1""",
)
def tree_citations(t):
    found = tree.tree_citations(_content(t), "doc_id", "content")
    return found.select("doc_id", F.get("path", 0).cast("long").alias("paragraph"), "paper_id", "citation_key", "title")


@query(
    "tree_nodes",
    f"""WITH {_LINES} SELECT doc_id, count(*) * 2 + CAST(sum(i % 2) AS BIGINT) AS nodes, CAST(sum(i % 2) AS BIGINT) AS citations FROM lines GROUP BY doc_id""",
)
def tree_nodes(t):
    return tree.node_table(_content(t), "doc_id", "content").groupBy("doc_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("type") == "citation").alias("citations")
    )


_TEX = latex_sql("line")


@query(
    "tree_to_latex",
    f"""WITH {_LINES}, rendered AS (SELECT doc_id, i, concat_ws(' ', nullif(CASE WHEN line = '' THEN ''
    WHEN i % 4 = 1 OR i % 4 = 3 THEN concat('\\textbf{{', {_TEX}, '}}') ELSE {_TEX} END, ''),
    CASE WHEN i % 2 = 1 THEN concat('\\cite{{Key', doc_id, '}}') END) AS p FROM lines)
SELECT doc_id, md5(coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (WHERE p <> ''), '')) AS latex FROM rendered GROUP BY doc_id""",
)
def tree_to_latex(t):
    return _content(t).select("doc_id", F.md5(tree.render_latex(F.col("content"))).alias("latex"))


@query(
    "export_markdown",
    f"""WITH {_LINES}, styled AS (SELECT *, CASE i % 4 WHEN 1 THEN concat('**', line, '**') WHEN 3 THEN concat('*', '**', line, '**', '*') ELSE line END AS s FROM lines),
rendered AS (SELECT doc_id, lang, i, concat(s, CASE WHEN i % 2 = 1 THEN concat('\\cite{{Key', doc_id, '}}') ELSE '' END) AS p FROM styled)
SELECT doc_id, md5(concat('# ', lang, {_NL2}, coalesce(string_agg(p || chr(10) || chr(10), '' ORDER BY i) FILTER (WHERE p <> ''), ''))) AS content
FROM rendered GROUP BY doc_id, lang""",
)
def export_markdown(t):
    docs = _content(t).withColumnRenamed("lang", "title")
    return tree.export_documents(docs, "markdown", key="doc_id").withColumn("content", F.md5("content"))


@query(
    "export_plaintext",
    f"""WITH {_LINES} SELECT doc_id, md5(concat(lang, chr(10), repeat('=', length(lang)), {_NL2},
  string_agg(line || CASE WHEN i % 2 = 1 THEN concat('\\cite{{Key', doc_id, '}}') ELSE '' END, chr(10) ORDER BY i))) AS content FROM lines GROUP BY doc_id, lang""",
)
def export_plaintext(t):
    docs = _content(t).withColumnRenamed("lang", "title")
    return tree.export_documents(docs, "txt", key="doc_id").withColumn("content", F.md5("content"))


@query("export_json", "SELECT doc_id, lang AS title, '2024-05-06' AS exported, len(string_split(text, chr(10))) AS blocks FROM documents")
def export_json(t):
    docs = _content(t).withColumnRenamed("lang", "title")
    out = tree.export_documents(docs, "json", "2024-05-06", key="doc_id")
    v = F.parse_json("content")
    blocks = F.size(F.try_variant_get(v, "$.content.root.children", "array<variant>"))
    return out.select(
        "doc_id", F.try_variant_get(v, "$.title", "string").alias("title"),
        F.try_variant_get(v, "$.exportDate", "string").alias("exported"), blocks.cast("long").alias("blocks"),
    )


# the same lines as blocks of five kinds: paragraph, heading, quote, list of one item, code
_KINDS = ("paragraph", "heading", "quote", "list", "code")


def _blocks(t):
    """Tree JSON of each document with nested blocks, built by Spark from its lines."""
    text = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    inner = lambda kind, x, children: F.struct(F.lit(kind).alias("type"), x.alias("text"), children.alias("children"))
    none = F.lit(None).cast("string")

    def block(x, i):
        is_kind = lambda kind: i % 5 == _KINDS.index(kind)
        children = F.when(is_kind("list"), F.array(inner("listitem", none, F.array(text(x))))).when(
            ~is_kind("code"), F.array(inner("text", x, F.array().cast("array<struct<type:string,text:string>>")))
        )
        return F.struct(
            F.element_at(F.array(*map(F.lit, _KINDS)), i % 5 + 1).alias("type"), F.when(is_kind("heading"), "h2").alias("tag"),
            F.when(is_kind("list"), "number").alias("listType"), F.when(is_kind("code"), x).alias("text"), children.alias("children"),
        )

    content = F.to_json(F.struct(F.struct(F.transform(F.split("text", "\n"), block).alias("children")).alias("root")))
    return t.documents.select("doc_id", F.col("lang").alias("title"), content.alias("content"))


@query(
    "blocks_to_latex",
    f"""WITH {_LINES}, rendered AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN {_TEX} WHEN 1 THEN concat('\\subsection{{', {_TEX}, '}}')
    WHEN 2 THEN concat('\\begin{{quote}}', chr(10), {_TEX}, chr(10), '\\end{{quote}}')
    WHEN 3 THEN concat('\\begin{{enumerate}}', chr(10), '  \\item ', {_TEX}, chr(10), '\\end{{enumerate}}')
    ELSE concat('\\begin{{verbatim}}', chr(10), line, chr(10), '\\end{{verbatim}}') END AS p FROM lines)
SELECT doc_id, md5(coalesce(string_agg(p, {_NL2} ORDER BY i) FILTER (WHERE p <> ''), '')) AS latex FROM rendered GROUP BY doc_id""",
)
def blocks_to_latex(t):
    return _blocks(t).select("doc_id", F.md5(tree.render_latex(F.col("content"))).alias("latex"))


@query(
    "blocks_to_markdown",
    f"""WITH {_LINES}, rendered AS (SELECT doc_id, lang, i, CASE i % 5 WHEN 0 THEN CASE WHEN line = '' THEN '' ELSE line || {_NL2} END
    WHEN 1 THEN concat('## ', line, {_NL2}) WHEN 2 THEN concat('> ', line, {_NL2}) WHEN 3 THEN concat('1. ', line, {_NL2})
    ELSE concat('```', chr(10), line, chr(10), '```', {_NL2}) END AS p FROM lines)
SELECT doc_id, md5(concat('# ', lang, {_NL2}, string_agg(p, '' ORDER BY i))) AS content FROM rendered GROUP BY doc_id, lang""",
)
def blocks_to_markdown(t):
    return tree.export_documents(_blocks(t), "markdown", key="doc_id").withColumn("content", F.md5("content"))


@query(
    "blocks_to_text",
    f"""WITH {_LINES} SELECT doc_id, md5(concat(lang, chr(10), repeat('=', length(lang)), {_NL2}, string_agg(line, chr(10) ORDER BY i))) AS content
FROM lines GROUP BY doc_id, lang""",
)
def blocks_to_text(t):
    return tree.export_documents(_blocks(t), "txt", key="doc_id").withColumn("content", F.md5("content"))


@query(
    "blocks_nodes",
    f"""WITH {_LINES} SELECT doc_id, CASE i % 5 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'heading' WHEN 2 THEN 'quote' WHEN 3 THEN 'list' ELSE 'code' END AS kind,
  count(*) AS n, CAST(sum(CASE i % 5 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 2 END) AS BIGINT) AS nodes FROM lines GROUP BY ALL""",
)
def blocks_nodes(t):
    nodes = tree.node_table(_blocks(t), "doc_id", "content")
    top = F.element_at(F.array(*map(F.lit, _KINDS)), F.get("path", 0) % 5 + 1)
    return nodes.groupBy("doc_id", top.alias("kind")).agg(F.count_if(F.size("path") == 1).alias("n"), F.count("*").alias("nodes"))
