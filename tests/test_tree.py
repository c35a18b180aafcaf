"""Editor trees: rendering of literal documents."""

import json
import time

import pytest
from pyspark.sql import functions as F

from citespark.operators import tree


def text(x, f=0):
    return {"type": "text", "text": x, "format": f}


def node(kind, *children, **more):
    return {"type": kind, "children": list(children), **more}


CITE = {"type": "citation", "citationKey": "K1", "paperId": "p1", "title": "t", "authors": ["A"], "year": 2020}
DOC = {"root": {"children": [
    node("heading", text("Intro & more"), CITE, tag="h2"),
    node("paragraph", text("bold", 1), text("ital", 2), text(""), text("both", 3), node("link", text("a_b"), text("c"))),
    node("paragraph"),
    node("list", node("listitem", node("paragraph", text("x"), {"type": "citation", "paperId": "p9"})),
         node("listitem", text("y"), text("z", 24)), listType="number"),
    node("quote", text("q%")),
    {"type": "code", "text": "raw_code", "children": []},
    node("box", node("paragraph", text("in1")), node("paragraph"), node("paragraph", text("in2"))),
    {"type": "citation"},
]}}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Ti", json.dumps(DOC)), (2, "Bad", "{nope"), (3, "None", None), (4, "Odd", '{"x":1}')]
    return spark.createDataFrame(rows, "document_id long, title string, content string")


def render(docs, col):
    return docs.select(col.alias("x")).collect()[0].x


def test_latex(docs):
    assert render(docs, tree.render_latex(F.col("content"))) == "\n\n".join([
        "\\subsection{Intro \\& more \\cite{K1}}",
        "\\textbf{bold} \\textit{ital} \\textbf{both} a_b c",
        "\\begin{enumerate}\n  \\item x \\cite{p9}\n  \\item y z\n\\end{enumerate}",
        "\\begin{quote}\nq\\%\n\\end{quote}",
        "\\begin{verbatim}\nraw_code\n\\end{verbatim}",
        "in1 in2",
        "\\cite{unknown}",
    ])


def test_markdown(docs):
    assert render(docs, tree.render_markdown(F.col("content"), F.col("title"))) == (
        "# Ti\n\n## Intro & more\\cite{K1}\n\n**bold***ital****both***a_bc\n\n"
        "1. x\\cite{p9}\n\n\n2. y`~~z~~`\n\n> q%\n\n```\nraw_code\n```\n\nin1\n\nin2\n\n\\cite{unknown}"
    )


def test_text_and_json(docs):
    assert render(docs, tree.render_text(F.col("content"), F.col("title"))) == (
        "Ti\n==\n\nIntro & more\\cite{K1}\nbolditalbotha_bc\n\nx\\cite{p9}yz\nq%\nraw_code\nin1in2\n\\cite{unknown}"
    )
    got = json.loads(render(docs, tree.render_json(F.col("content"), F.col("title"), "NOW")))
    assert got == {"title": "Ti", "content": DOC, "exportDate": "NOW"}


def test_plain_and_raw_text(docs):
    assert render(docs, tree.tree_plain_text(F.col("content"))) == "Intro & more bold ital  both a_b c x y z q% in1 in2"
    rest = docs.filter("document_id > 1").select(
        tree.tree_plain_text(F.col("content")).alias("p"), tree.render_latex(F.col("content")).alias("l")
    )
    assert [(r.p, r.l) for r in rest.collect()] == [("", "")] * 3


def test_citations_and_nodes(docs):
    got = sorted((r.path, r.paper_id, r.citation_key, r.authors, r.year) for r in tree.tree_citations(docs, "document_id", "content").collect())
    assert got == [([0, 1], "p1", "K1", ["A"], 2020), ([3, 0, 0, 1], "p9", "", [], None), ([7], None, "", [], None)]
    assert tree.node_table(docs, "document_id", "content").count() == 30


def test_nested_deeply(spark):
    inner = text("deep")
    for _ in range(40):
        inner = node("box", inner)
    df = spark.createDataFrame([(json.dumps({"root": {"children": [inner]}}),)], "c string")
    assert df.select(tree.tree_plain_text(F.col("c"))).collect()[0][0] == "deep"


def test_exports(docs):
    assert tree.export_documents(docs, "txt").count() == 4
    assert tree.latex_bodies(docs).count() == 3


MARKS = "a\ue000b\ue007\ue008c\ue010\ue008\ue008\ue018"


def test_private_characters_are_text(spark):
    content = json.dumps({"root": {"children": [
        {"type": "paragraph", "children": [{"type": "text", "text": MARKS}, {"type": "citation", "citationKey": "k\ue003"}]},
        {"type": "heading", "tag": "h2", "children": [{"type": "text", "text": "\ue003"}]},
    ]}})
    df = spark.createDataFrame([(1, content, "T")], "document_id int, content string, title string")
    row = df.select(
        tree.tree_plain_text(F.col("content")).alias("plain"), tree.node_text(F.col("content")).alias("raw"),
        tree.render_latex(F.col("content")).alias("latex"), tree.render_markdown(F.col("content"), F.col("title")).alias("md"),
        tree.render_text(F.col("content"), F.col("title")).alias("txt"),
    ).first()
    assert row["plain"] == f"{MARKS} \ue003"
    assert row["raw"].startswith(MARKS)
    assert row["latex"] == f"{MARKS} \\cite{{k\ue003}}\n\n\\subsection{{\ue003}}"
    assert row["md"] == f"# T\n\n{MARKS}\\cite{{k\ue003}}\n\n## \ue003\n\n"
    assert row["txt"] == f"T\n=\n\n{MARKS}\\cite{{k\ue003}}\n\ue003"
    assert [r["text"] for r in tree.node_table(df, "document_id", "content").collect() if r["text"]] == [MARKS, "\ue003"]


def long_document(paragraphs, levels):
    inner = text("deep")
    for _ in range(levels):
        inner = node("quote", inner)
    kids = [node("paragraph", text(f'{{a}} "b{i}" \\ {{'), {"type": "citation", "citationKey": f"k{i}"}) for i in range(paragraphs)]
    return json.dumps({"root": {"children": [*kids, inner]}})


def test_depth_of_braces(spark):
    rows = [("", 0), ("{}", 1), ('{"a":{"b":{}},"c":{}}', 3), ('{"a{{":"}{{{\\"{{"}', 1), (r'{"a":"\\","b":{"c":"\""}}', 2), ("}}{", 0)]
    df = spark.createDataFrame(rows, "c string, n int")
    assert [r.d for r in df.select(tree.depth(F.col("c")).alias("d")).collect()] == [n for _, n in rows]


def test_long_and_deep_documents(spark):
    """Work grows with the nodes: each length takes well under three times that of half of it."""
    seconds = []
    for paragraphs in (4_000, 8_000, 16_000):
        df = spark.createDataFrame([(long_document(paragraphs, 480),)], "c string").cache()
        assert df.count() == 1
        took = []
        for _ in range(2):
            start = time.time()
            row = df.select(F.size(tree.unfold(F.col("c"), "", tree._keep_mode)).alias("n"), tree.render_latex(F.col("c")).alias("latex")).first()
            took.append(time.time() - start)
        seconds.append(min(took))
        assert row["n"] == 3 * paragraphs + 481
        assert row["latex"].count("\\cite{") == paragraphs and row["latex"].startswith('\\{a\\} "b0"')
    assert seconds[2] < 3 * seconds[1] + 1 and seconds[1] < 3 * seconds[0] + 1


@pytest.mark.parametrize("levels", [1, 64, 70, 200, 480])
def test_depth_has_no_limit(spark, levels):
    node = {"type": "text", "text": "deep"}
    for _ in range(levels):
        node = {"type": "quote", "children": [node]}
    df = spark.createDataFrame([(1, json.dumps({"root": {"children": [node]}}))], "document_id int, content string")
    assert df.select(tree.tree_plain_text(F.col("content"))).first()[0] == "deep"
    assert tree.node_table(df, "document_id", "content").count() == levels + 1


def test_levels_do_not_multiply_the_nodes(spark):
    """One deep chain beside many paragraphs costs about as much as the paragraphs alone."""
    seconds = []
    for levels in (2, 480):
        df = spark.createDataFrame([(1, "T", long_document(40_000, levels))], "document_id int, title string, content string").cache()
        assert df.count() == 1
        took = []
        for _ in range(3):
            start = time.time()
            row = tree.export_documents(df, "txt").first()
            took.append(time.time() - start)
        seconds.append(min(took))
        lines = row["content"].split("\n")
        assert lines[:4] == ["T", "=", "", '{a} "b0" \\ {\\cite{k0}'] and len(lines) == 3 + 40_001 and lines[-1] == "deep"
    assert seconds[1] < 2 * seconds[0] + 0.5


@pytest.mark.parametrize("levels", range(8))
def test_children_of_any_kind_at_any_level(spark, levels):
    kids = ["s", 3, None, [1], {}, {"type": "text", "text": 1.5, "format": 4294967297}, {"type": "x", "children": "s"}, {"text": "y", "children": [7]}]
    for _ in range(levels):
        kids = [node("box", *kids)]
    df = spark.createDataFrame([(1, "T", json.dumps({"root": {"children": kids}}))], "document_id int, title string, content string")
    got = [(r["path"][levels:], r["type"], r["text"], r["format"], r["n_children"]) for r in tree.node_table(df, "document_id", "content").collect() if len(r["path"]) > levels]
    assert sorted(got) == [
        *[([i], "", None, 0, 0) for i in range(5)], ([5], "text", "1.5", 0, 0), ([6], "x", None, 0, 0), ([7], "", "y", 0, 1), ([7, 0], "", None, 0, 0)
    ]
    text = "\n\n\n\n\n1.5\n\n" if levels == 0 else "1.5"
    assert tree.export_documents(df, "txt").first()["content"] == f"T\n=\n\n{text}"
