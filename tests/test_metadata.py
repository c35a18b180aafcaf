"""Identifiers, feeds, BibTeX, heuristics, resolution."""

import pytest
from pyspark.sql import functions as F

from citespark.functions import citations as cf
from citespark.functions import heuristics as hx
from citespark.functions import identifiers as ids
from citespark.operators import metadata as md
from citespark.sources import feeds


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).collect()[0].x


@pytest.mark.parametrize("raw", ["arXiv:2506.06352v1", "arxiv:2506.06352v1", "2506.06352v1", "arXiv: 2506.06352v1 "])
def test_clean_arxiv(spark, raw):
    assert one(spark, ids.clean_arxiv_id, raw) == "2506.06352v1"


@pytest.mark.parametrize("raw", ["https://doi.org/10.1234/test", "http://doi.org/10.1234/test", "doi:10.1234/test", "10.1234/test", "  10.1234/test  "])
def test_clean_doi(spark, raw):
    assert one(spark, ids.clean_doi, raw) == "10.1234/test"


def test_identifiers(spark):
    text = "See arXiv:2306.12345v1 and https://doi.org/10.1234/example. PMID: 12345678"
    got = one(spark, ids.extract_identifiers, text)
    assert (got.arxiv_id, got.doi, got.pmid) == ("2306.12345v1", "10.1234/example.", "12345678")
    assert one(spark, lambda c: ids.extract_identifiers(c, strip_punct=True), text).doi == "10.1234/example"
    none = one(spark, ids.extract_identifiers, "nothing here")
    assert (none.arxiv_id, none.doi, none.pmid) == (None, None, None)
    far = one(spark, ids.extract_identifiers, "x " * 9000 + "doi:10.9999/far")
    assert far.doi == "10.9999/far"


def test_all_matches_with_offsets(spark):
    text = "12506.063521 arXiv:2506.06352 then doi:10.1/nope doi: 10.1234/a.b, 2506.06352"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = ids.find_all_identifiers(df, "id", "t").collect()
    assert all(text[r.position : r.position + len(r.full_match)] == r.full_match for r in rows)
    found = sorted((r.type, r.position, r.value) for r in rows)
    last = len(text) - len("2506.06352")
    assert found == [
        ("DOI", text.index("doi: 10.1234"), "10.1234/a.b"), ("DOI", text.index("10.1234"), "10.1234/a.b"),
        ("arXiv", text.index("arXiv"), "2506.06352"), ("arXiv", text.index(":2506") + 1, "2506.06352"),
        ("arXiv", last, "2506.06352"),
    ]


def test_word_edges_of_matches_are_ascii(spark):
    df = spark.createDataFrame([(1, "(10.5555/x)10_é1) é2506.06352é")], "id int, t string")
    assert [(r.type, r.value) for r in ids.find_all_identifiers(df, "id", "t").collect()] == [("arXiv", "2506.06352"), ("DOI", "10.5555/x)10_")]


ATOM = """<entry xmlns="http://www.w3.org/2005/Atom"><category term="math.CO"/><published>2019-11-30T18:20:05Z</published>
<link rel="alternate" href="http://arxiv.org/abs/9"/><link title="pdf" type="application/pdf" href="http://arxiv.org/pdf/9"/>
<link title="doi" href="https://doi.org/10.77/knots.5"/><author><name> Olu Adeyemi </name></author><author><name/></author>
<title>On  knots
   and braids</title><summary>
 We count
 knots. </summary></entry>"""


def test_atom_entry(spark):
    r = feeds.map_atom_entry(spark.createDataFrame([(ATOM,)], "x string"), "x").collect()[0]
    assert (r.title, r.authors, r.abstract, r.year) == ("On knots and braids", ["Olu Adeyemi"], "We count knots.", 2019)
    assert (r.doi, r.pdf_url, r.categories, r.venue) == ("10.77/knots.5", "http://arxiv.org/pdf/9", ["math.CO"], "arXiv (math.CO)")


def test_works_record(spark):
    full = """{"title":["A title"],"author":[{"given":"J","family":"Doe"},{"family":"Lee"},{"sequence":"first"}],"abstract":"abs",
    "published-print":{"date-parts":[[2023,6]]},"container-title":["Nature"],"publisher":"P","URL":"http://u","is-referenced-by-count":42}"""
    online = '{"published-online":{"date-parts":[[2023,12,1]]}}'
    empty_print = '{"published-print":{"date-parts":[[]]},"published-online":{"date-parts":[[2022]]}}'
    rows = feeds.map_works_record(spark.createDataFrame([(1, full), (2, online), (3, empty_print), (4, "{bad")], "i int, j string"), "j").orderBy("i").collect()
    a = rows[0]
    assert (a.title, a.authors, a.abstract, a.year, a.journal, a.publisher, a.url, a.citation_count) == (
        "A title", ["J Doe", "Lee"], "abs", 2023, "Nature", "P", "http://u", 42)
    assert [r.year for r in rows] == [2023, 2023, None, None]
    assert rows[1].authors is None


def test_bibtex(spark):
    text = """@article{test2024,
  title = {A {Great Paper}},
  author = {Doe, John and Smith, Jane and Solo},
  year = {2024}, booktitle = {Proc of X}, doi = {10.1/x}, eprint = {2401.00001} }"""
    r = feeds.parse_bibtex(spark.createDataFrame([(text,)], "t string"), "t").collect()[0]
    assert (r.title, r.authors, r.year) == ("A Great Paper", ["John Doe", "Jane Smith", "Solo"], 2024)
    assert (r.journal, r.doi, r.arxiv_id, r.source) == ("Proc of X", "10.1/x", "2401.00001", "bibtex")


PAPER = """Journal of Things, vol. 3
http://example.org/x
Deep Learning Methods for Ancient Texts
Ana María Berg1, Bo Lee (MIT)*

Abstract
We study old texts.
They are old.
1. Introduction
More text from 2019 and 2024."""


def test_heuristics(spark):
    m = one(spark, hx.extract_metadata, PAPER)
    assert m.title == "Deep Learning Methods for Ancient Texts"
    assert m.authors == ["Ana María Berg", "Bo Lee"]
    assert m.abstract == "We study old texts. They are old."
    assert m.year == 2024


def test_heading_wins_and_inline_abstract(spark):
    text = "Some First Line With Capitals\n# The Real Heading of It\nJo Roe and Al Doe\nabstract: " + "w" * 60 + "\nend"
    m = one(spark, hx.extract_metadata, text)
    assert (m.title, m.authors, m.abstract, m.year) == ("The Real Heading of It", ["Jo Roe", "Al Doe"], "w" * 60, None)
    block = one(spark, hx.extract_metadata, "an Abstract view\n" + "a" * 30 + "\n" + "b" * 30 + "\n\nrest")
    assert block.abstract == "a" * 30 + " " + "b" * 30


@pytest.mark.parametrize("line,want", [
    ("A, B", False), ("Ana Berg, Bo Lee", True), ("one two three four five six, a b c d e f", False), ("Ana and Bo", True), ("Plain title", False),
])
def test_author_lines(spark, line, want):
    assert one(spark, hx.looks_like_authors, line) is want


@pytest.mark.parametrize("authors,year,title,key", [
    (["Ana Berg"], 2020, "The Art of War", "Berg2020Art"), ([], None, "of the in", "Unknown0000"),
    (None, 0, "12 Monkeys", "Unknown0000Monkeys"), (["O'Neil, Dee"], 1999, "a-b c", "Dee1999ab"), ([""], 2001, None, "Unknown2001"),
])
def test_citation_key(spark, authors, year, title, key):
    df = spark.createDataFrame([(authors, year, title)], "a array<string>, y int, t string")
    assert df.select(cf.citation_key(F.col("a"), F.col("y"), F.col("t"))).collect()[0][0] == key


@pytest.mark.parametrize("authors,year,title,key", [
    (["Ana Berg"], 2020, "the mACHINE", "Berg2020Machine"), (None, None, "and or", "Paper_abcdefgh"), (["Ed X"], None, "", "Paper_abcdefgh"),
])
def test_editor_key(spark, authors, year, title, key):
    df = spark.createDataFrame([(authors, year, title, "abcdefghij")], "a array<string>, y int, t string, p string")
    assert df.select(cf.citation_key_editor(*[F.col(c) for c in "aytp"])).collect()[0][0] == key


def test_display_text(spark):
    df = spark.createDataFrame([(["Test Author"], 2023), (["A B", "C"], 2020), (None, None), (["Berg, Ana"], 1)], "a array<string>, y int")
    assert [r[0] for r in df.select(cf.display_text(F.col("a"), F.col("y"))).collect()] == [
        "(Author, 2023)", "(B et al., 2020)", "(Unknown, 0)", "(Ana, 1)"]
    assert df.select(cf.display_text(F.col("a"), F.col("y"), "last_first")).collect()[3][0] == "(Berg, 1)"


def test_resolution_priority(spark):
    papers = spark.createDataFrame([(i, f"own {i}", 1990, None) for i in range(4)], "paper_id long, title string, year int, doi string")
    found = spark.createDataFrame([(0, "a0", "d0"), (1, "zz", "d1"), (2, None, "d2")], "paper_id long, arxiv_id string, doi string")
    arxiv = spark.createDataFrame([("a0", "feed", None)], "arxiv_id string, title string, year int")
    works = spark.createDataFrame([("d0", "work0"), ("d1", "work1")], "doi string, title string")
    text = spark.createDataFrame([(2, "guess", 2001)], "paper_id long, title string, year int")
    rows = {r.paper_id: r for r in md.resolve_metadata(papers, found, arxiv, works, text).collect()}
    assert [(rows[i].title, rows[i].metadata_source) for i in range(4)] == [
        ("feed", "arxiv"), ("work1", "crossref"), ("guess", "text_extraction"), ("own 3", "text_extraction")]
    assert [rows[i].year for i in range(4)] == [1990, 1990, 2001, 1990]
    assert [rows[i].doi for i in range(4)] == ["d0", "d1", "d2", None]
