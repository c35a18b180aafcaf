"""No row is lost, multiplied or garbled: copies in a batch, repeated keys, bad bytes, missing versions, vector sizes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citespark.functions.text import contains_pattern
from citespark.operators import bibliography as bb
from citespark.operators import library as lb
from citespark.operators import maintenance as mt
from citespark.operators import metadata as md
from citespark.operators import similarity as sim
from citespark.operators import sync as sy
from citespark.sources import feeds
from citespark.sources import files as fi


def test_every_upload_gets_an_answer(spark):
    rows = [("/a/x.txt", "x.txt", "h1"), ("/a/y.txt", "y.txt", "h1"), ("/a/z.txt", "z.txt", "h1"), ("/b/k.txt", "k.txt", "h2")]
    files = spark.createDataFrame(rows, "path string, filename string, file_hash string")
    papers = spark.createDataFrame([(7, "h2"), (8, None)], "paper_id long, file_hash string")
    fresh, duplicates = fi.dedupe_by_hash(files, papers)
    assert [r["file_path"] for r in fresh.collect()] == ["/a/x.txt"]
    got = sorted(tuple(r) for r in duplicates.select("file_path", "paper_id", "first_path").collect())
    assert got == [("/a/y.txt", None, "/a/x.txt"), ("/a/z.txt", None, "/a/x.txt"), ("/b/k.txt", 7, None)]


def test_bad_bytes_are_an_error_row(spark):
    rows = [("a.txt", bytearray(b"caf\xc3\xa9")), ("b.txt", bytearray(b"caf\xe9")), ("c.txt", bytearray(b""))]
    files = spark.createDataFrame(rows, "path string, content binary").withColumn("extension", F.lit(".txt"))
    got = {r["path"]: (r["full_text"], r["processing_error"] is None) for r in fi.decode_text(files).collect()}
    assert got == {"a.txt": ("café", True), "b.txt": (None, False), "c.txt": ("", False)}


@pytest.mark.parametrize("needle, hits", [("C:\\dir", 1), ("\\", 2), ("c:%F", 1), ("none\\", 0)])
def test_backslash_in_a_needle(spark, needle, hits):
    df = spark.createDataFrame([("open c:\\DIR\\f",), ("a \\ b",), ("plain",)], "t string")
    assert df.filter(contains_pattern(F.col("t"), needle)).count() == hits


def test_repeated_keys_do_not_multiply_rows(spark):
    papers = spark.createDataFrame([(1, "T", False, None, None), (2, "U", False, None, None)],
                                   "paper_id long, title string, is_processed boolean, processing_error string, updated_at timestamp_ntz")
    outcomes = spark.createDataFrame([(1, None), (1, "broken"), (1, "broken")], "paper_id long, error string")
    rows = {r["paper_id"]: r for r in mt.apply_outcomes(papers, outcomes, "2024-01-01 00:00:00").collect()}
    assert len(rows) == 2 and rows[1]["processing_error"] == "broken" and rows[2]["updated_at"] is None
    patches = spark.createDataFrame([(1, "A", True), (1, "B", True), (1, None, False), (2, None, True)], "paper_id long, title string, set_title boolean")
    assert sorted((r["paper_id"], r["title"]) for r in lb.patch_rows(papers, patches, "paper_id", ["title"]).collect()) == [(1, "B"), (2, None)]
    resolved = spark.createDataFrame([(1, "N"), (1, "M")], "paper_id long, title string")
    assert sorted((r["paper_id"], r["title"]) for r in mt.merge_metadata(papers, resolved, ["title"]).collect()) == [(1, "N"), (2, "U")]
    pairs = spark.createDataFrame([(1, 1, 0, None), (1, 2, 1, "n")], "document_id long, paper_id long, position int, notes string")
    wanted = spark.createDataFrame([(1, 1, 4), (1, 1, 5)], "document_id long, paper_id long, new_position int")
    assert sorted((r["paper_id"], r["position"]) for r in bb.reorder(pairs, wanted)[0].collect()) == [(1, 5), (2, 1)]
    notes = spark.createDataFrame([(1, 1, "a", None), (1, 1, "b", 3)], "document_id long, paper_id long, notes string, position int")
    assert sorted((r["paper_id"], r["notes"], r["position"]) for r in bb.update_assignments(pairs, notes).collect()) == [(1, "b", 3), (2, "n", 1)]


def test_lookup_tables_with_repeated_keys(spark):
    papers = spark.createDataFrame([(1, "own")], "paper_id long, title string")
    idents = spark.createDataFrame([(1, None, "10.1/a"), (1, None, "10.1/a")], "paper_id long, arxiv_id string, doi string")
    works = spark.createDataFrame([("10.1/a", "W1"), ("10.1/a", "W2")], "doi string, title string")
    none = spark.createDataFrame([], "arxiv_id string, title string")
    guess = spark.createDataFrame([(1, "g"), (1, "h")], "paper_id long, title string")
    rows = md.resolve_metadata(papers, idents, none, works, guess).collect()
    assert [(r["title"], r["metadata_source"]) for r in rows] == [("W2", "crossref")]


def test_a_title_is_no_header(spark):
    latex = spark.createDataFrame([(1, "x"), (2, "y")], "document_id long, content string")
    parts = spark.createDataFrame(
        [(1, -1, "% head"), (1, 0, "title = {No papers assigned here}"), (2, -1, bb.NO_PAPERS)], "document_id long, part_no int, content string"
    )
    got = sorted((r["document_id"], r["part_no"]) for r in bb.bundle(latex, parts).filter("filename = 'references.bib'").collect())
    assert got == [(1, -1), (1, 0)]


BIB = [
    ("{Don't stop the {DNA} story}", "Don't stop the DNA story"), ('"A {"}quoted{"} word"', 'A "quoted" word'),
    ("{one, two = three}", "one, two = three"), ("plain", "plain"), ("{{Deep {inner {braces}}}}", "Deep inner braces"), ("{}", None),
    ("{never closed", "never closed"),
]


@pytest.mark.parametrize("value, title", BIB)
def test_bibtex_values_are_whole(spark, value, title):
    entry = f"@article{{k,\n  booktitle = {{Other}},\n  title = {value},\n  author = {{Dee O'Neil and Bo Lee}}\n}}"
    if value == "{never closed":
        entry = "@article{k,\n title = {never closed"
    row = feeds.parse_bibtex(spark.createDataFrame([(entry,)], "t string"), "t").first()
    assert row["title"] == title
    if "author" in entry:
        assert row["authors"] == ["Dee O'Neil", "Bo Lee"]


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


@pytest.mark.parametrize("few", [4096, 1])
def test_vectors_of_another_length_are_an_error(spark, few):
    good = vectors(spark, [(i, [1.0, float(i), 0.5]) for i in range(4)], "chunk_id")
    mixed = vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0])], "query_id")
    options = {"k": 2, "min_similarity": 0.1, "broadcast_queries": few, "n_cells": 2}
    with pytest.raises(ValueError, match="expected query vectors of"):
        sim.similarity_join(mixed, good, **options).collect()
    queries = vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id")
    with pytest.raises(ValueError, match="of 5 dimensions"):
        sim.similarity_join(queries, good, dim=5, **options)
    odd = good.union(vectors(spark, [(9, [1.0, 2.0])], "chunk_id"))
    with pytest.raises(PySparkException, match="expected 3 dimensions, got 2"):
        sim.similarity_join(queries, odd, **options).collect()
    unset = good.union(vectors(spark, [(9, None), (10, [])], "chunk_id"))
    assert sim.similarity_join(queries, unset, **options).count() == sim.similarity_join(queries, good, **options).count()


def test_collections_belong_to_their_user(spark):
    selected = spark.createDataFrame([(1, 0, "K", None), (2, 0, "K", None), (3, 0, "K", None)], "user_id long, position int, collection_key string, library_id string")
    held = [(1, "K", "groups/1", 0), (1, "K", "groups/5", 1), (2, "K", "groups/2", 0)]
    collections = spark.createDataFrame(held, "user_id long, collection_key string, library_id string, library_order int")
    got = sorted((r["user_id"], r["library_id"] or "") for r in sy.locate_collections(selected, collections).collect())
    assert got == [(1, "groups/5"), (2, "groups/2"), (3, "")]
    got = sorted((r["user_id"], r["library_id"]) for r in sy.migrate_collections(selected, collections).collect())
    assert got == [(1, "groups/1"), (2, "groups/2")]


def test_closed_sets_of_log_rows(spark):
    rows = [("INFO", "API"), ("info", "SEARCH"), (None, "SYSTEM"), ("ERROR", "OTHER")]
    logs = spark.createDataFrame(rows, "level string, category string")
    papers = spark.createDataFrame([], "paper_id long, doi string, year int")
    pairs = spark.createDataFrame([], "document_id long, paper_id long")
    state = spark.createDataFrame([], "user_id long, item_key string")
    chunks = spark.createDataFrame([], "paper_id long, embedding array<float>")
    got = {r["rule"]: r["violations"] for r in mt.check_constraints(papers, pairs, state, chunks, 3, logs).collect()}
    assert got["log level"] == 2 and got["log category"] == 1
