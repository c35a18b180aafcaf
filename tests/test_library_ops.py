"""Library sync, bibliography, maintenance, intake and time windows on small literal tables."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citespark.operators import bibliography as bb
from citespark.operators import library as lb
from citespark.operators import logs as lg
from citespark.operators import maintenance as mt
from citespark.operators import sync as sy
from citespark.operators import timeline as tl
from citespark.operators.embedding import embedding_with, hashed_embedder
from citespark.plans import ingest as ing
from citespark.plans.library_sync import run_sync
from citespark.sources import files as fi
from citespark.sources.library_items import ITEM_SCHEMA
from citespark.streaming.ingest import SNAPSHOT_SCHEMA, STATE_SCHEMA

# sync -----------------------------------------------------------------------------


def raw(key, version, seq, kind="journalArticle", **data):
    base = {"itemType": kind, "title": f"t{key}", "creators": []}
    return {"key": key, "version": version, "library_id": "users/1", "seq": seq, "data": {**base, **data}}


def items(spark, rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    return lines.select(F.from_json("j", ITEM_SCHEMA + ", seq long").alias("x")).select("x.*")


def snapshot(spark, *rows):
    names = [c.split()[0] for c in SNAPSHOT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SNAPSHOT_SCHEMA)


def test_items_without_a_version_are_synchronised(spark):
    rows = [raw("A", None, 1), raw("B", 9, 2), raw("C", 3, 3), raw("D", None, 4)]
    state = spark.createDataFrame([("u", "D", 0, "p1")], STATE_SCHEMA)
    run = run_sync(items(spark, rows), snapshot(spark, dict(paper_id="p1", title="d", item_key="D")), state, "u", mark=5)
    assert {r.item_key: r.action for r in run.plan.collect()} == {"A": "insert", "B": "insert", "D": "skip"}
    assert run.rejects.count() == 0 and run.mark.first()["mark"] == 9


def test_sync_actions_and_idempotence(spark):
    papers = snapshot(
        spark,
        dict(paper_id="p1", title="old", year=1990, doi="10.1/old", citation_count=7, source="upload", source_url="keep"),
        dict(paper_id="p2", title="", authors=[], doi="10.1/b", citation_count=3),
        dict(paper_id="p3", title="same", item_key="C"),
    )
    state = spark.createDataFrame([("u", "A", 1, "p1"), ("u", "C", 5, "p3"), ("other", "B", 9, "p9")], STATE_SCHEMA)
    rows = [
        raw("A", 2, 1, DOI="", date="2001"),
        raw("B", 1, 2, DOI="10.1/b", creators=[{"creatorType": "author", "firstName": "", "lastName": "Lee"}]),
        raw("C", 5, 3), raw("C2", 4, 4),
        raw("D", 1, 5, DOI="10.1/new", title="", abstractNote="first abstract"),
        raw("E", 1, 6, DOI="10.1/new", title="second title", abstractNote="second abstract"),
        raw("N", 1, 7, kind="note"), raw("P", 1, 8, kind="attachment", contentType="application/pdf", parentItem="D"),
        raw("P2", 1, 9, kind="attachment", contentType="application/pdf", parentItem="D"),
    ]
    run = run_sync(items(spark, rows), papers, state, "u")
    plan = {r.item_key: (r.action, r.paper_id) for r in run.plan.collect()}
    assert plan == {
        "A": ("update", "p1"), "B": ("link", "p2"), "C": ("skip", "p3"), "C2": ("insert", "new-C2"),
        "D": ("insert", "new-D"), "E": ("link", "new-D"),
    }
    got = {r.paper_id: r for r in run.papers.collect()}
    assert len(got) == 5
    a, b, d = got["p1"], got["p2"], got["new-D"]
    # known items: every mapped field is overwritten, but a missing url is not one
    assert (a.title, a.year, a.doi, a.citation_count, a.source, a.source_url) == ("tA", 2001, None, 0, "zotero", "keep")
    # links fill gaps only
    assert (b.title, b.authors, b.citation_count, b.source) == ("tB", ["Lee"], 3, "zotero")
    assert (d.title, d.abstract, d.item_key) == ("second title", "first abstract", "D")
    first = {r.item_key: r.attachment_key for r in run.attachments.collect()}
    assert first["D"] == "P" and first["A"] is None
    again = run_sync(items(spark, rows), run.papers, run.state, "u")
    assert {r.action for r in again.plan.collect()} == {"skip"}
    assert sorted(map(str, again.papers.collect())) == sorted(map(str, run.papers.collect()))


def test_sync_hot_doi(spark):
    """A third of all items share one DOI; one paper comes out, complete."""
    n = 300
    rows = [raw(f"K{i}", 1, i, DOI="10.1/hot" if i % 3 == 0 else f"10.2/{i}", title="" if i < 30 else f"t{i}") for i in range(n)]
    run = run_sync(items(spark, rows), snapshot(spark), spark.createDataFrame([], STATE_SCHEMA), "u")
    counts = {r.action: r["items"] for r in run.counts.collect()}
    assert counts == {"insert": 201, "link": 99}
    hot = run.papers.filter("doi = '10.1/hot'").collect()
    assert [(r.paper_id, r.title) for r in hot] == [("new-K0", "t30")]


def test_selection_formats(spark):
    texts = ['[{"libraryId":"groups/17","key":"QX7"}]', '["QX7","RT2"]', "{bad", None, "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "user_id long, sel string")
    rows = sorted((r.user_id, r.collection_key, r.library_id) for r in sy.parse_selection(df, "sel").collect())
    assert rows == [(0, "QX7", "groups/17"), (1, "QX7", None), (1, "RT2", None)]


# bibliography -----------------------------------------------------------------------


@pytest.mark.parametrize("legacy,want", [(True, [0, 0, 0]), (False, [0, 1, 2])])
def test_positions_one_by_one(spark, legacy, want):
    have = spark.createDataFrame([], "document_id long, paper_id long, position int")
    got = []
    for i in range(3):
        new = spark.createDataFrame([(1, i, 0)], "document_id long, paper_id long, seq long")
        out = bb.assign_positions(new, have, "seq", legacy).collect()
        got.append(out[0].position)
        have = spark.createDataFrame([(1, p, q) for p, q in enumerate(got)], have.schema)
    assert got == want


def test_requested_position_wins(spark):
    have = spark.createDataFrame([(1, 5, 3)], "document_id long, paper_id long, position int")
    new = spark.createDataFrame([(1, 6, 0, None), (1, 7, 1, 0)], "document_id long, paper_id long, seq long, position int")
    got = bb.assign_positions(new, have, "seq").collect()
    assert sorted((r.paper_id, r.position) for r in got) == [(6, 4), (7, 0)]


def test_positions_of_a_hot_document(spark):
    """One document takes most requests; its numbering crosses many buckets."""
    rows = [(1, i, i * 7) for i in range(3000)] + [(2, 5, 1)]
    new = spark.createDataFrame(rows, "document_id long, paper_id long, seq long")
    have = spark.createDataFrame([(1, -1, 4)], "document_id long, paper_id long, position int")
    got = bb.assign_positions(new, have, "seq").filter("document_id = 1").orderBy("seq").collect()
    assert [r.position for r in got] == list(range(5, 3005))


def papers_table(spark):
    row = (1, "A {B}", ["Ana Lee"], 2020, None, None, "2001.00001", None, None, 'say "x"\ny')
    schema = ("paper_id long, title string, authors array<string>, year int, journal string, doi string, "
              "arxiv_id string, pubmed_id string, source_url string, abstract string")
    return spark.createDataFrame([row], schema)


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "My Doc", None, "50% x"), (2, "Empty", "d", None)], "document_id long, title string, description string, plain_text string")
    rows = spark.createDataFrame([(1, 1, 0, "read")], "document_id long, paper_id long, position int, notes string")
    bib = bb.bibtex_parts(docs, rows, papers_table(spark), "NOW")
    parts = {(r.document_id, r.part_no): r.content for r in bib.collect()}
    assert parts[(2, -1)] == "% No papers assigned to this document\n"
    assert parts[(1, -1)] == "% BibTeX export for document: My Doc\n\n% Generated on: NOW\n\n% Total papers: 1\n\n"
    assert parts[(1, 0)] == (
        "% Notes: read\n@misc{Lee2020B,\n  title = {A {B}},\n  author = {Ana Lee},\n  year = {2020},\n"
        "  eprint = {2001.00001},\n  archivePrefix = {arXiv},\n  abstract = {say ''x'' y}\n}\n"
    )
    tex = bb.latex_document(docs, rows, author="N")
    body = {r.document_id: r.content for r in tex.collect()}
    assert "50\\% x\n\n\\bibliographystyle{plain}\n\\bibliography{My_Doc_bibliography}\n\n\\end{document}" in body[1]
    assert "\\begin{abstract}\nd\n\\end{abstract}" in body[2] and "bibliography" not in body[2]
    names = sorted((r.document_id, r.filename) for r in bb.bundle(tex, bib).collect())
    assert names == [(1, "main.tex"), (1, "references.bib"), (1, "references.bib"), (2, "main.tex")]
    bb.write_parts(bib, str(tmp_path / "bib"), buckets=4)
    text = "".join(r.content for r in bb.read_parts(spark, str(tmp_path / "bib"), buckets=4, document_id=1).collect())
    assert text.startswith("% BibTeX export for document: My Doc\n") and "@misc{Lee2020B,\n" in text


def test_reorder_reports_unknown(spark):
    have = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "document_id long, paper_id long, position int")
    orders = spark.createDataFrame([(1, [12, 99, 10])], "document_id long, paper_ids array<long>")
    out, unknown = bb.reorder(have, bb.order_rows(orders))
    assert sorted((r.paper_id, r.position) for r in out.collect()) == [(10, 2), (11, 1), (12, 0)]
    assert [r.paper_id for r in unknown.collect()] == [99]


# maintenance --------------------------------------------------------------------------


def test_bulk_delete(spark):
    docs = spark.createDataFrame([(i, 1 if i < 5 else 2) for i in range(7)], "document_id long, owner_id long")
    for wanted, gone in (([0, 1, 2], 3), ([0, 5], 1), ([], 0)):
        ids = spark.createDataFrame([(w,) for w in wanted], "document_id long")
        rest, counts = mt.bulk_delete(docs, ids, 1)
        assert counts.collect()[0].asDict() == {"deleted_count": gone, "requested_count": len(wanted)}
        assert rest.count() == 7 - gone


def test_clear_documents(spark):
    docs = spark.createDataFrame([(i, i % 2) for i in range(6)], "document_id long, owner_id long")
    empty, log = mt.clear_tables({"documents": docs}, "2024-01-01 00:00:00")
    assert empty["documents"].count() == 0 and empty["documents"].schema == docs.schema
    assert log.collect()[0].message == "cleared documents: 6"


def test_statistics_of_nothing(spark):
    schema = "paper_id long, file_path string, is_processed boolean, processing_error string"
    none = spark.createDataFrame([], schema)
    chunks = spark.createDataFrame([], "paper_id long")
    assert lb.queue_status(none).collect()[0].progress_percentage == 0.0
    stats = lb.processing_statistics(none, chunks).collect()[0]
    assert (stats.total, stats.processed, stats.progress) == (0, None, 0.0)
    assert lb.page_totals(none, 10).collect()[0].pages == 0


def test_sort_orders(spark):
    rows = [(1, "Zoo", None), (2, "apple", 5), (3, "Äpfel", 9), (4, "Banane", 9)]
    df = spark.createDataFrame(rows, "paper_id long, title string, citation_count int")
    assert [r.paper_id for r in lb.sort_library(df, "title").collect()] == [3, 2, 4, 1]
    assert [r.paper_id for r in lb.sort_library(df, "citations").collect()] == [3, 4, 2, 1]


def test_log_sinks(spark, tmp_path):
    out = spark.createDataFrame(
        [(1, None, None, None), (2, "IOError", "no file", "trace")],
        "entity_id long, error_type string, error_message string, error_trace string",
    )
    rows = lg.log_rows(out, "SYNC", F.lit("done"), "2024-01-01 00:00:00")
    lg.append_log(rows, str(tmp_path / "log"))
    lg.append_log(rows, str(tmp_path / "log"))
    logs = spark.read.parquet(str(tmp_path / "log"))
    assert logs.count() == 4
    lg.export_logs(logs, str(tmp_path / "json"), level="ERROR")
    got = spark.read.json(str(tmp_path / "json")).collect()
    assert len(got) == 2 and json.loads(got[0].details) == {"error_type": "IOError", "error_message": "no file"}


# files and ingestion --------------------------------------------------------------------


def test_ingest_plan(spark, tmp_path):
    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    text = "Deep Learning Methods for Ancient Texts\nAna Berg, Bo Lee\n\nwords " + "and more words " * 200
    (src / "2306.12345v1.txt").write_text(text)
    (src / "deep" / "copy.TXT").write_text(text)
    (src / "old.txt").write_text("known text")
    (src / "scan.pdf").write_bytes(b"%PDF")  # no decoder given
    (src / "x.exe").write_text("x")
    files = fi.scan_files(spark, str(src))
    import hashlib

    known = hashlib.sha256(b"known text").hexdigest()
    papers = spark.createDataFrame(
        [("p0", "Known", known, None, True)],
        "paper_id string, title string, file_hash string, abstract string, is_processed boolean",
    )
    arxiv = spark.createDataFrame([("2306.12345v1", "From the feed", 2023)], "arxiv_id string, title string, year int")
    works = spark.createDataFrame([], "doi string, title string")
    out = ing.ingest(files, papers, None, arxiv, works, embedding_with(hashed_embedder(16)), "2024-01-01 00:00:00")
    got = {r.title: r for r in out.papers.collect()}
    assert set(got) == {"Known", "From the feed", "scan.pdf"}
    paper = got["From the feed"]
    assert paper.is_processed and paper.arxiv_id == "2306.12345v1" and paper.year == 2023 and len(paper.embedding) == 16
    assert got["scan.pdf"].processing_error == "Failed to extract text from file"
    chunks = out.chunks.filter(F.col("paper_id") == paper.paper_id).orderBy("chunk_index").collect()
    assert [c.word_count for c in chunks] == [250, 250, 211, 11]
    assert all(len(c.embedding) == 16 for c in chunks)
    assert [r.reason for r in out.refused.collect()] == ["file type not allowed"]
    # the known file, and the second copy of a new one
    duplicates = {r.file_path: r.paper_id for r in out.duplicates.collect()}
    assert len(duplicates) == 2 and "p0" in duplicates.values()
    assert set(duplicates.values()) <= {"p0"} | {r.paper_id for r in out.papers.collect()}
    again, rebuilt = ing.reprocess(
        out.papers, out.chunks, out.papers.filter("is_processed AND title <> 'Known'"), arxiv, works,
        embedding_with(hashed_embedder(16)), "2024-01-02 00:00:00",
    )
    assert again.count() == 3 and rebuilt.count() == out.chunks.count()


# windows over time ------------------------------------------------------------------------

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot_events(spark):
    """One user makes more than a third of all events, many at equal times."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        user = "hot" if i % 5 < 2 else f"u{rng.randrange(30)}"
        ts = T0 + timedelta(milliseconds=rng.randrange(0, 400) * 250)
        rows.append((i, user, ts, rng.choice("abc")))
    return rows, spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, text string").repartition(7)


def by_user(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        users.setdefault(r[1], []).append(r)
    return users


@pytest.mark.parametrize("window", [1.0, 2.75, 60.0])
def test_sliding_count_brute_force(hot_events, window):
    rows, df = hot_events
    want = {}
    for events in by_user(rows).values():
        for r in events:
            want[r[0]] = sum(0 <= (r[2] - x[2]).total_seconds() < window for x in events)
    got = {r.event_id: r.recent for r in tl.sliding_count(df, "user_id", "ts", window).collect()}
    assert got == want


@pytest.mark.parametrize("wait", [0.25, 0.5, 3.0])
def test_debounce_brute_force(hot_events, wait):
    rows, df = hot_events
    want = []
    for events in by_user(rows).values():
        for a, b in zip(events, [*events[1:], None], strict=True):
            if b is None or (b[2] - a[2]).total_seconds() >= wait:
                want.append(a[0])
    got = tl.debounce(df, "user_id", "ts", wait, "event_id").collect()
    assert sorted(r.event_id for r in got) == sorted(want)


@pytest.mark.parametrize("limit,window", [(3, 1.0), (2, 10.0), (60, 60.0), (500, 1.0)])
def test_rate_limit_brute_force(hot_events, limit, window):
    rows, df = hot_events
    want = {}
    for events in by_user(rows).values():
        taken = []
        for r in events:
            taken = [t for t in taken if (r[2] - t).total_seconds() < window]
            want[r[0]] = len(taken) < limit
            if want[r[0]]:
                taken.append(r[2])
    got = tl.rate_limit(df, "user_id", "ts", "event_id", limit, window).collect()
    assert {r.event_id: r.accepted for r in got} == want


def test_neighbours_and_carry_over_buckets(hot_events):
    rows, df = hot_events
    bucket = tl.time_bucket("ts", 10 * tl.MICROS)
    prev, nxt, carried = {}, {}, {}
    for events in by_user(rows).values():
        last = None
        for i, r in enumerate(events):
            prev[r[0]] = events[i - 1][3] if i else None
            nxt[r[0]] = events[i + 1][3] if i + 1 < len(events) else None
            last = r[3] if r[3] != "a" else last
            carried[r[0]] = last
    got = tl.previous_row(df, ["user_id"], ["ts", "event_id"], ["text"], bucket).collect()
    assert {r.event_id: r.prev_text for r in got} == prev
    got = tl.next_row(df, ["user_id"], ["ts", "event_id"], ["text"], bucket).collect()
    assert {r.event_id: r.next_text for r in got} == nxt
    some = df.withColumn("text", F.when(F.col("text") != "a", F.col("text")))
    got = tl.carry_forward(some, ["user_id"], ["ts", "event_id"], "text", bucket, "out").collect()
    assert {r.event_id: r.out for r in got} == carried
