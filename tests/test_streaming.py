"""Streams give the rows of their batch forms."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citespark.operators import timeline as tl
from citespark.operators.embedding import embedding_with, hashed_embedder
from citespark.plans.ingest import ingest
from citespark.plans.library_sync import run_sync
from citespark.plans.requests import editor_requests
from citespark.sources.files import decode_text
from citespark.streaming import ingest as si
from citespark.streaming import progress
from citespark.streaming import requests as sr
from citespark.streaming import tables as tb
from citespark.streaming.logs import log_stream

T0 = datetime(2024, 1, 1)
MESSAGE = "event_id long, user_id string, ts timestamp, type string, text string"


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def run_stream(spark, tmp_path, batches, schema, build, name):
    """Writes each batch as a file and drives the stream through all of them."""
    src = tmp_path / "src"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(src))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


LONG = "a text that is long enough"
CHANGES = [
    (1, "u", at(0), "suggest", LONG + " 1"),
    (2, "u", at(499), "suggest", LONG + " 2"),
    (3, "u", at(999), "suggest", LONG + " 3"),  # exactly the wait after 2
    (4, "u", at(2000), "suggest", LONG + " 3"),  # same text as the request before
    (5, "u", at(4000), "suggest", "short"),
    (6, "u", at(6000), "suggest", LONG + " 3"),  # still the same as the last request
    (7, "v", at(100), "suggest", LONG),
    (8, "u", at(9000), "suggest", LONG + " 4"),
]
# moves the watermark far enough for every pending change to be released
FLUSH = [(99, "w", at(10_000_000), "suggest", "late " + LONG), (100, "w", at(20_000_000), "suggest", "later " + LONG)]
EXPECTED = {("u", LONG + " 2"), ("u", LONG + " 3"), ("u", LONG + " 4"), ("v", LONG)}


def test_debounce_batch(spark):
    got = editor_requests(spark.createDataFrame(CHANGES, MESSAGE)).collect()
    assert sorted((r.user_id, r.text) for r in got) == sorted(EXPECTED)


def test_debounce_stream_equals_batch(spark, tmp_path):
    batches = [CHANGES[:3], CHANGES[3:], FLUSH[:1], FLUSH[1:]]
    rows = run_stream(spark, tmp_path, batches, MESSAGE, lambda s: sr.debounce_stream(s, 500, "0 seconds"), "deb")
    got = sorted((r.user_id, r.text) for r in rows if r.user_id != "w")
    assert got == sorted(EXPECTED)


def test_debounce_sessions(spark, tmp_path):
    batches = [CHANGES, FLUSH[:1], FLUSH[1:]]
    rows = run_stream(spark, tmp_path, batches, MESSAGE, lambda s: sr.debounce_sessions(s, 500, "0 seconds"), "ses")
    quiet = tl.debounce(spark.createDataFrame(CHANGES, MESSAGE), "user_id", "ts", 0.5, "event_id").collect()
    want = sorted((r.user_id, r.ts, r.text) for r in quiet)
    assert sorted((r.user_id, r.ts, r.text) for r in rows if r.user_id != "w") == want


def burst():
    """65 messages in quick succession, then two when the first ones are a minute old."""
    rows = [(i, "u", at(i * 10), "suggest" if i % 2 else "ping", LONG) for i in range(65)]
    return rows + [(70, "u", at(60_000), "suggest", LONG), (71, "u", at(60_005), "suggest", LONG)]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = burst()
    batch = tl.rate_limit(spark.createDataFrame(rows, MESSAGE), "user_id", "ts", "event_id")
    want = sorted((r.event_id, r.accepted) for r in batch.collect())
    flags = dict(want)
    assert [i for i, ok in want if not ok] == [60, 61, 62, 63, 64, 71]
    assert flags[70]
    parts = [rows[:30], rows[30:61], rows[61:]]
    got = run_stream(spark, tmp_path, parts, MESSAGE, lambda s: sr.rate_limit_stream(s), "rate")
    assert sorted((r.event_id, r.accepted) for r in got) == want


def test_late_messages_get_a_verdict(spark, tmp_path):
    """Any order of arrival: each message is answered once, and no window holds more than the limit."""
    rows = [(i, "u", at(i * 400), "suggest", LONG) for i in range(200)] + [(500, "u", at(-10_000_000), "suggest", LONG)]
    parts = [rows[100:150], rows[:60], rows[150:200], rows[60:100], rows[200:]]
    got = run_stream(spark, tmp_path, parts, MESSAGE, lambda s: sr.rate_limit_stream(s, limit=20, window_seconds=20.0, delay="60 seconds"), "late")
    assert sorted(r.event_id for r in got) == sorted(r[0] for r in rows)
    times = sorted(r.ts for r in got if r.accepted)
    assert all((times[i + 20] - times[i]).total_seconds() >= 20.0 for i in range(len(times) - 20))
    assert {r.event_id for r in got if r.late} >= set(range(60)) | {500} and not next(r for r in got if r.event_id == 500).accepted
    assert any(r.accepted for r in got if r.late)


def test_judge_is_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        accepted, limit, width = [], rng.randrange(1, 5), rng.randrange(1, 30)
        for _ in range(40):
            now = rng.randrange(100)
            both = sorted([*accepted, now])
            fits = all(sum(end - width < t <= end for t in both) <= limit for end in both)
            assert sr.judge(accepted, now, width, limit) == fits
            assert accepted == (both if fits else accepted)


def test_log_stream_equals_batch(spark, tmp_path):
    rows = [(at(i * 60_000 * 7), "ERROR" if i % 3 else "INFO", f"c{i % 2}") for i in range(60)]
    flush = [(at(10**9), "INFO", "z")]
    schema = "created_at timestamp, level string, category string"
    got = run_stream(spark, tmp_path, [rows[:30], rows[30:], flush, flush], schema, log_stream, "logs_q")
    from citespark.operators.logs import windowed_counts

    want = windowed_counts(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_suggest_stream_equals_batch(spark, tmp_path):
    embed = embedding_with(hashed_embedder(64))
    texts = [f"deep networks for topic {i} in medicine and biology" for i in range(8)]
    papers = spark.createDataFrame(
        [(i, f"On topic {i}", [f"Ana B{i}"], 2020, x, "J", None, 150, True) for i, x in enumerate(texts)],
        "paper_id long, title string, authors array<string>, year int, abstract string, journal string, doi string, "
        "citation_count int, is_processed boolean",
    )
    chunks = embed(
        spark.createDataFrame(
            [(i, i, x, 0, None) for i, x in enumerate(texts)],
            "chunk_id long, paper_id long, content string, chunk_index int, section_title string",
        ),
        "content",
    )
    messages = [(1, "suggest", "deep networks for topic 3 in medicine and biology"), (2, "suggest", "short"),
                (3, "ping", None), (4, "suggest", None), (5, "suggest", "networks for topic 5 in biology today")]
    schema = "query_id long, type string, text string"
    spark.createDataFrame(messages, schema).coalesce(1).write.parquet(str(tmp_path / "m"))
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    q = sr.suggest_stream(
        spark.readStream.schema(schema).parquet(str(tmp_path / "m")), chunks, papers, embed,
        as_of_year=2024, out=out, rejects=bad, checkpoint=str(tmp_path / "cp"),
    )
    q.awaitTermination()
    want, rejected = sr.suggest_batch_of(spark.createDataFrame(messages, schema), chunks, papers, embed, 2024)
    cols = ["query_id", "position", "paper_id", "chunk_id"]
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == sorted(
        map(tuple, want.select(*cols).collect())
    )
    assert want.count() > 0
    reasons = {r.query_id: r.reason for r in spark.read.parquet(bad).collect()}
    assert reasons == {2: "text too short", 3: "unknown type", 4: "incomplete message"}
    assert rejected.count() == 3


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one two three")
    (src / "b.txt").write_text("one two three")  # same content
    (src / "c.exe").write_text("no")
    (src / "d.pdf").write_bytes(b"%PDF")  # no decoder: an error to retry
    root = str(tmp_path / "root")
    embed = embedding_with(hashed_embedder(8))

    def run(now):
        q = si.ingest_stream(spark, str(src), root, str(tmp_path / "cp"), embed, now=now)
        q.awaitTermination()

    run("2024-01-01 00:00:00")
    states = {r.paper_id: r for r in si.paper_states(tb.read_before(spark, f"{root}/outcomes", None, si.OUTCOME_SCHEMA)).collect()}
    assert sorted(r.is_processed for r in states.values()) == [False, True]
    assert si.current_chunks(spark, root).select("content").collect()[0][0] == "one two three"
    (src / "e.txt").write_text("four five")
    run("2024-01-01 00:20:00")  # the error is not old enough
    tried = tb.read_before(spark, f"{root}/outcomes", None, si.OUTCOME_SCHEMA)
    assert tried.filter("batch = 1").count() == 1
    (src / "f.txt").write_text("six")
    run("2024-01-01 01:00:00")  # now it is retried
    tried = tb.read_before(spark, f"{root}/outcomes", None, si.OUTCOME_SCHEMA)
    assert tried.filter("batch = 2").count() == 2
    assert si.current_chunks(spark, root).count() == 3
    refused = spark.read.parquet(f"{root}/refused/batch=0").collect()
    assert [r.reason for r in refused] == ["file type not allowed"]


def test_ingest_stream_equals_batch(spark, tmp_path):
    """Metadata, chunks and vectors of files in shuffled batches are those of one batch; lookups decide where they match."""
    names = [f"p{n}" for n in range(6)]
    random.Random(5).shuffle(names)
    src, root = tmp_path / "in", str(tmp_path / "root")
    src.mkdir()
    for n, name in enumerate(names):
        (src / f"{name}.txt").write_text(
            f"A Study of Item {name} in Large Graphs\nAda Byron, Carl Gauss\nAbstract\nWe study {name} here at some length.\n"
            + (f"doi: 10.1234/{name}\n" if n % 2 else "") + "word " * (300 * n)
        )
    embed = embedding_with(hashed_embedder(8))
    works = spark.createDataFrame([(f"10.1234/{names[1]}", "Known title", 1999)], "doi string, title string, year int")
    si.ingest_stream(
        spark, str(src), root, str(tmp_path / "cp"), embed, files_per_batch=2, now="2024-01-01 00:00:00", works=works, compact_after=1
    ).awaitTermination()
    empty = spark.createDataFrame([], si.PAPER_SCHEMA).drop("content", "extension", "first_seen")
    files = spark.read.format("binaryFile").load(str(src))
    whole = ingest(files, empty, None, spark.createDataFrame([], "arxiv_id string"), works, embed, "2024-01-01 00:00:00")
    rows = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    columns = ["paper_id", "title", "authors", "abstract", "year", "journal", "doi", "arxiv_id", "metadata_source", "embedding"]
    got = si.ingested_papers(spark, root).read()
    assert rows(got, *columns) == rows(whole.papers, *columns) and got.count() == 6
    assert [r.year for r in got.filter("title = 'Known title'").collect()] == [1999]
    assert rows(si.current_chunks(spark, root), "paper_id", "chunk_index", "content", "embedding") == rows(
        whole.chunks, "paper_id", "chunk_index", "content", "embedding"
    )


def test_errors_are_retried_by_the_clock(spark, tmp_path):
    src, root, calls = tmp_path / "in", str(tmp_path / "root"), []
    src.mkdir()
    (src / "a.txt").write_text("one two three")

    def decode(files):
        calls.append(1)
        out = decode_text(files)
        return out.withColumns({"full_text": F.lit(None).cast("string"), "processing_error": F.lit("busy")}) if len(calls) == 1 else out

    q = si.ingest_stream(
        spark, str(src), root, str(tmp_path / "cp"), embedding_with(hashed_embedder(8)), every="1 second", decode=decode, retry_minutes=0.001
    )
    try:
        for _ in range(180):
            tried = tb.read_before(spark, f"{root}/outcomes", None, si.OUTCOME_SCHEMA).orderBy("batch").collect()
            if len(tried) == 2:
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert [r.error for r in tried] == ["busy", None]  # no second file came
    assert [r.title for r in si.ingested_papers(spark, root).read().collect()] and len(calls) == 2


def item(key, version, title, doi=""):
    return json.dumps(
        {"key": key, "version": version, "library_id": "users/1",
         "data": {"itemType": "journalArticle", "title": title, "DOI": doi, "creators": []}}
    )


def test_sync_stream_keeps_failed_items(spark, tmp_path):
    src, root = tmp_path / "items", str(tmp_path / "root")
    src.mkdir()
    (src / "1.json").write_text("\n".join([item("A", 1, "a", "10.1/x"), item("B", 2, "b", "10.1/x"), item("C", 3, "t" * 1001), item("D", 4, "d")]))

    def run():
        si.sync_stream(spark, str(src), root, str(tmp_path / "cp"), "u1").awaitTermination()

    run()
    counts = {r.action: r["items"] for r in spark.read.parquet(f"{root}/counts/batch=0").collect()}
    assert counts == {"insert": 2, "link": 1}
    assert spark.read.parquet(f"{root}/mark/batch=0").collect()[0].mark == 2
    (src / "2.json").write_text("\n".join([item("C", 3, "c"), item("D", 4, "d")]))
    run()
    counts = {r.action: r["items"] for r in spark.read.parquet(f"{root}/counts/batch=1").collect()}
    assert counts == {"insert": 1, "skip": 1}
    assert spark.read.parquet(f"{root}/mark/batch=1").collect()[0].mark == 4
    assert si.synced_papers(spark, root).read().count() == 3
    assert {(r.item_key, r.version) for r in si.synced_state(spark, root).read().collect()} == {("A", 1), ("B", 2), ("C", 3), ("D", 4)}


def test_sync_batches_equal_snapshots(spark, tmp_path):
    """Changes written per batch give the rows of whole snapshots; repeated batches and compaction change nothing."""
    root, rng = str(tmp_path / "root"), random.Random(3)
    papers = spark.createDataFrame([], si.SNAPSHOT_SCHEMA)
    state = spark.createDataFrame([], si.STATE_SCHEMA)
    rows = lambda df: sorted(map(str, df.collect()))
    mark, version = None, 0
    for n in range(4):
        lines = []
        for k in rng.sample(range(12), 6):
            version += 1
            lines.append(item(f"K{k}", version, f"t{version}", rng.choice(["", f"10.1/{k % 4}"])))
        (tmp_path / f"{n}.json").write_text("\n".join(lines))
        raw = spark.read.schema(si.ITEM_SCHEMA).json(str(tmp_path / f"{n}.json"))
        for _ in range(2 if n == 2 else 1):
            si.sync_batch(raw, root, n, "u1", compact_after=2)
        run = run_sync(raw.withColumn("seq", F.struct("version", "key")), papers, state, "u1", mark=mark)
        mark = run.mark.collect()[0].mark
        new_papers, new_state = run.papers.select(*papers.columns).collect(), run.state.select(*state.columns).collect()
        papers = spark.createDataFrame(new_papers, si.SNAPSHOT_SCHEMA)
        state = spark.createDataFrame(new_state, si.STATE_SCHEMA)
        assert rows(si.synced_papers(spark, root).read()) == rows(papers)
        assert rows(si.synced_state(spark, root).read()) == rows(state)
        written = spark.read.parquet(f"{root}/papers/delta={n}").count()
        assert written <= 6
    assert (tmp_path / "root" / "papers" / "base=1").exists() and papers.count() > 6


def test_keyed_table(spark, tmp_path):
    table = tb.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ("k",), buckets=8)
    rows = lambda df: dict(map(tuple, df.collect()))
    assert rows(table.read()) == {}
    expected = {k: "old" for k in range(200)}
    table.seed(spark.createDataFrame(list(expected.items()), "k long, v string"))
    history = [dict(expected)]
    for n in range(5):
        change = {k: f"batch {n}" for k in (n, n + 1, 300 + n)} if n != 3 else {}
        assert table.compact(n, 3) == (n == 3)
        table.write(spark.createDataFrame(list(change.items()), "k long, v string"), n)
        expected.update(change)
        history.append(dict(expected))
        assert rows(table.read()) == expected
    assert [rows(table.read(n)) for n in range(6)] == history
    touched = {int(p.name.split("=")[1]) for p in (tmp_path / "t" / "base=2").glob("bucket=*")}
    assert 0 < len(touched) < 8  # compaction wrote no other bucket
    one = spark.createDataFrame([(2,)], "k long")
    some = rows(table.read(buckets=table.buckets_of(one)))
    assert some[2] == expected[2] and len(some) < len(expected) / 2


def test_progress(spark):
    plan = spark.createDataFrame([("insert",), ("skip",), ("skip",)], "action string")
    watched, seen = progress.sync_progress(plan)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"items": 3, "insert": 1, "update": 0, "link": 0, "skip": 2}


def test_progress_listener(spark, tmp_path):
    listener = progress.ProgressListener()
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(str(tmp_path / "r"))
        q = (
            spark.readStream.schema("id long").parquet(str(tmp_path / "r"))
            .writeStream.format("noop").trigger(availableNow=True).start()
        )
        q.awaitTermination()
        for _ in range(50):
            if listener.state.get(str(q.id), {}).get("status") == "completed":
                break
            import time

            time.sleep(0.1)
        assert listener.state[str(q.id)] == {"status": "completed", "current": 5, "batch": 0}
    finally:
        spark.streams.removeListener(listener)


@pytest.mark.parametrize("wait", [0.5])
def test_debounce_gap_edges(spark, wait):
    rows = [(i, "u", at(ms), "suggest", str(ms)) for i, ms in enumerate([0, 499, 999, 1500, 1500])]
    got = tl.debounce(spark.createDataFrame(rows, MESSAGE), "user_id", "ts", wait, "event_id")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 4]


def test_stream_schema_is_stable(spark):
    df = spark.createDataFrame(CHANGES, MESSAGE)
    assert df.select(F.col("ts")).schema[0].dataType.simpleString() == "timestamp"
