"""Continuous intake of paper files and of library item dumps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citespark.functions.text import char_count
from citespark.operators import chunks as ck
from citespark.operators import sync
from citespark.plans import ingest as plan
from citespark.plans.library_sync import run_sync
from citespark.sources import files as fs
from citespark.sources import library_items as li
from citespark.sources.library_items import ITEM_SCHEMA
from citespark.streaming import tables as tb

RETRY_MINUTES = 30
#: Batches of a sync stream whose changes are merged into the tables at once.
COMPACT_AFTER = 8
PAPER_SCHEMA = (
    "paper_id string, title string, file_hash string, file_path string, extension string, content binary, first_seen int"
)
OUTCOME_SCHEMA = "paper_id string, n_chars int, error string, at timestamp"
CHUNK_SCHEMA = (
    "paper_id string, chunk_index int, content string, word_count int, start_char int, end_char int, "
    "section_title string, embedding array<float>"
)
TEXT_SCHEMA = "paper_id string, title string, full_text string, processing_error string"
RECORD_SCHEMA = (
    "paper_id string, title string, authors array<string>, abstract string, year int, journal string, doi string, "
    "arxiv_id string, metadata_source string, embedding array<float>"
)
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
SNAPSHOT_SCHEMA = (
    "paper_id string, title string, authors array<string>, abstract string, year int, journal string, doi string, "
    "source_url string, source string, item_key string, citation_count int"
)
STATE_SCHEMA = "user_id string, item_key string, version int, paper_id string"


def paper_states(outcomes: DataFrame) -> DataFrame:
    """Last outcome per paper: is_processed, error, time."""
    last = outcomes.groupBy("paper_id").agg(
        F.max_by(F.struct("error", "at"), F.col("batch")).alias("o")
    )
    return last.select(
        "paper_id", F.col("o.error").isNull().alias("is_processed"),
        F.col("o.error").alias("processing_error"), F.col("o.at").alias("updated_at"),
    )


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of the last batch that processed each paper."""
    rows = tb.read_before(spark, f"{root}/chunks", None, CHUNK_SCHEMA)
    newest = rows.groupBy("paper_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["paper_id", "batch"], "left_semi").drop("batch")


def ingested_papers(spark: SparkSession, root: str) -> tb.KeyedTable:
    """Metadata and vector of every paper that was processed."""
    return tb.KeyedTable(spark, f"{root}/records", RECORD_SCHEMA, ("paper_id",))


def ingest_batch(
    files: DataFrame,
    root: str,
    batch_id: int,
    embed: Callable[[DataFrame, str], DataFrame],
    now: str | None = None,
    decode: Callable[[DataFrame], DataFrame] = fs.decode_text,
    retry_minutes: float = RETRY_MINUTES,
    arxiv: DataFrame | None = None,
    works: DataFrame | None = None,
    compact_after: int = COMPACT_AFTER,
) -> None:
    """Takes in new files, retries papers whose error is old enough, and finishes what could be read.

    Each step starts from the written table of the one before: files, texts and
    outcomes, chunks with vectors, records with metadata from ``arxiv`` and
    ``works`` (or the text) and the paper's vector. A text that cannot be read or is
    empty is an error to retry. Without new files and due papers nothing is written.
    """
    spark = files.sparkSession
    now = now or spark.range(1).select(F.current_timestamp().cast("string")).first()[0]  # one instant for the batch
    clock = F.lit(now).cast("timestamp")
    inbox = tb.read_before(spark, f"{root}/papers", batch_id, PAPER_SCHEMA)
    states = paper_states(tb.read_before(spark, f"{root}/outcomes", batch_id, OUTCOME_SCHEMA))
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(retry_minutes * 60))
    due = states.filter(~F.col("is_processed")).filter(F.col("updated_at") < clock - wait)
    if files.isEmpty() and due.isEmpty():
        return
    good, refused = fs.ingest_files(files.select("path", "length", "content"))
    fresh, _ = fs.dedupe_by_hash(good, inbox)
    new = (
        fresh.join(good.select(F.col("path").alias("file_path"), "content", "extension"), "file_path")
        .withColumn("paper_id", F.concat(F.lit("f-"), "file_hash"))
        .withColumn("first_seen", F.lit(batch_id))
        .select("paper_id", "title", "file_hash", "file_path", "extension", "content", "first_seen")
    )
    tb.write_batch(new, f"{root}/papers", batch_id)
    tb.write_batch(refused.select("path", "reason"), f"{root}/refused", batch_id)
    # read back: files are hashed and moved once, later steps start from the table
    landed = spark.read.schema(PAPER_SCHEMA).parquet(f"{root}/papers/batch={batch_id}")
    retry = inbox.drop("batch").join(due.select("paper_id"), "paper_id", "left_semi")
    texts = decode(landed.unionByName(retry))
    unread = F.when(F.coalesce(F.col("full_text"), F.lit("")) == "", plan.NO_TEXT)
    texts = texts.withColumn("processing_error", F.coalesce("processing_error", unread))
    tb.write_batch(texts.select("paper_id", "title", "full_text", "processing_error"), f"{root}/texts", batch_id)
    texts = spark.read.schema(TEXT_SCHEMA).parquet(f"{root}/texts/batch={batch_id}")
    readable = texts.filter("processing_error IS NULL").drop("processing_error")
    tb.write_batch(embed(ck.chunk_papers(readable), "content"), f"{root}/chunks", batch_id)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{root}/chunks/batch={batch_id}")
    arxiv = spark.createDataFrame([], "arxiv_id string") if arxiv is None else arxiv
    works = spark.createDataFrame([], "doi string") if works is None else works
    records = ingested_papers(spark, root)
    records.compact(batch_id, compact_after)
    records.write(plan.paper_records(plan.with_paper_fields(readable), chunks, arxiv, works, embed, int(now[:4])), batch_id)
    # last: a paper counts as processed when its chunks and its record are written
    tb.write_batch(
        texts.select(
            "paper_id", char_count(F.col("full_text")).alias("n_chars"),
            F.col("processing_error").alias("error"), clock.alias("at"),
        ),
        f"{root}/outcomes",
        batch_id,
    )


def ingest_stream(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    embed: Callable[[DataFrame, str], DataFrame],
    *,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
    every: str | None = None,
    **options,
):
    """Watches a folder; each micro-batch is one :func:`ingest_batch`.

    ``every`` (such as ``"30 seconds"``) runs a batch at that interval also when no
    file arrives, so that papers with an error are retried by the clock: a second source
    ticks once a second, and its rows carry no file.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", str(files_per_batch))
        .load(source)
    )
    if every is not None:
        names = T.StructType.fromDDL(FILE_SCHEMA).fields
        ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
        stream = stream.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in names]))
        trigger = {"processingTime": every}

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch.filter("path IS NOT NULL"), root, batch_id, embed, **options)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def synced_papers(spark: SparkSession, root: str) -> tb.KeyedTable:
    """The papers that a sync stream maintains."""
    return tb.KeyedTable(spark, f"{root}/papers", SNAPSHOT_SCHEMA, ("paper_id",))


def synced_state(spark: SparkSession, root: str) -> tb.KeyedTable:
    """Version and paper of each item of a user."""
    return tb.KeyedTable(spark, f"{root}/state", STATE_SCHEMA, ("user_id", "item_key"))


def sync_batch(
    raw: DataFrame, root: str, batch_id: int, user_id: str, force_full: bool = False, compact_after: int = COMPACT_AFTER
) -> None:
    """Applies one dump of items to the tables and advances the mark.

    Only changed papers and items are written. The plan looks at the state of the
    dump's items and at papers with its DOIs, and is written once. The mark stops below the first
    failed item, so that the next run sees it again.
    """
    spark = raw.sparkSession
    papers, state = synced_papers(spark, root), synced_state(spark, root)
    for table in (papers, state):
        table.compact(batch_id, compact_after)
    marks = tb.read_latest(spark, f"{root}/mark", batch_id, "mark bigint").collect()  # one row
    mark = marks[0]["mark"] if marks else None
    numbered = raw.withColumn("seq", F.struct(F.col("version"), F.col("key")))
    items = li.map_items(li.split_items(numbered)[0])
    mine = items.select(F.lit(user_id).alias("user_id"), "item_key").filter("item_key IS NOT NULL").distinct()
    known = state.read(batch_id, state.buckets_of(mine)).join(mine, ["user_id", "item_key"], "left_semi")
    dois = items.select("doi").filter("doi IS NOT NULL").distinct()
    owners = papers.read(batch_id).join(dois, "doi", "left_semi")
    run = run_sync(numbered, owners, known, user_id, mark=mark, force_full=force_full)
    tb.write_batch(run.plan, f"{root}/plan", batch_id)
    rows = spark.read.schema(run.plan.schema).parquet(f"{root}/plan/batch={batch_id}")
    touched = papers.buckets_of(rows.filter("action <> 'skip'"))
    papers.write(sync.changed_papers(papers.read(batch_id, touched), rows), batch_id)
    state.write(sync.changed_state(rows, user_id), batch_id)
    tb.write_batch(sync.sync_counts(rows), f"{root}/counts", batch_id)
    tb.write_batch(run.rejects.drop("seq"), f"{root}/rejects", batch_id)
    tb.write_batch(sync.high_water(rows, run.rejects, mark), f"{root}/mark", batch_id)


def sync_stream(
    spark: SparkSession, source: str, root: str, checkpoint: str, user_id: str, trigger: dict | None = None
):
    """Watches a folder of item dumps (JSON lines)."""
    stream = spark.readStream.schema(ITEM_SCHEMA).json(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        sync_batch(batch, root, batch_id, user_id)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
