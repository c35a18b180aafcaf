"""WARC archives of captures, and their index by external merging.

Writing: each capture becomes a record of text; Spark's text sink writes the
records of a task one after the other, so a file is a plain archive and a lost
task leaves none behind. Equal payloads of at least ``REVISIT_BYTES`` are stored
once, by the smallest capture id; the others are revisit records that name it
and keep the HTTP headers only.

Reading: archives are read by offset, plain or gzipped (one or more members).
Each task sorts what it read into capture runs of bounded size and writes them.
The runs are dealt by ranges of URL key, time stamp and id, and each range is
merged from its parts of all runs by a loser tree, which gives captures in one
global order: the histories of all URLs.

Defined cases: a NULL payload is empty; a NULL URL has no target header and the
empty key; line ends inside a URL are written as %0D and %0A. Rows equal in id
and payload are repeats of one capture and all responses; a NULL id is never the
one referred to, unless a payload has NULL ids only (all are responses then).
Without time stamps all captures carry the first second of 1970 and ids order them.
A record that ends early, or has no length, becomes one row of type ``damaged``
and ends its archive (or gzip member). Empty tables give empty archives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm.common import arrow_schema, checkpoint

REVISIT_BYTES = 100
#: Bytes of payloads in one archive, on average.
ARCHIVE_BYTES = 64 << 20
#: Captures in a sorted run, and captures that one task merges.
RUN_ROWS, MERGE_ROWS = 50_000, 200_000
#: A table of repeated payloads of at most so many rows, which are counted, is sent to the tasks.
BROADCAST_ROWS = 100_000
ORDER = ["url_key", "captured", "page_id", "archive", "offset"]
INDEX = (
    "url_key string, captured string, page_id long, archive string, offset long, length long, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, intact boolean"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b"
#: Packed bytes unpacked at once.
MEMBER_STEP = 1 << 18
EPOCH = "1970-01-01T00:00:00Z"
END = "\r\n"


# ---- writing


def repeated_payloads(pages: DataFrame) -> DataFrame:
    """(digest, first, n): payloads of at least ``REVISIT_BYTES`` that several captures share, and the smallest id among them."""
    shared = pages.filter(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return shared.filter("n > 1").select("digest", "first")


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(">"))


def record() -> Column:
    """The record of a row (page_id, url, payload, captured, digest, n_bytes, refers_to) as text, without its last line end."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("n_bytes").cast("string")), F.lit(END)
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    head = [
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.col("captured")),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", length.cast("string")),
        F.lit(END),
    ]
    return F.concat(*head, http, F.when(revisit, "").otherwise(F.col("payload")), F.lit(END))


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
    captured: Column | None = None, compression: str = "none",
) -> None:
    """Writes a record for each row of ``pages`` to archives in ``folder``, which all executors must share.

    Payloads are not shuffled while the table of repeated ones is small (it is counted).
    """
    stamp = F.lit(EPOCH) if captured is None else F.coalesce(F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(EPOCH))
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), stamp.alias("captured"),
        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"),
    )
    narrow = checkpoint(rows.select("page_id", "digest", "n_bytes"))
    n, size = narrow.agg(F.count("*"), F.sum("n_bytes")).first()
    shared = checkpoint(repeated_payloads(narrow))
    few = shared.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    per_archive = max(1, ARCHIVE_BYTES * n // max(1, size or 0)) if n else 1
    texts = found.withColumn("refers_to", refers).select(record().alias("value"))
    texts.write.option("lineSep", END).option("maxRecordsPerFile", per_archive).option("compression", compression).text(folder)


# ---- reading


def url_key(url: str | None) -> str:
    """The key that orders URLs: host labels from the last to the first, then path and query, in lower case, no scheme."""
    if not url:
        return ""
    text = url.strip().lower()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text
    host = host[4:] if host.startswith("www.") else host
    port = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member; a member that cannot be unpacked to its end is the last."""
    view, at = memoryview(content), 0
    while at < len(view):
        box, parts, end = zlib.decompressobj(31), [], at
        try:
            while end < len(view) and not box.eof:
                parts.append(box.decompress(view[end : end + MEMBER_STEP]))
                end += MEMBER_STEP
        except zlib.error:
            pass
        end = min(end, len(view)) - len(box.unused_data) if box.eof else len(view)
        yield at, end - at, b"".join(parts)
        at = end


def headers(block: bytes) -> dict[str, str]:
    found = {}
    for text in block.decode("utf-8", "replace").split(END)[1:]:
        name, colon, value = text.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes] | tuple[int, int, None, bytes]]:
    """(offset, length, headers, block) of each record; headers are None for a damaged end."""
    at, n = 0, len(data)
    while at < n:
        stop = data.find(b"\r\n\r\n", at)
        found = headers(data[at:stop]) if stop >= 0 and data.startswith(b"WARC/", at) else {}
        size = found.get("content-length", "")
        end = stop + 4 + int(size) if size.isdecimal() else n + 1
        if end > n:
            yield at, n - at, None, b""
            return
        after = end + 4 if data.startswith(b"\r\n\r\n", end) else end
        yield at, after - at, found, data[stop + 4 : end]
        at = after


def number(urn_text: str | None) -> int | None:
    """The id in a record id, if there is one."""
    last = (urn_text or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdecimal() else None


def entry(archive: str, at: int, length: int, found: dict[str, str] | None, block: bytes) -> dict:
    """The index row of a record, with its payload where the record holds it."""
    row = dict.fromkeys(name for name, _ in (part.split() for part in INDEX.split(",")))
    row |= {"archive": archive, "offset": at, "length": length, "url_key": "", "captured": EPOCH, "record_type": "damaged", "intact": False}
    if found is None:
        return row
    kind = found.get("warc-type", "")
    stop = block.find(b"\r\n\r\n")
    body = block[stop + 4 :] if stop >= 0 and block.startswith(b"HTTP/") else block
    said = found.get("warc-payload-digest", "").removeprefix("sha256:")
    row |= {
        "url": found.get("warc-target-uri"), "url_key": url_key(found.get("warc-target-uri")), "captured": found.get("warc-date", EPOCH),
        "record_type": kind, "page_id": number(found.get("warc-record-id")), "refers_to": number(found.get("warc-refers-to")),
    }
    if kind == "revisit":
        size = headers(block[: max(stop, 0)]).get("content-length", "")
        return row | {"payload_bytes": int(size) if size.isdecimal() else None, "payload_digest": said or None, "intact": bool(said)}
    digest = hashlib.sha256(body).hexdigest()
    return row | {"payload_bytes": len(body), "payload_digest": digest, "intact": said in ("", digest), "payload": body}


def order_key(row: dict) -> tuple:
    """As Spark orders ``ORDER``: NULL ids first, texts by their bytes."""
    page_id = row["page_id"]
    return (row["url_key"].encode(), row["captured"].encode(), page_id is not None, page_id or 0, row["archive"].encode(), row["offset"])


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def read_records(spark: SparkSession, folder: str, ddl: str, make: Callable[[Iterator[dict]], Iterator[list[dict]]]) -> DataFrame:
    """Lists of rows that ``make`` gives for the entries of a task's archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)

        def entries() -> Iterator[dict]:
            for batch in batches:
                for path, cell in zip(batch.column(0), batch.column(1)):
                    name, content = path.as_py().rpartition("/")[2], cell.as_py()
                    if not content.startswith(GZIP):
                        for at, length, found, block in records(content):
                            yield entry(name, at, length, found, block)
                        continue
                    for start, packed, data in members(content):
                        for _, _, found, block in records(data) if data else [(0, 0, None, b"")]:
                            yield entry(name, start, packed, found, block)

        for rows in make(entries()):
            columns = [pa.array([row.get(f.name) for row in rows], type=f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return archive_files(spark, folder).mapInArrow(run, ddl)


def capture_runs(spark: SparkSession, folder: str, rows: int = RUN_ROWS) -> DataFrame:
    """The index of all archives as sorted runs (run, seq, ...) of at most ``rows`` captures; each task makes its own."""

    def sort(entries: Iterator[dict]) -> Iterator[list[dict]]:
        task, run = TaskContext.get().partitionId(), 0

        def ready(part: list[dict]) -> list[dict]:
            part.sort(key=order_key)
            return [row | {"run": (task << 32) | run, "seq": seq} for seq, row in enumerate(part)]

        part: list[dict] = []
        for row in entries:
            row.pop("payload", None)
            part.append(row)
            if len(part) == rows:
                yield ready(part)
                part, run = [], run + 1
        if part:
            yield ready(part)

    return read_records(spark, folder, f"run long, seq long, {INDEX}", sort)


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(run, key) in ascending order of keys from ascending runs; of equal keys that of the earlier run comes first.

    Every inner node keeps the loser of its match, so the next head of the last
    winner's run plays one match on each level of the tree.
    """
    width = 1
    while width < len(runs):
        width *= 2
    spent = (1,)
    heads: list[tuple] = [spent] * width

    def advance(run: int) -> None:
        key = next(runs[run], None)
        heads[run] = spent if key is None else (0, key, run)

    for run in range(len(runs)):
        advance(run)
    losers = [0] * width

    def play(node: int) -> int:
        if node >= width:
            return node - width
        a, b = play(2 * node), play(2 * node + 1)
        if heads[b] < heads[a]:
            a, b = b, a
        losers[node] = b
        return a

    winner = play(1)
    while heads[winner] is not spent:
        yield winner, heads[winner][1]
        advance(winner)
        node = (winner + width) // 2
        while node:
            if heads[losers[node]] < heads[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2


def merged(runs: DataFrame, rows: int = MERGE_ROWS) -> DataFrame:
    """The captures of all runs in one global order: partitions follow each other, and so do the rows in each.

    Ranges hold about ``rows`` captures each; a URL with many captures is cut by time stamp and id.
    """
    names = [name for name in runs.columns if name not in ("run", "seq")]
    ddl = INDEX

    def run_merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        table = pa.Table.from_batches(parts) if parts else None
        if not table:
            return
        run_of = table.column("run").to_pylist()
        keyed = table.select(ORDER).to_pylist()
        starts = [i for i, run in enumerate(run_of) if i == 0 or run != run_of[i - 1]]
        ends = [*starts[1:], len(run_of)]
        streams = [((*order_key(keyed[i]), i) for i in range(a, b)) for a, b in zip(starts, ends)]
        order = [key[-1] for _, key in loser_tree(streams)]
        yield from table.select(names).take(pa.array(order, pa.int64())).cast(arrow_schema(ddl)).combine_chunks().to_batches(max_chunksize=10_000)

    parts = max(1, -(-runs.count() // rows))
    dealt = runs.repartitionByRange(parts, *ORDER).sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(run_merge, ddl)


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The histories of all URLs in the archives of ``folder``: one index row per record, globally ordered."""
    return merged(checkpoint(capture_runs(spark, folder)))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, captured, record_type, payload): revisits get the payload of the capture that they refer to."""
    fields = ["page_id", "url", "captured", "record_type", "payload"]
    ddl = "page_id long, url string, captured string, record_type string, refers_to long, payload_digest string, payload binary"

    def slices(entries: Iterator[dict]) -> Iterator[list[dict]]:
        for row in entries:
            yield [row]

    found = read_records(spark, folder, ddl, slices)
    kept = found.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("payload"))
    again = found.filter("record_type = 'revisit'").drop("payload").join(kept, ["refers_to", "payload_digest"], "left")
    return found.filter("record_type != 'revisit'").select(*fields).unionByName(again.select(*fields))
