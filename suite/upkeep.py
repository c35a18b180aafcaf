"""File intake, library synchronisation, metadata resolution, maintenance, request timing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citespark.operators import maintenance as mt
from citespark.operators import metadata as md
from citespark.operators import sync as sy
from citespark.operators import timeline as tl
from citespark.sources import feeds
from citespark.sources import files as fi
from citespark.sources import library_items as li
from citespark.streaming import tables as tb
from suite.documents import _ASSIGNED, assigned
from suite.registry import query

# files ---------------------------------------------------------------------------

# every seventh document is uploaded twice
_FILES = """files AS (SELECT doc_id, concat('/in/', lpad(CAST(doc_id AS VARCHAR), 9, '0'), copy, '.', CASE doc_id % 6 WHEN 0 THEN 'PDF'
    WHEN 1 THEN 'txt' WHEN 2 THEN 'exe' WHEN 3 THEN 'docx' WHEN 4 THEN 'rtf' ELSE 'tar.gz' END) AS path, text
  FROM (SELECT *, unnest(CASE WHEN doc_id % 7 = 0 THEN ['', '-b'] ELSE [''] END) AS copy FROM documents))"""


def _files(t):
    ext = "CASE doc_id % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'txt' WHEN 2 THEN 'exe' WHEN 3 THEN 'docx' WHEN 4 THEN 'rtf' ELSE 'tar.gz' END"
    return t.documents.selectExpr("*", "explode(IF(doc_id % 7 = 0, array('', '-b'), array(''))) AS copy").selectExpr(
        f"concat('/in/', lpad(CAST(doc_id AS STRING), 9, '0'), copy, '.', {ext}) AS path",
        "octet_length(text) AS length",
        "CAST(text AS BINARY) AS content",
    )


@query(
    "ingest_files",
    f"""WITH {_FILES} SELECT path, CASE WHEN lower(regexp_extract(path, '(\\.[^.]*)$', 1)) IN ('.pdf', '.docx', '.doc', '.txt', '.rtf')
  THEN sha256(text) END AS file_hash FROM files""",
)
def ingest_files(t):
    good, bad = fi.ingest_files(_files(t))
    return good.select("path", "file_hash").unionByName(bad.select("path", F.lit(None).cast("string").alias("file_hash")))


@query(
    "decode_text",
    f"""WITH {_FILES} SELECT path, CASE WHEN path LIKE '%.txt' THEN md5(text) END AS text_key,
  CASE WHEN path NOT LIKE '%.txt' THEN 'Failed to extract text from file' END AS processing_error FROM files
WHERE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) IN ('.pdf', '.docx', '.doc', '.txt', '.rtf')""",
)
def decode_text(t):
    out = fi.decode_text(fi.ingest_files(_files(t))[0])
    return out.select("path", F.md5("full_text").alias("text_key"), "processing_error")


_KNOWN_FILES = "known AS (SELECT sha256(text) AS file_hash, min(doc_id) AS paper_id FROM documents WHERE lang = 'de' GROUP BY 1)"


@query(
    "dedupe_by_hash",
    f"""WITH {_FILES}, {_KNOWN_FILES}, hashed AS (SELECT path, sha256(text) AS file_hash FROM files
  WHERE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) IN ('.pdf', '.docx', '.doc', '.txt', '.rtf'))
SELECT min(path) AS file_path, file_hash, 'new' AS kind, NULL AS paper_id FROM hashed
  WHERE file_hash NOT IN (SELECT file_hash FROM known) GROUP BY file_hash
UNION ALL SELECT path, h.file_hash, 'duplicate', k.paper_id FROM hashed h JOIN known k ON k.file_hash = h.file_hash
UNION ALL SELECT path, file_hash, 'same batch', NULL FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY path) AS nth FROM hashed)
  WHERE nth > 1 AND file_hash NOT IN (SELECT file_hash FROM known)""",
)
def dedupe_by_hash(t):
    papers = t.documents.filter("lang = 'de'").selectExpr("doc_id AS paper_id", "sha2(text, 256) AS file_hash")
    fresh, duplicates = fi.dedupe_by_hash(fi.ingest_files(_files(t))[0], papers)
    a = fresh.select("file_path", "file_hash", F.lit("new").alias("kind"), F.lit(None).cast("long").alias("paper_id"))
    kind = F.when(F.col("paper_id").isNull(), "same batch").otherwise("duplicate")
    return a.unionByName(duplicates.select("file_path", "file_hash", kind.alias("kind"), "paper_id"))


# library items -------------------------------------------------------------------

_ITEM_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'journalArticle' WHEN 'SMALL' THEN 'attachment' WHEN 'LARGE' THEN 'note' ELSE 'book' END"


def _raw_items(t):
    """Item records built from parts: papers, PDF attachments of other parts, notes."""
    creators = """array(
      named_struct('creatorType', 'author', 'firstName', IF(p_size % 3 = 0, '', 'Ana'), 'lastName', p_brand),
      named_struct('creatorType', 'editor', 'firstName', 'Ed', 'lastName', 'Itor'),
      named_struct('creatorType', 'author', 'firstName', IF(p_size % 4 = 0, 'Bo ', CAST(NULL AS STRING)), 'lastName', IF(p_size % 5 = 0, '', 'Lee')))"""
    return t.part.selectExpr(
        "concat('K', CAST(p_partkey AS STRING)) AS key",
        "p_size AS version",
        "p_partkey AS seq",
        "concat('groups/', CAST(p_size % 3 AS STRING)) AS library_id",
        f"""named_struct('itemType', {_ITEM_TYPE}, 'title', p_name, 'creators', {creators},
          'abstractNote', IF(p_size % 2 = 0, '', p_type), 'date', IF(p_size % 6 = 0, '', concat('May ', CAST(1960 + p_size AS STRING))),
          'dateAdded', '2020-02-03T04:05:06Z', 'publicationTitle', IF(p_size % 4 = 1, p_brand, ''), 'bookTitle', IF(p_size % 4 = 2, p_type, ''),
          'DOI', IF(p_size % 5 = 0, '', concat('10.1/', CAST(p_partkey % 150 AS STRING))), 'url', IF(p_size % 7 = 0, '', concat('https://u/', CAST(p_partkey AS STRING))),
          'collections', array(concat('C', CAST(p_size % 9 AS STRING)), concat('C', CAST(p_size % 4 AS STRING))),
          'contentType', IF(p_size % 3 = 0, 'text/html', 'application/pdf'),
          'parentItem', IF(p_size % 10 = 0, CAST(NULL AS STRING), concat('K', CAST(p_partkey % 400 AS STRING)))) AS data""",
    )


@query(
    "split_library_items",
    f"""SELECT concat('K', p_partkey) AS key, CASE {_ITEM_TYPE} WHEN 'attachment' THEN 'pdf' ELSE 'paper' END AS kind FROM part
WHERE {_ITEM_TYPE} NOT IN ('note', 'attachment') OR ({_ITEM_TYPE} = 'attachment' AND p_size % 3 <> 0 AND p_size % 10 <> 0)""",
)
def split_library_items(t):
    papers, attachments = li.split_items(_raw_items(t))
    return papers.select("key", F.lit("paper").alias("kind")).unionByName(
        attachments.select("key", F.lit("pdf").alias("kind"))
    )


_ITEMS = """items AS (SELECT concat('K', p_partkey) AS item_key, p_size AS version, p_partkey AS seq, concat('groups/', p_size % 3) AS library_id,
  p_name AS title,
  list_filter([CASE WHEN p_size % 3 = 0 THEN p_brand ELSE trim('Ana ' || p_brand) END,
    CASE WHEN p_size % 4 = 0 THEN trim('Bo  ' || CASE WHEN p_size % 5 = 0 THEN '' ELSE 'Lee' END) WHEN p_size % 5 = 0 THEN '' ELSE 'Lee' END], lambda n: n <> '') AS authors,
  nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, '') AS abstract,
  CASE WHEN p_size % 6 = 0 THEN 2020 ELSE 1960 + p_size END AS year,
  CASE WHEN p_size % 4 = 1 THEN p_brand WHEN p_size % 4 = 2 THEN p_type END AS journal,
  CASE WHEN p_size % 5 <> 0 THEN concat('10.1/', p_partkey % 150) END AS doi,
  CASE WHEN p_size % 7 <> 0 THEN concat('https://u/', p_partkey) END AS source_url
  FROM part)"""


def _items(t):
    return li.map_items(_raw_items(t))


@query(
    "map_library_items",
    f"""WITH {_ITEMS} SELECT item_key, version, title, array_to_string(authors, '|') AS authors, coalesce(abstract, '-') AS abstract, year,
  coalesce(journal, '-') AS journal, coalesce(doi, '-') AS doi, coalesce(source_url, '-') AS source_url FROM items""",
)
def map_library_items(t):
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return _items(t).select(
        "item_key", "version", "title", F.array_join("authors", "|").alias("authors"), dash("abstract"), "year",
        dash("journal"), dash("doi"), dash("source_url"),
    )


@query(
    "item_type_histogram",
    f"SELECT {_ITEM_TYPE} AS item_type, count(*) AS items FROM part GROUP BY 1",
)
def item_type_histogram(t):
    return sy.item_histogram(_raw_items(t).select(F.col("data.itemType").alias("item_type")))


_SELECTED = """selected AS (SELECT DISTINCT concat('groups/', s_nationkey % 3) AS library_id, concat('C', s_suppkey % 11) AS collection_key
  FROM supplier WHERE s_acctbal > 8000)"""


@query(
    "collection_filter",
    f"""WITH {_SELECTED}, held AS (SELECT concat('K', p_partkey) AS item_key, concat('groups/', p_size % 3) AS library_id,
  unnest([concat('C', p_size % 9), concat('C', p_size % 4)]) AS collection_key FROM part)
SELECT DISTINCT item_key FROM held h JOIN selected s ON s.library_id = h.library_id AND s.collection_key = h.collection_key""",
)
def collection_filter(t):
    selected = t.supplier.filter("s_acctbal > 8000").selectExpr(
        "concat('groups/', CAST(s_nationkey % 3 AS STRING)) AS library_id", "concat('C', CAST(s_suppkey % 11 AS STRING)) AS collection_key"
    )
    items = _raw_items(t).select(F.col("key").alias("item_key"), "library_id", F.col("data.collections").alias("collections"))
    return sy.in_collections(items, selected).select("item_key")


@query(
    "modified_since",
    """SELECT concat('K', p_partkey) AS item_key, 'since' AS run FROM part WHERE p_size > 30 OR p_partkey % 9 = 0
UNION ALL SELECT concat('K', p_partkey), 'full' FROM part""",
)
def modified_since(t):
    """Every ninth item has no version."""
    items = _items(t).withColumn("version", F.expr("IF(substr(item_key, 2) % 9 = 0, NULL, version)"))
    a = sy.modified_since(items, 30).select("item_key", F.lit("since").alias("run"))
    return a.unionByName(sy.modified_since(items, 30, force_full=True).select("item_key", F.lit("full").alias("run")))


@query(
    "merge_libraries",
    """SELECT concat('K', p_partkey) AS key, 'users/1' AS library_id FROM part
UNION ALL SELECT concat('K', s_suppkey), 'groups/2' FROM supplier""",
)
def merge_libraries(t):
    """The same key may occur in several libraries."""
    parts = {
        "users/1": t.part.selectExpr("concat('K', CAST(p_partkey AS STRING)) AS key"),
        "groups/2": t.supplier.selectExpr("concat('K', CAST(s_suppkey AS STRING)) AS key"),
    }
    return sy.merge_libraries(parts)


@query(
    "first_attachment",
    f"""WITH atts AS (SELECT concat('K', p_partkey) AS a_key, p_partkey AS seq, concat('K', p_partkey % 400) AS parent_key FROM part
  WHERE {_ITEM_TYPE} = 'attachment' AND p_size % 3 <> 0 AND p_size % 10 <> 0)
SELECT concat('K', p_partkey) AS item_key, f.a_key AS attachment_key, coalesce(f.n, 0) AS attachments FROM part
LEFT JOIN (SELECT parent_key, arg_min(a_key, seq) AS a_key, count(*) AS n FROM atts GROUP BY parent_key) f
  ON f.parent_key = concat('K', p_partkey) WHERE {_ITEM_TYPE} NOT IN ('note', 'attachment')""",
)
def first_attachment(t):
    papers, attachments = li.split_items(_raw_items(t))
    out = sy.first_attachment(li.map_items(papers), li.map_attachments(attachments))
    return out.select("item_key", "attachment_key", F.coalesce("attachments", F.lit(0)).alias("attachments"))


# selections: one stored text per customer, in one of the two formats, or broken
_CONFIG_TEXT = """CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '[not json'
  WHEN c_custkey % 5 = 2 THEN concat('["C', CAST(c_nationkey AS STRING), '","C', CAST(c_custkey % 40 AS STRING), '"]')
  WHEN c_custkey % 5 = 3 THEN concat('[{"key":"C', CAST(c_nationkey AS STRING), '","libraryId":"groups/', CAST(c_custkey % 6 AS STRING), '"}]')
  ELSE concat('["C', CAST(c_nationkey AS STRING), '",{"key":"C9","libraryId":"groups/2"}]') END"""
_CONFIG_GROUPS = "CASE WHEN c_custkey % 3 = 0 THEN concat('[\"groups/', CAST(c_custkey % 7 AS STRING), '\"]') WHEN c_custkey % 3 = 1 THEN NULL ELSE '[]' END"
_SELECTIONS = """sel AS (
  SELECT c_custkey AS user_id, 0 AS position, concat('C', c_nationkey) AS collection_key, CASE WHEN c_custkey % 5 = 3 THEN concat('groups/', c_custkey % 6) END AS library_id
    FROM customer WHERE c_custkey % 5 IN (2, 3, 4)
  UNION ALL SELECT c_custkey, 1, concat('C', c_custkey % 40), NULL FROM customer WHERE c_custkey % 5 = 2
  UNION ALL SELECT c_custkey, 1, 'C9', 'groups/2' FROM customer WHERE c_custkey % 5 = 4)"""
# collections of all libraries: supplier rows; a key can occur in several libraries
# of two kinds of users: keys of one kind of library are unknown to the other users
_COLLECTIONS = """colls AS (SELECT DISTINCT c_custkey AS user_id, concat('C', s_suppkey % 30) AS collection_key, concat('groups/', s_nationkey % 6) AS library_id,
  s_nationkey % 6 AS library_order FROM supplier JOIN customer ON c_custkey % 3 = s_nationkey % 3)"""


def _configs(t):
    return t.customer.selectExpr(
        "c_custkey AS user_id", f"{_CONFIG_TEXT} AS selected_collections", f"{_CONFIG_GROUPS} AS selected_groups",
        "concat('users/', CAST(c_custkey AS STRING)) AS personal_library",
    )


def _collections(t):
    kinds = t.supplier.selectExpr(
        "concat('C', CAST(s_suppkey % 30 AS STRING)) AS collection_key", "s_nationkey % 3 AS kind",
        "concat('groups/', CAST(s_nationkey % 6 AS STRING)) AS library_id", "s_nationkey % 6 AS library_order",
    ).distinct()
    users = t.customer.selectExpr("c_custkey AS user_id", "c_custkey % 3 AS kind")
    # at most 30 keys x 6 libraries, whatever the number of suppliers; three kinds make three tasks of an exchange
    return users.join(F.broadcast(kinds), "kind").drop("kind")


@query("parse_selection", f"WITH {_SELECTIONS} SELECT * FROM sel")
def parse_selection(t):
    return sy.parse_selection(_configs(t), "selected_collections")


@query(
    "locate_collections",
    f"""WITH {_SELECTIONS}, {_COLLECTIONS}, lastlib AS (SELECT user_id, collection_key, arg_max(library_id, library_order) AS found FROM colls GROUP BY 1, 2)
SELECT s.user_id, position, s.collection_key, coalesce(library_id, found) AS library_id FROM sel s
LEFT JOIN lastlib l ON l.collection_key = s.collection_key AND l.user_id = s.user_id""",
)
def locate_collections(t):
    return sy.locate_collections(sy.parse_selection(_configs(t), "selected_collections"), _collections(t))


@query(
    "migrate_collections",
    f"""WITH {_SELECTIONS}, {_COLLECTIONS}, firstlib AS (SELECT user_id, collection_key, arg_min(library_id, library_order) AS found FROM colls GROUP BY 1, 2)
SELECT s.user_id, position, s.collection_key, coalesce(library_id, found) AS library_id FROM sel s
LEFT JOIN firstlib l ON l.collection_key = s.collection_key AND l.user_id = s.user_id
WHERE coalesce(library_id, found) IS NOT NULL""",
)
def migrate_collections(t):
    return sy.migrate_collections(sy.parse_selection(_configs(t), "selected_collections"), _collections(t))


@query(
    "collections_by_library",
    f"""WITH {_SELECTIONS} SELECT user_id, library_id, string_agg(DISTINCT collection_key, '|' ORDER BY collection_key) AS collection_keys
FROM sel WHERE library_id IS NOT NULL GROUP BY user_id, library_id""",
)
def collections_by_library(t):
    found = sy.collections_by_library(sy.parse_selection(_configs(t), "selected_collections"))
    return found.withColumn("collection_keys", F.array_join("collection_keys", "|"))


@query(
    "libraries_to_fetch",
    f"""WITH {_SELECTIONS}, grp AS (SELECT c_custkey AS user_id, concat('groups/', c_custkey % 7) AS library_id FROM customer WHERE c_custkey % 3 = 0),
avail AS (SELECT DISTINCT c_custkey AS user_id, concat('groups/', s_nationkey) AS library_id FROM customer JOIN supplier ON s_nationkey = c_nationkey),
personal AS (SELECT c_custkey AS user_id, concat('users/', c_custkey) AS library_id FROM customer)
SELECT user_id, library_id FROM grp UNION SELECT user_id, library_id FROM sel WHERE library_id IS NOT NULL
UNION SELECT user_id, library_id FROM (SELECT * FROM avail UNION ALL SELECT * FROM personal) WHERE user_id IN (SELECT user_id FROM sel WHERE library_id IS NULL)
UNION SELECT user_id, library_id FROM personal WHERE user_id NOT IN (SELECT user_id FROM sel) AND user_id NOT IN (SELECT user_id FROM grp)""",
)
def libraries_to_fetch(t):
    configs = _configs(t)
    nations = t.supplier.selectExpr("s_nationkey AS c_nationkey").distinct()
    available = t.customer.join(nations, "c_nationkey").selectExpr(
        "c_custkey AS user_id", "concat('groups/', CAST(c_nationkey AS STRING)) AS library_id"
    )
    return sy.libraries_to_fetch(
        configs, sy.parse_groups(configs, "selected_groups"), sy.parse_selection(configs, "selected_collections"), available
    )


# stored state and papers of user 1
_STATE = """state AS (SELECT 1 AS user_id, concat('K', p_partkey) AS item_key, p_size + CASE WHEN p_type = 'PROMO' THEN 1 ELSE -1 END AS version,
    concat('p', p_partkey) AS paper_id FROM part WHERE p_retailprice < 930 OR p_size < 15
  UNION ALL SELECT 2, concat('K', p_partkey), 0, concat('p', p_partkey) FROM part)"""
_HELD = """held AS (SELECT concat('p', p_partkey) AS paper_id, p_brand AS title, CASE WHEN p_size % 2 = 0 THEN ['Old Author'] ELSE CAST([] AS VARCHAR[]) END AS authors,
    CASE WHEN p_size % 3 = 0 THEN 'old abstract' WHEN p_size % 3 = 1 THEN '' END AS abstract, CAST(CASE WHEN p_size % 4 = 0 THEN 1999 END AS INT) AS year,
    CASE WHEN p_size % 5 = 0 THEN 'Old Journal' END AS journal,
    CASE WHEN p_size < 15 AND p_partkey % 150 < 75 THEN concat('10.1/', p_partkey % 150) END AS doi,
    CASE WHEN p_size % 6 = 0 THEN 'old url' END AS source_url, CASE WHEN p_size % 2 = 0 THEN 'upload' END AS source,
    CAST(NULL AS VARCHAR) AS item_key, p_size AS citation_count FROM part WHERE p_retailprice < 930 OR p_size < 15)"""


def _state(t):
    one = t.part.filter("p_retailprice < 930 OR p_size < 15").selectExpr(
        "1 AS user_id", "concat('K', CAST(p_partkey AS STRING)) AS item_key",
        "p_size + IF(p_type = 'PROMO', 1, -1) AS version", "concat('p', CAST(p_partkey AS STRING)) AS paper_id",
    )
    return one.unionByName(
        t.part.selectExpr("2 AS user_id", "concat('K', CAST(p_partkey AS STRING)) AS item_key", "0 AS version", "concat('p', CAST(p_partkey AS STRING)) AS paper_id")
    )


def _held(t):
    return t.part.filter("p_retailprice < 930 OR p_size < 15").selectExpr(
        "concat('p', CAST(p_partkey AS STRING)) AS paper_id", "p_brand AS title",
        "IF(p_size % 2 = 0, array('Old Author'), CAST(array() AS ARRAY<STRING>)) AS authors",
        "CASE WHEN p_size % 3 = 0 THEN 'old abstract' WHEN p_size % 3 = 1 THEN '' END AS abstract",
        "CAST(CASE WHEN p_size % 4 = 0 THEN 1999 END AS INT) AS year",
        "CASE WHEN p_size % 5 = 0 THEN 'Old Journal' END AS journal",
        "CASE WHEN p_size < 15 AND p_partkey % 150 < 75 THEN concat('10.1/', CAST(p_partkey % 150 AS STRING)) END AS doi",
        "CASE WHEN p_size % 6 = 0 THEN 'old url' END AS source_url", "CASE WHEN p_size % 2 = 0 THEN 'upload' END AS source",
        "CAST(NULL AS STRING) AS item_key", "p_size AS citation_count",
    )


_PLAN = f"""{_ITEMS}, {_STATE}, {_HELD},
known AS (SELECT i.*, s.version AS stored, s.paper_id AS synced,
  CASE WHEN s.version >= i.version THEN 'skip' WHEN s.version IS NOT NULL THEN 'update' ELSE 'unknown' END AS st
  FROM items i LEFT JOIN state s ON s.item_key = i.item_key AND s.user_id = 1),
owners AS (SELECT doi, min(paper_id) AS owner FROM held WHERE doi IS NOT NULL GROUP BY doi),
firsts AS (SELECT doi, arg_min(item_key, seq) AS first_key FROM known WHERE st = 'unknown' AND doi IS NOT NULL GROUP BY doi),
plan AS (SELECT k.item_key, k.version, k.seq, k.title, k.authors, k.abstract, k.year, k.journal, k.doi, k.source_url,
  CASE WHEN st <> 'unknown' THEN st WHEN o.owner IS NOT NULL THEN 'link' WHEN f.first_key <> k.item_key THEN 'link' ELSE 'insert' END AS action,
  CASE WHEN st <> 'unknown' THEN synced ELSE coalesce(o.owner, concat('new-', coalesce(f.first_key, k.item_key))) END AS paper_id
  FROM known k LEFT JOIN owners o ON o.doi = k.doi AND st = 'unknown' LEFT JOIN firsts f ON f.doi = k.doi AND st = 'unknown')"""


def plan(t):
    return sy.sync_plan(_items(t), _state(t), _held(t), 1)


@query("sync_plan", f"WITH {_PLAN} SELECT item_key, action, paper_id FROM plan")
def sync_plan(t):
    return plan(t).select("item_key", "action", "paper_id")


@query("sync_counts", f"WITH {_PLAN} SELECT action, count(*) AS items FROM plan GROUP BY action")
def sync_counts(t):
    return sy.sync_counts(plan(t))


_FIELDS = ["title", "authors", "abstract", "year", "journal", "doi", "source_url"]


def _present(c: str, prefix: str = "") -> str:
    x = f"{prefix}{c}"
    return {"authors": f"len({x}) > 0", "year": f"{x} <> 0"}.get(c, f"{x} <> ''")


_GAPS = ", ".join(f"arg_min({c}, seq) FILTER (WHERE {_present(c)}) AS {c}" for c in _FIELDS)


def _new_value(c: str) -> str:
    updated = f"coalesce(u.{c}, h.{c})" if c == "source_url" else f"u.{c}"
    return (
        f"CASE WHEN u.item_key IS NOT NULL THEN {updated} WHEN coalesce({_present(c, 'h.')}, false) THEN h.{c} "
        f"ELSE coalesce(g.{c}, h.{c}) END AS {c}"
    )


_SNAPSHOT = f"""{_PLAN}, gaps AS (SELECT paper_id, {_GAPS}, arg_min(item_key, seq) AS item_key, bool_or(action = 'insert') AS ins
  FROM plan WHERE action IN ('link', 'insert') GROUP BY paper_id),
snapshot AS (SELECT h.paper_id, {', '.join(_new_value(c) for c in _FIELDS)}, coalesce(u.item_key, g.item_key) AS item_key,
    CASE WHEN u.item_key IS NOT NULL THEN 'zotero' WHEN h.source IS NULL AND g.item_key IS NOT NULL THEN 'zotero' ELSE h.source END AS source,
    CASE WHEN u.item_key IS NOT NULL THEN 0 ELSE h.citation_count END AS citation_count
  FROM held h LEFT JOIN (SELECT * FROM plan WHERE action = 'update') u ON u.paper_id = h.paper_id LEFT JOIN gaps g ON g.paper_id = h.paper_id
  UNION ALL SELECT paper_id, {', '.join(_FIELDS)}, item_key, 'zotero', 0 FROM gaps WHERE ins)"""


_SNAPSHOT_ROWS = f"""WITH {_SNAPSHOT} SELECT paper_id, title, coalesce(array_to_string(authors, '|'), '') AS authors, coalesce(abstract, '-') AS abstract,
  coalesce(year, 0) AS year, coalesce(journal, '-') AS journal, coalesce(doi, '-') AS doi, coalesce(source_url, '-') AS source_url,
  coalesce(item_key, '-') AS item_key, coalesce(source, '-') AS source, citation_count FROM snapshot"""


def _snapshot_rows(out):
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return out.select(
        "paper_id", "title", F.coalesce(F.array_join("authors", "|"), F.lit("")).alias("authors"), dash("abstract"),
        F.coalesce("year", F.lit(0)).alias("year"), dash("journal"), dash("doi"), dash("source_url"), dash("item_key"),
        dash("source"), "citation_count",
    )


@query("apply_sync", _SNAPSHOT_ROWS)
def apply_sync(t):
    return _snapshot_rows(sy.apply_sync(_held(t), plan(t)))


@query("apply_sync_deltas", _SNAPSHOT_ROWS)
def apply_sync_deltas(t):
    """The same rows from a table by key: papers as its base, what the plan changes as one batch, merged when read."""
    held = _held(t)
    table = tb.KeyedTable(t.spark, tb.work_folder(t.spark), held.schema, ("paper_id",))
    table.seed(held)
    rows = plan(t)
    table.write(sy.changed_papers(table.read(0, table.buckets_of(rows.filter("action <> 'skip'"))), rows), 0)
    return _snapshot_rows(table.read())


@query(
    "latest_by_deltas",
    """SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderdate, o_orderkey) AS o_orderdate, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
FROM orders GROUP BY o_custkey""",
)
def latest_by_deltas(t):
    """Orders arrive in four batches by key; each writes its customers' last orders, after two the buckets are merged."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    table = tb.KeyedTable(t.spark, tb.work_folder(t.spark), orders.schema, ("o_custkey",), buckets=16)
    top = orders.agg(F.max("o_orderkey")).first()[0] or 0
    for n in range(4):
        table.compact(n, 2)
        part = orders.filter(F.floor(F.col("o_orderkey") * 4 / (top + 1)) == n)
        last = part.groupBy("o_custkey").agg(F.max_by(F.struct(*part.columns), "o_orderkey").alias("row"))
        table.write(last.select("row.*"), n)
    return table.read()


@query(
    "apply_sync_state",
    f"""WITH {_PLAN} SELECT 1 AS user_id, item_key, version, paper_id FROM plan WHERE action <> 'skip'
UNION ALL SELECT user_id, item_key, version, paper_id FROM state s WHERE user_id = 2 OR item_key IN (SELECT item_key FROM plan WHERE action = 'skip')""",
)
def apply_sync_state(t):
    return sy.apply_sync_state(_state(t), plan(t), 1)


@query(
    "sync_rejects",
    "SELECT concat('K', p_partkey) AS item_key, CASE WHEN p_size > 45 THEN 'no version' ELSE 'ok' END AS reason FROM part",
)
def sync_rejects(t):
    rows = _items(t).withColumn("version", F.when(F.col("version") <= 45, F.col("version")))
    good, bad = sy.split_failures(rows)
    return good.select("item_key", F.lit("ok").alias("reason")).unionByName(bad.select("item_key", "reason"))


@query("sync_mark", "SELECT CAST(coalesce(max(p_size), 5) AS BIGINT) AS mark FROM part WHERE p_size < 44")
def sync_mark(t):
    """A failed item at version 44 keeps the mark below it."""
    items = _items(t)
    return sy.high_water(items.filter("version <> 44"), items.filter("version = 44"), 5)


# metadata ------------------------------------------------------------------------

_META = """idents AS (SELECT paper_id, arxiv_id, CASE WHEN paper_id % 3 = 0 THEN concat('10.9/', paper_id) ELSE nullif(doi, '') END AS doi FROM papers),
feed AS (SELECT arxiv_id, concat('Feed ', paper_id) AS title, year + 1 AS year FROM papers WHERE arxiv_id IS NOT NULL AND citation_count > 100),
works AS (SELECT doi, concat('Work ', max(paper_id)) AS title, CAST(max(paper_id) AS INT) AS citation_count, 'WJ' AS journal FROM idents WHERE doi IS NOT NULL AND doi NOT LIKE '%7' GROUP BY doi),
guess AS (SELECT paper_id, concat('Guess ', paper_id) AS title, 1950 AS year FROM papers WHERE is_processed)"""


@query(
    "resolve_metadata",
    f"""WITH {_META} SELECT p.paper_id, CASE WHEN f.arxiv_id IS NOT NULL THEN 'arxiv' WHEN w.doi IS NOT NULL THEN 'crossref' ELSE 'text_extraction' END AS metadata_source,
  coalesce(CASE WHEN f.arxiv_id IS NOT NULL THEN f.title WHEN w.doi IS NOT NULL THEN w.title ELSE g.title END, p.title) AS title,
  coalesce(CASE WHEN f.arxiv_id IS NOT NULL THEN f.year WHEN w.doi IS NOT NULL THEN NULL ELSE g.year END, p.year, 0) AS year,
  coalesce(CASE WHEN f.arxiv_id IS NULL AND w.doi IS NOT NULL THEN w.journal END, p.journal, '-') AS journal,
  coalesce(CASE WHEN f.arxiv_id IS NULL AND w.doi IS NOT NULL THEN w.citation_count END, p.citation_count) AS citation_count,
  coalesce(i.doi, p.doi, '-') AS doi
FROM papers p JOIN idents i ON i.paper_id = p.paper_id LEFT JOIN feed f ON f.arxiv_id = i.arxiv_id LEFT JOIN works w ON w.doi = i.doi
LEFT JOIN guess g ON g.paper_id = p.paper_id""",
    "papers",
)
def resolve_metadata(t):
    idents = t.papers.selectExpr(
        "paper_id", "arxiv_id", "CASE WHEN paper_id % 3 = 0 THEN concat('10.9/', CAST(paper_id AS STRING)) ELSE nullif(doi, '') END AS doi"
    )
    feed = t.papers.filter("arxiv_id IS NOT NULL AND citation_count > 100").selectExpr(
        "arxiv_id", "concat('Feed ', CAST(paper_id AS STRING)) AS title", "year + 1 AS year"
    )
    works = idents.filter("doi NOT LIKE '%7'").groupBy("doi").agg(F.max("paper_id").alias("m")).selectExpr(
        "doi", "concat('Work ', CAST(m AS STRING)) AS title", "CAST(m AS INT) AS citation_count", "'WJ' AS journal"
    )
    guess = t.papers.filter("is_processed").selectExpr("paper_id", "concat('Guess ', CAST(paper_id AS STRING)) AS title", "1950 AS year")
    papers = t.papers.select("paper_id", "title", "year", "journal", "citation_count", "doi")
    out = md.resolve_metadata(papers, idents, feed, works, guess)
    return out.select(
        "paper_id", "metadata_source", "title", F.coalesce("year", F.lit(0)).alias("year"),
        F.coalesce("journal", F.lit("-")).alias("journal"), "citation_count", F.coalesce("doi", F.lit("-")).alias("doi"),
    )


@query(
    "parse_bibtex",
    """SELECT paper_id, title, coalesce(array_to_string(authors, '|'), '-') AS authors, coalesce(year, 0) AS year, coalesce(journal, '-') AS journal,
  coalesce(doi, '-') AS doi, coalesce(arxiv_id, '-') AS arxiv_id,
  concat('It''s about ', title, ', "so" to say') AS abstract FROM bib_papers""".replace('"so"', "''''so''''"),
    "bib_papers",
)
def parse_bibtex(t):
    """Entries written by the exporter are read back, with apostrophes, commas and protected words."""
    from citespark.functions.citations import bibtex_of

    # a small file of many rows is one task, unless they are dealt out
    dealt = t.bib_papers.repartition(t.spark.sparkContext.defaultParallelism)
    papers = dealt.withColumn("abstract", F.expr("concat('It\\'s about {', title, '}, \"so\" to say')"))
    made = papers.select(
        "paper_id", F.replace(bibtex_of(), F.lit("howpublished ="), F.lit("journal =")).alias("entry")
    )
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return feeds.parse_bibtex(made, "entry").select(
        "paper_id", "title", F.coalesce(F.array_join("authors", "|"), F.lit("-")).alias("authors"),
        F.coalesce("year", F.lit(0)).alias("year"), dash("journal"), dash("doi"), dash("arxiv_id"), "abstract",
    )


@query(
    "map_works_records",
    """SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN -1 WHEN doc_id % 3 = 1 THEN 2001 ELSE 2002 END AS year,
  CASE WHEN doc_id % 2 = 0 THEN 'Ana Berg|Lee' ELSE '-' END AS authors, source AS journal, n_chars AS citation_count FROM documents""",
)
def map_works_records(t):
    """Works records built as JSON from the documents, then mapped."""
    raw = t.documents.selectExpr(
        "doc_id",
        """to_json(map_filter(map(
          'title', to_json(array(split_part(text, chr(10), 1))),
          'author', IF(doc_id % 2 = 0, '[{"given":"Ana","family":"Berg"},{"family":"Lee"},{}]', '[]'),
          'published-print', CASE doc_id % 3 WHEN 0 THEN '{"date-parts":[[]]}' WHEN 1 THEN '{"date-parts":[[2001,5]]}' END,
          'published-online', '{"date-parts":[[2002]]}',
          'container-title', to_json(array(source)), 'is-referenced-by-count', CAST(n_chars AS STRING)), (k, v) -> v IS NOT NULL)) AS j""",
    )
    # values are JSON texts themselves: splice them in without their quotes
    body = F.expr("""concat('{', array_join(transform(map_entries(from_json(j, 'map<string,string>')), e -> concat('"', e.key, '":', e.value)), ','), '}')""")
    out = feeds.map_works_record(raw.select("doc_id", body.alias("j")), "j")
    return out.select(
        "doc_id", "title", F.coalesce("year", F.lit(-1)).alias("year"),
        F.coalesce(F.array_join("authors", "|"), F.lit("-")).alias("authors"), "journal", F.col("citation_count").cast("long"),
    )


@query(
    "map_atom_entries",
    """SELECT doc_id, concat('On ', source, ' & ', lang) AS title, concat('Ana ', lang, '|Bo') AS authors, 2000 + doc_id % 20 AS year,
  CASE WHEN doc_id % 2 = 0 THEN concat('10.1/', doc_id) ELSE '-' END AS doi, concat('arXiv (cs.', upper(lang), ')') AS venue FROM documents""",
)
def map_atom_entries(t):
    """Atom entries built as XML from the documents, then mapped."""
    xml = F.expr(
        """concat('<entry xmlns="http://www.w3.org/2005/Atom"><title>  On ', source, chr(10), '  &amp; ', lang, ' </title><summary> some  text </summary>',
        '<published>', CAST(2000 + doc_id % 20 AS STRING), '-01-15T00:00:00Z</published><author><name> Ana ', lang, ' </name></author><author><name>Bo</name></author>',
        IF(doc_id % 2 = 0, concat('<link title="doi" href="http://dx.doi.org/10.1/', CAST(doc_id AS STRING), '" rel="related"/>'), ''),
        '<link title="pdf" href="http://x/pdf" type="application/pdf" rel="related"/><category term="cs.', upper(lang), '"/><category term="cs.LG"/></entry>')"""
    )
    out = feeds.map_atom_entry(t.documents.select("doc_id", xml.alias("x")), "x")
    return out.select(
        "doc_id", "title", F.array_join("authors", "|").alias("authors"), "year", F.coalesce("doi", F.lit("-")).alias("doi"), "venue"
    )


# maintenance ---------------------------------------------------------------------

_REQUESTED = "requested AS (SELECT DISTINCT document_id FROM assignments WHERE quantity = 50)"


@query(
    "bulk_delete",
    f"""WITH {_REQUESTED}, doomed AS (SELECT document_id FROM user_documents WHERE owner_id = 77 AND document_id IN (SELECT document_id FROM requested))
SELECT (SELECT count(*) FROM doomed) AS deleted_count, (SELECT count(*) FROM requested) AS requested_count,
  (SELECT count(*) FROM user_documents) - (SELECT count(*) FROM doomed) AS remaining""",
    "user_documents assignments",
)
def bulk_delete(t):
    requested = t.assignments.filter("quantity = 50").select("document_id").distinct()
    rest, counts = mt.bulk_delete(t.user_documents, requested, 77)
    return counts.withColumn("remaining", rest.agg(F.count("*")).scalar())


@query(
    "cascade_delete",
    f"""WITH {_ASSIGNED}, gone AS (SELECT document_id FROM user_documents WHERE owner_id <= 700)
SELECT document_id, paper_id FROM assigned WHERE document_id NOT IN (SELECT document_id FROM gone)""",
    "user_documents assignments",
)
def cascade_delete(t):
    gone = t.user_documents.filter("owner_id <= 700")
    return mt.cascade(gone, {"assignments": assigned(t)}, "document_id")["assignments"].select("document_id", "paper_id")


@query(
    "clear_tables",
    """SELECT 'documents' AS table_name, count(*) AS n, 0 AS after FROM user_documents
UNION ALL SELECT 'assignments', count(*), 0 FROM assignments""",
    "user_documents assignments",
)
def clear_tables(t):
    tables = {"documents": t.user_documents, "assignments": t.assignments}
    empty, _ = mt.clear_tables(tables, "2024-01-01 00:00:00")
    after = mt.table_counts(empty).withColumnRenamed("n", "after")
    return mt.table_counts(tables).join(after, "table_name")


@query(
    "table_counts",
    """SELECT 'papers' AS table_name, count(*) AS n FROM papers UNION ALL SELECT 'chunks', count(*) FROM paper_chunks
UNION ALL SELECT 'documents', count(*) FROM user_documents UNION ALL SELECT 'assignments', count(*) FROM assignments""",
    "papers paper_chunks user_documents assignments",
)
def table_counts(t):
    return mt.table_counts(
        {"papers": t.papers, "chunks": t.paper_chunks, "documents": t.user_documents, "assignments": t.assignments}
    )


@query(
    "normalise_identifiers",
    """SELECT paper_id, coalesce(nullif(doi, ''), '-') AS doi, coalesce(nullif(arxiv_id, ''), '-') AS arxiv_id,
  coalesce(nullif(pubmed_id, ''), '-') AS pubmed_id FROM papers""",
    "papers",
)
def normalise_identifiers(t):
    out = mt.normalise_identifiers(t.papers)
    return out.select("paper_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("doi", "arxiv_id", "pubmed_id")])


_IDS = ["doi", "arxiv_id", "pubmed_id", "semantic_scholar_id"]
_RULES = [f"SELECT '{c} not empty' AS rule, count(*) AS violations FROM papers WHERE {c} = ''" for c in _IDS] + [
    f"SELECT 'unique ({c})', count(*) FROM (SELECT {c} FROM papers WHERE {c} <> '' GROUP BY {c} HAVING count(*) > 1)" for c in _IDS
] + [
    "SELECT 'unique (document_id, paper_id)', count(*) FROM (SELECT 1 FROM assignments GROUP BY document_id, paper_id HAVING count(*) > 1)",
    "SELECT 'unique (user_id, item_key)', count(*) FROM (SELECT 1 FROM state GROUP BY user_id, item_key HAVING count(*) > 1)",
    "SELECT 'assignment without parent', count(*) FROM assignments a WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.paper_id = a.paper_id)",
    "SELECT 'chunk without parent', count(*) FROM paper_chunks c WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.paper_id = c.paper_id)",
    "SELECT 'year 1900 to 2100', count(*) FROM papers WHERE year NOT BETWEEN 1900 AND 2100",
    "SELECT 'vector length 64', count(*) FROM paper_chunks WHERE embedding IS NOT NULL AND len(embedding) <> 64",
]


@query("check_constraints", f"WITH {_STATE} " + "\nUNION ALL ".join(_RULES), "papers assignments paper_chunks")
def check_constraints(t):
    return mt.check_constraints(t.papers, t.assignments, _state(t), t.paper_chunks, 64)


@query(
    "apply_outcomes",
    """SELECT p.paper_id, CASE WHEN l.doc_id IS NULL THEN p.is_processed ELSE l.toxic = 0 END AS is_processed,
  CASE WHEN l.doc_id IS NULL THEN p.processing_error WHEN l.toxic = 1 THEN 'broken' END AS processing_error,
  CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS stamp FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id""",
    "papers",
)
def apply_outcomes(t):
    outcomes = t.labels.selectExpr("doc_id AS paper_id", "CASE WHEN toxic = 1 THEN 'broken' END AS error")
    out = mt.apply_outcomes(t.papers, outcomes, "2030-01-01 00:00:00")
    stamp = F.when(F.year("updated_at") == 2030, "new").otherwise("old")
    return out.select("paper_id", "is_processed", "processing_error", stamp.alias("stamp"))


@query(
    "reset_for_processing",
    """SELECT p.paper_id, l.doc_id IS NULL AND p.is_processed AS is_processed, CASE WHEN l.doc_id IS NULL THEN p.processing_error END AS processing_error
FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id""",
    "papers",
)
def reset_for_processing(t):
    out = mt.reset_for_processing(t.papers, t.labels.selectExpr("doc_id AS paper_id"))
    return out.select("paper_id", "is_processed", "processing_error")


@query(
    "merge_metadata",
    """SELECT p.paper_id, coalesce(CASE WHEN l.quality = 1 THEN 'Better' END, p.title) AS title, coalesce(l.quality + 2000, p.year, 0) AS year
FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id""",
    "papers",
)
def merge_metadata(t):
    resolved = t.labels.selectExpr("doc_id AS paper_id", "CASE WHEN quality = 1 THEN 'Better' END AS title", "quality + 2000 AS year")
    out = mt.merge_metadata(t.papers.select("paper_id", "title", "year"), resolved, ["title", "year"])
    return out.select("paper_id", "title", F.coalesce("year", F.lit(0)).alias("year"))


# request timing --------------------------------------------------------------------
# users of the event table act hours apart, so windows are hours here


@query(
    "sliding_request_count",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL '21599.999999' SECOND PRECEDING AND CURRENT ROW) AS recent FROM events""",
)
def sliding_request_count(t):
    return tl.sliding_count(t.events, "user_id", "ts", 6 * 3600).select("event_id", "recent")


_DEBOUNCED = """quiet AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
kept AS (SELECT * FROM quiet WHERE nxt IS NULL OR nxt - ts >= INTERVAL 2 HOUR)"""


@query("debounce_batch", f"WITH {_DEBOUNCED} SELECT event_id FROM kept")
def debounce_batch(t):
    return tl.debounce(t.events, "user_id", "ts", 2 * 3600, "event_id").select("event_id")


@query(
    "changed_requests",
    f"""WITH {_DEBOUNCED} SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM kept)
WHERE prev IS NULL OR prev <> event_type""",
)
def changed_requests(t):
    kept = tl.debounce(t.events, "user_id", "ts", 2 * 3600, "event_id")
    return tl.changed(kept, "user_id", ["ts", "event_id"], "event_type", tl.time_bucket("ts")).select("event_id")


@query(
    "changed_texts",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, text, lag(text) OVER w AS prev, row_number() OVER w AS n FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE n = 1 OR prev IS DISTINCT FROM text""".replace("said", "(SELECT conv_id, turn, CASE WHEN turn % 4 IN (1, 2) THEN NULL ELSE text END AS text FROM conversations) AS said"),
)
def changed_texts(t):
    """Turns whose whole text differs from the one before; two turns of every four have none and equal each other."""
    said = t.conversations.select("conv_id", "turn", F.when(~(F.col("turn") % 4).isin(1, 2), F.col("text")).alias("text"))
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    found = tl.changed(said, "conv_id", ["turn"], "text", tl.number_bucket("turn", 3)).select("conv_id", "turn")
    opening = said.withColumn("n", first).filter("n = 1").select("conv_id", "turn")
    return found.unionByName(opening).distinct()


@query(
    "neighbour_turns",
    """SELECT conv_id, turn, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def neighbour_turns(t):
    rows = tl.previous_row(t.conversations, ["conv_id"], ["turn"], ["text"], tl.number_bucket("turn", 3))
    rows = tl.next_row(rows, ["conv_id"], ["turn"], ["text"], tl.number_bucket("turn", 3))
    return rows.select("conv_id", "turn", "prev_text", "next_text")


# replayed per user in time order by a recursive query: state is the list of accepted times
_RATE = """WITH RECURSIVE numbered AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
run AS (
  SELECT user_id, event_id, i, [ts] AS taken, true AS accepted FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.user_id, n.event_id, n.i,
    CASE WHEN len(list_filter(r.taken, lambda x: n.ts - x < INTERVAL 12 HOUR)) < 3
         THEN list_append(list_filter(r.taken, lambda x: n.ts - x < INTERVAL 12 HOUR), n.ts)
         ELSE list_filter(r.taken, lambda x: n.ts - x < INTERVAL 12 HOUR) END,
    len(list_filter(r.taken, lambda x: n.ts - x < INTERVAL 12 HOUR)) < 3
  FROM run r JOIN numbered n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT event_id, accepted FROM run"""


@query("rate_limit_batch", _RATE)
def rate_limit_batch(t):
    return tl.rate_limit(t.events, "user_id", "ts", "event_id", 3, 12 * 3600).select("event_id", "accepted")
