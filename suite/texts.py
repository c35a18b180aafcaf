"""Text functions, chunks, identifiers, citation formats, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from citespark.functions import citations as cf
from citespark.functions import heuristics as hx
from citespark.functions import identifiers as ids
from citespark.functions import text as tx
from citespark.operators import chunks as co
from citespark.operators import embedding as em
from suite import sqltext as q
from suite.registry import query

_PREPROCESS = q.strip(
    "regexp_replace(regexp_replace(regexp_replace("
    + q.collapse("text")
    + r", '[^\p{L}\p{N}_.!?,;:\-() ]', '', 'g'), '\.{2,}', '.', 'g'), ' +([.!?])', '\1', 'g')"
)
_SENTENCE = "'[^.!?\\n]+[.!?]+" + q.WS + "*|[^.!?\\n]+'"


@query("preprocess_text", f"SELECT doc_id, md5({_PREPROCESS}) AS cleaned FROM documents")
def preprocess_text(t):
    return t.documents.select("doc_id", F.md5(tx.preprocess_text(F.col("text"))).alias("cleaned"))


def _sentence_sql(source: str, key: str) -> str:
    return f"""WITH found AS (SELECT {key}, list_filter(list_transform(
    CASE WHEN len(regexp_extract_all(text, {_SENTENCE})) > 0 THEN regexp_extract_all(text, {_SENTENCE})
         ELSE string_split(text, chr(10)) END,
    lambda s: {q.strip('s')}), lambda s: s <> '') AS sents FROM {source})"""


@query(
    "split_sentences",
    _sentence_sql("documents", "doc_id")
    + " SELECT doc_id, len(sents) AS n, md5(array_to_string(sents, '|')) AS joined FROM found",
)
def split_sentences(t):
    s = tx.sentences(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("joined")
    )


@query(
    "server_sentences",
    f"""WITH clean AS (SELECT doc_id, {_PREPROCESS} AS text FROM documents),
{_sentence_sql('clean', 'doc_id')[5:]}
SELECT doc_id, len(list_filter(sents, lambda s: length(s) >= 10)) AS n FROM found""",
)
def server_sentences(t):
    """Sentences of cleaned text with at least ten characters."""
    s = tx.sentences(tx.preprocess_text(F.col("text")), tx.MIN_SENTENCE_CHARS)
    return t.documents.select("doc_id", F.size(s).cast("long").alias("n"))


@query(
    "sentence_neighbours",
    _sentence_sql("conversations", "conv_id, turn")
    + """, flat AS (SELECT conv_id, turn, unnest(sents) AS sentence, unnest(range(len(sents))) AS pos FROM found)
SELECT conv_id, turn, pos, sentence,
  lag(sentence) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS previous,
  lead(sentence) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS next FROM flat""",
)
def sentence_neighbours(t):
    """Previous and next sentence come from the sentence array; no window, no shuffle."""
    rows = t.conversations.withColumn("sents", tx.sentences(F.col("text")))
    return rows.select("conv_id", "turn", "sents", F.posexplode("sents").alias("p", "sentence")).select(
        "conv_id",
        "turn",
        F.col("p").cast("long").alias("pos"),
        "sentence",
        F.when(F.col("p") > 0, F.get("sents", F.col("p") - 1)).alias("previous"),
        F.get("sents", F.col("p") + 1).alias("next"),
    )


_TURN_PAIRS = """turns AS (SELECT a.conv_id, a.turn, a.text AS old_text, b.text AS new_text
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_OLD, _NEW = (q.collapse(q.strip(c)) for c in ("old_text", "new_text"))


@query(
    "change_ratio",
    f"""WITH {_TURN_PAIRS}, clean AS (SELECT conv_id, turn, old_text, new_text, {_OLD} AS o, {_NEW} AS n FROM turns),
chars AS (SELECT *, string_split(o, '') AS oc, string_split(n, '') AS nc FROM clean),
ratio AS (SELECT *, CASE WHEN o = '' AND n = '' THEN 0.0::DOUBLE WHEN o = '' OR n = '' THEN 1.0::DOUBLE
  ELSE 1.0::DOUBLE - len(list_filter(list_zip(oc, nc), lambda p: p[1] = p[2]))::DOUBLE
       / greatest(length(o), length(n))::DOUBLE END AS r FROM chars)
SELECT conv_id, turn, round(r, 6) AS ratio,
  CASE WHEN old_text = new_text THEN false WHEN o = '' THEN length(n) > 10 ELSE r > 0.2 END AS should_update FROM ratio""",
)
def change_ratio(t):
    nxt = t.conversations.selectExpr("conv_id", "turn - 1 AS turn", "text AS new_text")
    pairs = t.conversations.selectExpr("conv_id", "turn", "text AS old_text").join(nxt, ["conv_id", "turn"])
    o, n = F.col("old_text"), F.col("new_text")
    return pairs.select(
        "conv_id", "turn", F.round(tx.change_ratio(o, n), 6).alias("ratio"),
        tx.should_update(o, n).alias("should_update"),
    )


_NO_MARKS = q.strip("regexp_replace(s, '[.!?]+" + q.WS + "*$', '')")


@query(
    "strip_final_punct",
    f"""SELECT conv_id, turn, CASE WHEN {_NO_MARKS} = '' THEN s ELSE {_NO_MARKS} END AS sentence
FROM (SELECT conv_id, turn, text AS s FROM conversations)""",
)
def strip_final_punct(t):
    return t.conversations.select("conv_id", "turn", tx.strip_final_punct(F.col("text")).alias("sentence"))


@query(
    "request_length_gate",
    f"SELECT conv_id, turn FROM conversations WHERE length({q.strip('text')}) >= 10",
)
def request_length_gate(t):
    return t.conversations.filter(tx.long_enough(F.col("text"))).select("conv_id", "turn")


@query(
    "extract_context",
    f"""WITH RECURSIVE clean AS (SELECT rid, conv_id, turn, original, {_PREPROCESS} AS text
  FROM (SELECT row_number() OVER () AS rid, conv_id, turn, text, text AS original FROM conversations)),
{_sentence_sql('clean', 'rid, conv_id, turn, original')[5:]},
sized AS (SELECT *, list_filter(sents, lambda s: length(s) >= 10) AS s, length(original) // 2 AS cur FROM found),
fold AS (SELECT rid, 0::BIGINT AS seen, 0::BIGINT AS stop, -1::BIGINT AS hit FROM sized
  UNION ALL SELECT rid, seen + 1, CASE WHEN place > 0 THEN stop + place - 1 + length(one) ELSE stop END,
    CASE WHEN hit < 0 AND place > 0 AND cur <= stop + place - 1 + length(one) THEN seen ELSE hit END
  FROM (SELECT f.*, z.cur, z.s[f.seen + 1] AS one, instr(substr(z.original, f.stop + 1), z.s[f.seen + 1]) AS place
    FROM fold f JOIN sized z ON z.rid = f.rid WHERE f.seen < len(z.s))),
chosen AS (SELECT rid, CASE WHEN max(hit) >= 0 THEN max(hit) ELSE greatest(max(seen) - 1, 0) END AS i FROM fold GROUP BY rid),
parts AS (SELECT rid, cur, regexp_split_to_array(original, '\\n{q.WS}*\\n') AS ps FROM sized),
flat AS (SELECT rid, cur, unnest(ps) AS p, unnest(range(len(ps))) AS i, len(ps) AS n FROM parts),
ends AS (SELECT *, sum(length(p)) OVER (PARTITION BY rid ORDER BY i) + 2 * i AS stop FROM flat),
hits AS (SELECT rid, n, min(CASE WHEN cur <= stop THEN i END) AS hit FROM ends GROUP BY rid, n)
SELECT z.conv_id, z.turn, coalesce(z.s[c.i + 1], '') AS current_sentence, CASE WHEN c.i > 0 THEN z.s[c.i] END AS previous_sentence,
  z.s[c.i + 2] AS next_sentence, {q.strip('e.p')} AS paragraph, CAST(NULL AS VARCHAR) AS section, CAST(z.cur AS INT) AS position
FROM sized z JOIN chosen c ON c.rid = z.rid JOIN hits h ON h.rid = z.rid JOIN ends e ON e.rid = z.rid AND e.i = coalesce(h.hit, h.n - 1)""",
)
def extract_context(t):
    """Cursor context of every turn, with the cursor in the middle."""
    cursor = (F.length("text") / 2).cast("int")
    return t.conversations.select("conv_id", "turn", tx.extract_context(F.col("text"), cursor).alias("c")).select(
        "conv_id", "turn", "c.*"
    )


_RAW = f"""WITH raw AS (SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, {_SENTENCE})) > 0
  THEN regexp_extract_all(text, {_SENTENCE}) ELSE list_filter(string_split(text, chr(10)), lambda x: {q.strip('x')} <> '') END AS r FROM conversations),
cur AS (SELECT *, {q.strip('coalesce(r[-1], CHR(0))')} AS c FROM raw)"""


@query(
    "editor_context",
    _RAW + f""" SELECT conv_id, turn, CASE WHEN {_NO_MARKS.replace('(s,', '(c,')} = '' THEN c ELSE {_NO_MARKS.replace('(s,', '(c,')} END AS current_sentence,
  CASE WHEN len(r) > 1 THEN {q.strip('r[-2]')} END AS previous_sentence, c AS paragraph FROM cur""",
)
def editor_context(t):
    """Context at the end of every turn, as the editor sends it."""
    return t.conversations.select("conv_id", "turn", tx.editor_context(F.col("text")).alias("c")).select(
        "conv_id", "turn", "c.current_sentence", "c.previous_sentence", "c.paragraph"
    )


@query(
    "paragraph_at_cursor",
    f"""WITH parts AS (SELECT doc_id, CAST(n_chars / 2 AS INT) AS cursor,
    regexp_split_to_array(text, '\\n{q.WS}*\\n') AS ps FROM documents),
flat AS (SELECT doc_id, cursor, unnest(ps) AS p, unnest(range(len(ps))) AS i, len(ps) AS n FROM parts),
ends AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) + 2 * i AS stop FROM flat),
hits AS (SELECT doc_id, n, min(CASE WHEN cursor <= stop THEN i END) AS hit FROM ends GROUP BY doc_id, n)
SELECT h.doc_id, md5({q.strip('e.p')}) AS paragraph FROM hits h JOIN ends e
  ON e.doc_id = h.doc_id AND e.i = coalesce(h.hit, h.n - 1)""",
)
def paragraph_at_cursor(t):
    cursor = F.expr("CAST(round(n_chars / 2) AS INT)")
    return t.documents.select("doc_id", F.md5(tx.paragraph_at_cursor(F.col("text"), cursor)).alias("paragraph"))


_CHUNK_SQL = f"""tokens AS (SELECT paper_id, full_text, {q.words('full_text')} AS ws FROM papers),
starts AS (SELECT paper_id, full_text, ws, unnest(range(0, len(ws), 200)) AS s FROM tokens),
chunks AS (SELECT paper_id, CAST(s / 200 AS INT) AS chunk_index, full_text,
  array_to_string(ws[s + 1 : s + 250], ' ') AS content, len(ws[s + 1 : s + 250]) AS word_count, ws[s + 1] AS first_word
  FROM starts)"""


@query(
    "chunk_text",
    f"""WITH {_CHUNK_SQL}, placed AS (SELECT *, CASE WHEN chunk_index = 0 THEN 0 ELSE instr(full_text, first_word) - 1 END AS start_char FROM chunks)
SELECT paper_id, chunk_index, md5(content) AS content, word_count, start_char, start_char + length(content) AS end_char FROM placed""",
    "papers",
)
def chunk_text(t):
    return co.chunk_papers(t.papers).select(
        "paper_id", "chunk_index", F.md5("content").alias("content"), "word_count", "start_char", "end_char"
    )


@query(
    "chunk_text_exact",
    f"""WITH {_CHUNK_SQL.replace('AS content,', 'AS content, array_to_string(ws[1 : s], chr(32)) AS ahead,')}, placed AS (
  SELECT *, CASE WHEN chunk_index = 0 THEN 0 ELSE length(ahead) + 1 END AS start_char FROM chunks)
SELECT paper_id, chunk_index, md5(content) AS content, word_count, start_char, start_char + length(content) AS end_char FROM placed""",
    "papers",
)
def chunk_text_exact(t):
    """Offsets are places in the single-spaced text, not first occurrences of a word."""
    return co.chunk_papers(t.papers, exact_offsets=True).select(
        "paper_id", "chunk_index", F.md5("content").alias("content"), "word_count", "start_char", "end_char"
    )


@query(
    "section_headings",
    """SELECT doc_id, len(lines) AS lines, len(list_filter(lines, lambda line: length(line) < 100 AND regexp_matches(lower(line),
  'introduction|abstract|method|result|discussion|conclusion|reference|background|related work'))) AS headings
FROM (SELECT doc_id, string_split(concat(text, chr(10), 'Related Work in ', lang), chr(10)) AS lines FROM documents)""",
)
def section_headings(t):
    """Headings among all lines of a text, and one more that is added to each."""
    from citespark.functions.chunking import is_section_heading

    lines = F.split(F.expr("concat(text, chr(10), 'Related Work in ', lang)"), "\n")
    found = F.filter(lines, is_section_heading)
    return t.documents.select("doc_id", F.size(lines).alias("lines"), F.size(found).alias("headings"))


@query(
    "carry_section",
    """SELECT paper_id, chunk_index, last_value(section_title IGNORE NULLS) OVER (
  PARTITION BY paper_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title
FROM (SELECT conv_id AS paper_id, turn AS chunk_index, CASE WHEN role = 'user' THEN text END AS section_title
      FROM conversations)""",
)
def carry_section(t):
    rows = t.conversations.selectExpr(
        "conv_id AS paper_id", "turn AS chunk_index", "CASE WHEN role = 'user' THEN text END AS section_title"
    )
    return co.carry_section(rows).select("paper_id", "chunk_index", "section_title")


@query(
    "replace_chunks",
    """SELECT paper_id, chunk_id, origin FROM (
  SELECT paper_id, chunk_id, 'old' AS origin FROM paper_chunks
    WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE processing_error IS NOT NULL)
  UNION ALL
  SELECT c.paper_id, c.chunk_id + 100000, 'new' FROM paper_chunks c
    JOIN papers p ON p.paper_id = c.paper_id WHERE p.processing_error IS NOT NULL AND c.chunk_index < 2)""",
    "papers paper_chunks",
)
def replace_chunks(t):
    redo = t.papers.filter("processing_error IS NOT NULL").select("paper_id")
    chunks = t.paper_chunks.select("paper_id", "chunk_id", "chunk_index")
    new = chunks.join(redo, "paper_id", "left_semi").filter("chunk_index < 2")
    return co.replace_chunks(
        chunks.selectExpr("paper_id", "chunk_id", "'old' AS origin"),
        new.selectExpr("paper_id", "chunk_id + 100000 AS chunk_id", "'new' AS origin"),
        redo,
    )


@query(
    "paper_chunk_listing",
    """SELECT p.paper_id, p.title, length(p.full_text) AS full_text_length, md5(substr(p.full_text, 1, 5000)) AS preview,
  coalesce(n.n, 0) AS chunk_count, c.chunk_id, c.chunk_index
FROM papers p LEFT JOIN paper_chunks c ON c.paper_id = p.paper_id
LEFT JOIN (SELECT paper_id, count(*) AS n FROM paper_chunks GROUP BY paper_id) n ON n.paper_id = p.paper_id""",
    "papers paper_chunks",
)
def paper_chunk_listing(t):
    return co.paper_chunk_listing(t.papers, t.paper_chunks).select(
        "paper_id", "title", "full_text_length", F.md5("full_text").alias("preview"), "chunk_count",
        "chunk_id", "chunk_index",
    )


@query(
    "chunks_per_paper",
    """SELECT p.paper_id, count(c.chunk_id) AS chunk_count, p.is_processed AND count(c.chunk_id) = 0 AS missing
FROM papers p LEFT JOIN paper_chunks c ON c.paper_id = p.paper_id GROUP BY p.paper_id, p.is_processed""",
    "papers paper_chunks",
)
def chunks_per_paper(t):
    return co.chunks_per_paper(t.papers, t.paper_chunks)


@query(
    "paper_embedding_text",
    """SELECT p.paper_id, md5(coalesce(nullif(CASE WHEN p.paper_id % 2 = 0 THEN '' ELSE p.abstract END, ''), c.content)) AS key
FROM papers p LEFT JOIN paper_chunks c ON c.paper_id = p.paper_id AND c.chunk_index = 0""",
    "papers paper_chunks",
)
def paper_embedding_text(t):
    papers = t.papers.selectExpr("paper_id", "CASE WHEN paper_id % 2 = 0 THEN '' ELSE abstract END AS abstract")
    return co.paper_embedding_text(papers, t.paper_chunks).select("paper_id", F.md5("embedding_text").alias("key"))


# text with identifiers woven in; the corpus itself holds none
_ID_TEXT = """CASE doc_id % 7
  WHEN 0 THEN concat(text, ' see arXiv:', CAST(2000 + doc_id % 600 AS STRING), '.', lpad(CAST(doc_id AS STRING), 5, '0'), 'v2 and PMID: ', CAST(doc_id AS STRING))
  WHEN 1 THEN concat('doi: 10.1234/ab-', CAST(doc_id AS STRING), '. ', text)
  WHEN 2 THEN concat(text, ' https://doi.org/10.48550/arXiv.2101.', lpad(CAST(doc_id AS STRING), 5, '0'), ' end')
  WHEN 3 THEN concat('No. 1234.5678 (10.5555/(x)', CAST(doc_id AS STRING), '_é1) ', text)
  WHEN 4 THEN concat(text, ' ARXIV 1999.', lpad(CAST(doc_id AS STRING), 4, '0'), ' in 1999 or 2019, 2031')
  WHEN 5 THEN concat(text, ' pmid 77', CAST(doc_id AS STRING), ' year 1949 1951')
  ELSE text END"""


def _duck_first(text: str, patterns: list[str]) -> str:
    tries = []
    for p in patterns:
        option = ", 'i'" if p.startswith("(?i)") else ""
        body = p.removeprefix("(?i)").replace("'", "''")
        tries.append(f"nullif(regexp_extract({text}, '{body}', 1{option}), '')")
    return "coalesce(" + ", ".join(tries) + ")" if len(tries) > 1 else tries[0]


@query(
    "extract_identifiers",
    f"""SELECT doc_id, {_duck_first('x', ids.ARXIV_PATTERNS)} AS arxiv_id, {_duck_first('x', ids.DOI_PATTERNS)} AS doi,
  {_duck_first('x', [ids.PMID_PATTERN])} AS pmid FROM (SELECT doc_id, {_ID_TEXT} AS x FROM documents)""",
)
def extract_identifiers(t):
    rows = t.documents.select("doc_id", F.expr(_ID_TEXT).alias("x"))
    return rows.select("doc_id", ids.extract_identifiers(F.col("x")).alias("i")).select("doc_id", "i.*")


@query(
    "merge_identifiers",
    f"""SELECT doc_id, coalesce({_duck_first('x', ids.ARXIV_PATTERNS)}, nullif(regexp_extract(title, '({ids.ARXIV_NUMBER})', 1), '')) AS arxiv_id,
  {_duck_first('x', ids.DOI_PATTERNS)} AS doi FROM (SELECT doc_id, {_ID_TEXT} AS x,
    concat('file_1905.', lpad(CAST(doc_id AS STRING), 5, '0'), '.pdf') AS title FROM documents)""",
)
def merge_identifiers(t):
    rows = t.documents.select(
        "doc_id", F.expr(_ID_TEXT).alias("x"),
        F.expr("concat('file_1905.', lpad(CAST(doc_id AS STRING), 5, '0'), '.pdf')").alias("title"),
    )
    merged = ids.merge_identifiers(ids.extract_identifiers(F.col("x")), ids.arxiv_in_title(F.col("title")))
    return rows.select("doc_id", merged.alias("i")).select("doc_id", "i.arxiv_id", "i.doi")


def _matches_sql(kind, pattern):
    """Matches of one pattern: a match starts after the pieces between earlier matches and those matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS type, vals[i] AS value, hits[i] AS full_match,
    CAST(list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda h: length(h))), 0) AS INT) AS position
  FROM (SELECT doc_id, regexp_extract_all(x, '{p}') AS hits, regexp_extract_all(x, '{p}', 1) AS vals,
    regexp_split_to_array(x, '{p}') AS gaps, unnest(range(1, len(regexp_extract_all(x, '{p}')) + 1)) AS i FROM texts)"""


@query(
    "find_all_identifiers",
    f"WITH texts AS (SELECT doc_id, {_ID_TEXT} AS x FROM documents)\n"
    + "\nUNION ALL ".join(_matches_sql(kind, p) for kind, p in ids.HIGHLIGHT_PATTERNS),
)
def find_all_identifiers(t):
    """Every match of every pattern with its offset in the whole text."""
    return ids.find_all_identifiers(t.documents.select("doc_id", F.expr(_ID_TEXT).alias("x")), "doc_id", "x")


@query(
    "arxiv_in_title",
    f"""SELECT doc_id, nullif(regexp_extract(concat('file_1905.', lpad(CAST(doc_id AS STRING), 4, '0'), 'v3.pdf'),
  '({ids.ARXIV_NUMBER})', 1), '') AS arxiv_id FROM documents""",
)
def arxiv_in_title(t):
    title = F.expr("concat('file_1905.', lpad(CAST(doc_id AS STRING), 4, '0'), 'v3.pdf')")
    return t.documents.select("doc_id", ids.arxiv_in_title(title).alias("arxiv_id"))


_RAW_ARXIV = """CASE doc_id % 4 WHEN 0 THEN concat('arXiv:2506.', lpad(CAST(doc_id AS STRING), 5, '0'), 'v1')
  WHEN 1 THEN concat(' arxiv: 2506.', CAST(doc_id AS STRING), ' ') WHEN 2 THEN concat('cs-ai/', lpad(CAST(doc_id AS STRING), 7, '0')) ELSE source END"""


@query(
    "clean_arxiv_id",
    f"""SELECT doc_id, c AS arxiv_id, regexp_matches(c, '{ids.ARXIV_VALID}') AS valid FROM (
  SELECT doc_id, {q.strip("replace(replace(r, 'arXiv:', ''), 'arxiv:', '')")} AS c
  FROM (SELECT doc_id, {_RAW_ARXIV} AS r FROM documents))""",
)
def clean_arxiv_id(t):
    cleaned = ids.clean_arxiv_id(F.expr(_RAW_ARXIV))
    return t.documents.select("doc_id", cleaned.alias("arxiv_id")).withColumn(
        "valid", ids.is_valid_arxiv_id(F.col("arxiv_id"))
    )


_RAW_DOI = """CASE doc_id % 4 WHEN 0 THEN concat('https://doi.org/10.1234/', source) WHEN 1 THEN concat('http://doi.org/10.1/', lang)
  WHEN 2 THEN concat('doi: 10.1234/', CAST(doc_id AS STRING), '  ') ELSE concat(' 10.9/', source) END"""


@query(
    "clean_doi",
    f"""SELECT doc_id, {q.strip("replace(replace(replace(r, 'https://doi.org/', ''), 'http://doi.org/', ''), 'doi:', '')")} AS doi
FROM (SELECT doc_id, {_RAW_DOI} AS r FROM documents)""",
)
def clean_doi(t):
    return t.documents.select("doc_id", ids.clean_doi(F.expr(_RAW_DOI)).alias("doi"))


@query(
    "latest_year",
    f"""SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(x, '{ids.YEAR_PATTERN}', 1),
  lambda y: CAST(y AS INT)), lambda y: y <= 2025)) AS year FROM (SELECT doc_id, {_ID_TEXT} AS x FROM documents)""",
)
def latest_year(t):
    return t.documents.select("doc_id", ids.latest_year(F.expr(_ID_TEXT)).alias("year"))


_DATES = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN concat('May ', CAST(year(o_orderdate) AS STRING)) ELSE 'n.d.' END AS d,
  concat(CAST(1990 + o_orderkey % 30 AS STRING), '-01-02') AS added FROM orders"""


@query(
    "item_year",
    f"""SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(coalesce(nullif(d, ''), added), '([0-9]{{4}})', 1), '') AS INT) AS year FROM ({_DATES})""",
)
def item_year(t):
    rows = t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN concat('May ', CAST(year(o_orderdate) AS STRING)) ELSE 'n.d.' END AS d",
        "concat(CAST(1990 + o_orderkey % 30 AS STRING), '-01-02') AS added",
    )
    return rows.select("o_orderkey", ids.item_year(F.col("d"), F.col("added")).alias("year"))


def _letters(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z]', '', 'g')"


_KEY_STOPS = ", ".join(f"'{w}'" for w in cf.KEY_STOP_WORDS)
_EDITOR_STOPS = ", ".join(f"'{w}'" for w in cf.EDITOR_STOP_WORDS)
_KEY_SQL = (
    f"concat(coalesce({_letters(q.words('authors[1]') + '[-1]')}, 'Unknown'), "
    "coalesce(CAST(nullif(year, 0) AS VARCHAR), '0000'), coalesce("
    + _letters(f"list_filter({q.words('title')}, lambda w: lower(w) NOT IN ({_KEY_STOPS}) AND {_letters('w')} <> '')[1]")
    + ", ''))"
)
_EDITOR_WORD = f"regexp_replace(list_filter(string_split(coalesce(title, ''), ' '), lambda w: lower(w) NOT IN ({_EDITOR_STOPS}))[1], '[^a-zA-Z0-9]', '', 'g')"


@query("citation_key", f"SELECT paper_id, {_KEY_SQL} AS key FROM papers", "papers")
def citation_key(t):
    key = cf.citation_key(F.col("authors"), F.col("year"), F.col("title"))
    return t.papers.select("paper_id", key.alias("key"))


@query(
    "citation_key_editor",
    f"""SELECT paper_id, CASE WHEN k = 'Unknownnd' OR length(k) < 5 THEN concat('Paper_', substr(CAST(paper_id AS VARCHAR), 1, 8)) ELSE k END AS key
FROM (SELECT paper_id, concat(coalesce({_letters("string_split(trim(authors[1]), ' ')[-1]")}, 'Unknown'),
    coalesce(CAST(nullif(year, 0) AS VARCHAR), 'nd'), upper(substr(w, 1, 1)), lower(substr(w, 2))) AS k
  FROM (SELECT *, coalesce({_EDITOR_WORD}, '') AS w FROM papers))""",
    "papers",
)
def citation_key_editor(t):
    key = cf.citation_key_editor(F.col("authors"), F.col("year"), F.col("title"), F.col("paper_id"))
    return t.papers.select("paper_id", key.alias("key"))


_TYPE_SQL = (
    "CASE WHEN coalesce(arxiv_id, '') <> '' OR coalesce(lower(journal) IN ('arxiv', 'biorxiv', 'medrxiv'), false) "
    "THEN 'misc' ELSE 'article' END"
)


def _f(name: str, value: str) -> str:
    return f"'  {name} = {{' || nullif(CAST({value} AS VARCHAR), '') || '}}'"


ENTRY_SQL = (
    f"concat('@', {_TYPE_SQL}, '{{', {_KEY_SQL}, ',', chr(10), concat_ws(',' || chr(10), "
    "'  title = {' || coalesce(title, '') || '}', "
    + _f("author", "array_to_string(authors, ' and ')") + ", "
    + _f("year", "nullif(year, 0)") + ", "
    + f"CASE WHEN {_TYPE_SQL} = 'article' THEN {_f('journal', 'journal')} ELSE {_f('howpublished', 'journal')} END, "
    + _f("doi", "doi") + ", " + _f("eprint", "arxiv_id") + ", "
    + "CASE WHEN coalesce(arxiv_id, '') <> '' THEN '  archivePrefix = {arXiv}' END, "
    + _f("pmid", "pubmed_id") + ", " + _f("url", "source_url") + ", "
    + _f("abstract", "replace(replace(abstract, chr(10), ' '), '\"', '''''')")
    + "), chr(10), '}', chr(10))"
)


@query("bibtex_entry", f"SELECT paper_id, md5({ENTRY_SQL}) AS entry FROM papers", "papers")
def bibtex_entry(t):
    return t.papers.select("paper_id", F.md5(cf.bibtex_of()).alias("entry"))


@query("bibtex_entry_text", f"SELECT paper_id, {ENTRY_SQL} AS entry FROM bib_papers", "bib_papers")
def bibtex_entry_text(t):
    return t.bib_papers.select("paper_id", cf.bibtex_of().alias("entry"))


def latex_sql(x: str) -> str:
    for a, b in cf.LATEX_REPLACEMENTS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_LATEX_IN = "concat(text, ' 5% of $x_1 & {a}^2 ~ # \\', source)"
_LATEX_IN_SPARK = "concat(text, ' 5% of $x_1 & {a}^2 ~ # ', chr(92), source)"


@query("escape_latex", f"SELECT doc_id, md5({latex_sql(_LATEX_IN)}) AS escaped FROM documents")
def escape_latex(t):
    return t.documents.select("doc_id", F.md5(cf.escape_latex(F.expr(_LATEX_IN_SPARK))).alias("escaped"))


@query(
    "split_names",
    f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(
  concat(' ', source, '; ', lang, ',, ', text, ' ;'), '[,;]'), lambda s: {q.strip('s')}), lambda s: s <> ''), '|')) AS names
FROM documents""",
)
def split_names(t):
    value = F.expr("concat(' ', source, '; ', lang, ',, ', text, ' ;')")
    return t.documents.select("doc_id", F.md5(F.array_join(tx.split_names(value), "|")).alias("names"))


@query("text_keys", "SELECT doc_id, md5(text) AS md5_key, sha256(text) AS sha_key FROM documents")
def text_keys(t):
    return t.documents.select(
        "doc_id", tx.text_key(F.col("text")).alias("md5_key"), F.sha2("text", 256).alias("sha_key")
    )


@query(
    "word_char_counts",
    f"SELECT doc_id, len({q.words('text')}) AS words, length(text) AS chars FROM documents",
)
def word_char_counts(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id", tx.word_count(c).cast("long").alias("words"), tx.char_count(c).cast("long").alias("chars")
    )


@query("heuristic_metadata")
def heuristic_metadata(t):
    """Title, authors, abstract and year guessed from every document (tested on fixtures)."""
    return t.documents.select("doc_id", hx.extract_metadata(F.col("text")).alias("m")).select(
        "doc_id", "m.title", "m.authors", "m.abstract", "m.year"
    )


_EMBED_SQL = f"""WITH texts AS (SELECT DISTINCT md5(text) AS text_key, text FROM conversations),
toks AS (SELECT text_key, unnest({q.words('lower(text)')}) AS w FROM texts),
counts AS (SELECT text_key, CAST(concat('0x', substr(md5(w), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM toks GROUP BY 1, 2),
norms AS (SELECT text_key, sqrt(sum(n * n)::DOUBLE) AS len FROM counts GROUP BY 1),
weights AS (SELECT text_key, bucket, round((n / len)::FLOAT::DOUBLE, 5) AS weight FROM counts JOIN norms USING (text_key))"""


@query(
    "embed_distinct_texts",
    _EMBED_SQL + """ SELECT c.conv_id, c.turn, w.bucket, w.weight
FROM conversations c JOIN weights w ON w.text_key = md5(c.text)""",
)
def embed_distinct_texts(t):
    """Each distinct text is embedded once; the rest of the vector is zero."""
    cache = em.embed_with_cache(
        t.conversations.filter("role = 'user'"), "text", em.hashed_embedder(64)
    )[1]
    rows, _ = em.embed_with_cache(t.conversations, "text", em.hashed_embedder(64), cache)
    flat = rows.select("conv_id", "turn", F.posexplode("embedding").alias("b", "v")).filter("v <> 0")
    return flat.select(
        "conv_id", "turn", F.col("b").cast("long").alias("bucket"),
        F.round(F.col("v").cast("double"), 5).alias("weight"),
    )
