"""Similarity joins, scoring and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from citespark.functions import scoring, vectors
from citespark.functions.citations import display_text
from citespark.operators import pq_index, ranking, similarity
from citespark.plans import suggest as sg
from suite import sqltext as q
from suite.registry import query

AS_OF_YEAR = 2025
MIN_SIM = 0.2
MIN_REL = 0.4

# requests: every vector is a request, its context comes from the document of the same id
_REQUESTS_SQL = """requests AS (
  SELECT e.vec_id AS query_id, e.embedding, split_part(d.text, chr(10), 1) AS previous_sentence,
         split_part(d.text, chr(10), 2) AS paragraph
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""


def requests(t):
    docs = t.documents.selectExpr(
        "doc_id AS query_id",
        "split_part(text, chr(10), 1) AS previous_sentence",
        "split_part(text, chr(10), 2) AS paragraph",
    )
    return t.embeddings.selectExpr("vec_id AS query_id", "embedding").join(docs, "query_id", "left")


_PAIRS = f"""pairs AS (
  SELECT r.query_id, c.chunk_id, c.paper_id, c.content, c.chunk_index, c.section_title,
         p.title, p.authors, p.year, p.abstract, p.citation_count, r.previous_sentence, r.paragraph,
         {q.cosine('r.embedding', 'c.embedding')} AS similarity
  FROM requests r, paper_chunks c JOIN papers p ON p.paper_id = c.paper_id
  WHERE p.is_processed)"""


def _best(k: int, min_sim: float, extra: str = "") -> str:
    return f"""best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
                 FROM pairs WHERE similarity > {min_sim}{extra})
  WHERE rank <= {k})"""


_SCORED = f"""scored AS (
  SELECT *, {q.relevance('similarity', 'context_score', 'quality_score', 'recency_score')} AS relevance
  FROM (SELECT *, {q.context_score('previous_sentence', 'paragraph', 'title', 'abstract')} AS context_score,
               {q.quality_score('citation_count')} AS quality_score,
               {q.recency_score('year', AS_OF_YEAR)} AS recency_score FROM best))"""


def _final(max_chunks: int, top: int, min_rel: float) -> str:
    return f"""capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY similarity DESC, chunk_id) AS nth
                 FROM scored WHERE relevance > {min_rel}) WHERE nth <= {max_chunks}),
final AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, similarity DESC, chunk_id) AS position
                 FROM capped) WHERE position <= {top})"""


_SUGGESTION_COLUMNS = f"""SELECT query_id, position, paper_id, chunk_id, round(relevance, 6) AS confidence,
  {q.display_text('authors', 'year')} AS display_text,
  CASE WHEN length(content) > 200 THEN concat(substr(content, 1, 200), '...') ELSE content END AS chunk_text,
  chunk_index, section_title FROM final"""


def _suggest_sql(k, min_sim, max_chunks, top, min_rel, extra=""):
    return (
        f"WITH {_REQUESTS_SQL},\n{_PAIRS},\n{_best(k, min_sim, extra)},\n{_SCORED},\n"
        f"{_final(max_chunks, top, min_rel)}\n{_SUGGESTION_COLUMNS}"
    )


def _suggestion_columns(df):
    return df.select(
        "query_id", "position", "paper_id", "chunk_id", F.round("confidence", 6).alias("confidence"),
        "display_text", "chunk_text", "chunk_index", "section_title",
    )


@query("suggest_topk", _suggest_sql(30, MIN_SIM, 2, 10, MIN_REL), "papers paper_chunks")
def suggest_topk(t):
    return _suggestion_columns(
        sg.suggest(
            requests(t), t.paper_chunks, t.papers, as_of_year=AS_OF_YEAR, min_similarity=MIN_SIM,
            min_relevance=MIN_REL,
        )
    )


@query(
    "suggest_filtered",
    _suggest_sql(30, MIN_SIM, 2, 10, MIN_REL, " AND year >= 1995 AND year <= 2020 AND citation_count >= 20"),
    "papers paper_chunks",
)
def suggest_filtered(t):
    return _suggestion_columns(
        sg.suggest(
            requests(t), t.paper_chunks, t.papers, as_of_year=AS_OF_YEAR, min_similarity=MIN_SIM,
            min_relevance=MIN_REL, year_from=1995, year_to=2020, min_citations=20,
        )
    )


@query("suggest_batch", _suggest_sql(10, MIN_SIM, 2, 5, MIN_REL), "papers paper_chunks")
def suggest_batch(t):
    return _suggestion_columns(
        sg.suggest_batch(
            requests(t), t.paper_chunks, t.papers, as_of_year=AS_OF_YEAR, min_similarity=MIN_SIM,
            min_relevance=MIN_REL,
        )
    )


_ALL_PAIRS = f"""WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {q.cosine('a.embedding', 'b.embedding')} AS similarity
  FROM embeddings a, embeddings b)"""


def _join(t, **options):
    left = t.embeddings.selectExpr("vec_id AS query_id", "embedding")
    right = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding")
    found = similarity.similarity_join(left, right, **options)
    return found.withColumn("similarity", F.round("similarity", 6))


_TOP30 = f"""{_ALL_PAIRS}
SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM pairs WHERE similarity > {MIN_SIM}) WHERE rank <= 30"""


@query("similarity_join", _TOP30)
def similarity_join(t):
    return _join(t, k=30, min_similarity=MIN_SIM)


@query("similarity_join_blocks", _TOP30)
def similarity_join_blocks(t):
    """The form for query tables beyond the broadcast bound."""
    return _join(
        t, k=30, min_similarity=MIN_SIM, broadcast_queries=0, n_cells=8, block_rows=500, query_block_rows=700
    )


@query(
    "paper_neighbours",
    f"""{_ALL_PAIRS}
SELECT query_id AS paper_id, chunk_id AS neighbour_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM pairs WHERE similarity > {MIN_SIM} AND query_id <> chunk_id) WHERE rank <= 5""",
)
def paper_neighbours(t):
    table = t.embeddings.selectExpr("vec_id AS paper_id", "embedding")
    found = similarity.paper_neighbours(table, table, min_similarity=MIN_SIM)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "search_sources",
    f"""{_ALL_PAIRS}, sided AS (SELECT p.*, e.label % 2 AS side FROM pairs p JOIN embeddings e ON e.vec_id = p.chunk_id)
SELECT query_id, chunk_id, round(similarity, 6) AS similarity, CASE side WHEN 0 THEN 'local' ELSE 'shared' END AS source
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY similarity DESC, chunk_id) AS rank
      FROM sided WHERE similarity > {MIN_SIM}) WHERE rank <= 5""",
)
def search_sources(t):
    chunks = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding", "label")
    return similarity.search_sources(
        t.embeddings.selectExpr("vec_id AS query_id", "embedding"),
        {"local": chunks.filter("label % 2 = 0"), "shared": chunks.filter("label % 2 = 1")},
        min_similarity=MIN_SIM,
    ).withColumn("similarity", F.round("similarity", 6))


@query("similarity_join_ivf")
def similarity_join_ivf(t):
    """Recall of the cell index against the exact join (approximate: no SQL twin)."""
    chunks = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding")
    queries = t.embeddings.selectExpr("vec_id AS query_id", "embedding")
    centres = similarity.train_centres(chunks, "embedding", 8)
    indexed = similarity.assign_cells(chunks, "chunk_id", "embedding", centres)
    index = similarity.build_cell_index(indexed, centres)
    near = similarity.similarity_join_ivf(
        queries, indexed, index, k=10, min_similarity=MIN_SIM, n_probe=4
    )
    exact = similarity.similarity_join(queries, chunks, k=10, min_similarity=MIN_SIM)
    return similarity.recall(exact, near, ["query_id", "chunk_id"])


_RECALL = """SELECT count(*) AS expected, true AS recall_reached FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM pairs
  WHERE similarity > {least}) WHERE rank <= 10"""


def _index_recall(t, entries, vectors, model, n_probe):
    """How many rows the exact join has, and whether the index finds nine tenths of them.

    The table's vectors have no clusters, so most cells have to be met; what is
    saved there is that 16 bytes are read of each and vectors of ``rerank`` rows only.
    """
    queries = t.embeddings.selectExpr("vec_id AS query_id", "embedding")
    near = pq_index.search(queries, entries, vectors, model, k=10, min_similarity=MIN_SIM, n_probe=n_probe, rerank=200)
    exact = similarity.similarity_join(queries, vectors, k=10, min_similarity=MIN_SIM)
    found = similarity.recall(exact, near, ["query_id", "chunk_id"])
    return found.select("expected", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("pq_index_search", f"{_ALL_PAIRS} {_RECALL.format(least=MIN_SIM)}")
def pq_index_search(t):
    vectors = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding")
    model = pq_index.train(vectors, n_cells=16)
    return _index_recall(t, pq_index.encode(vectors, model), vectors, model, 13)


_CHANGED = f"""WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {q.cosine('a.embedding', 'b.embedding')} AS similarity
  FROM embeddings a, embeddings b WHERE b.vec_id % 7 <> 3)"""


@query("pq_index_updates", f"{_CHANGED} {_RECALL.format(least=MIN_SIM)}")
def pq_index_updates(t):
    """Fitted on two thirds of the rows; the others are inserted, every seventh is deleted, large cells are split."""
    vectors = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding")
    early, late = vectors.filter("chunk_id % 3 != 0"), vectors.filter("chunk_id % 3 = 0")
    model = pq_index.train(early, n_cells=12)
    entries = pq_index.encode(early, model).unionByName(pq_index.encode(late, model, 1))
    entries = entries.unionByName(pq_index.deletions(vectors.filter("chunk_id % 7 = 3"), 2))
    kept = vectors.filter("chunk_id % 7 != 3")
    bound = pq_index.live(entries).groupBy("cell").count().agg(F.max("count")).first()[0] - 1
    added, model = pq_index.split_cells(entries, kept, model, bound, 3)
    return _index_recall(t, entries.unionByName(added), kept, model, 11)


@query(
    "pq_index_entries",
    "SELECT vec_id AS key, vec_id % 3 = 0 AS inserted, 16 AS bytes FROM embeddings WHERE vec_id % 7 <> 3",
)
def pq_index_entries(t):
    """The live entries after inserts and deletions, and what each keeps of its vector."""
    vectors = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding")
    early, late = vectors.filter("chunk_id % 3 != 0"), vectors.filter("chunk_id % 3 = 0")
    model = pq_index.train(early, n_cells=12)
    entries = pq_index.encode(early, model).unionByName(pq_index.encode(late, model, 1))
    now = pq_index.live(entries.unionByName(pq_index.deletions(vectors.filter("chunk_id % 7 = 3"), 2)))
    return now.select("key", (F.col("version") == 1).alias("inserted"), F.octet_length("codes").alias("bytes"))


@query("similarity_join_lsh")
def similarity_join_lsh(t):
    chunks = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding")
    queries = t.embeddings.selectExpr("vec_id AS query_id", "embedding")
    near = similarity.similarity_join_lsh(queries, chunks, k=10, min_similarity=MIN_SIM)
    exact = similarity.similarity_join(queries, chunks, k=10, min_similarity=MIN_SIM)
    return similarity.recall(exact, near, ["query_id", "chunk_id"])


@query(
    "cosine_of_pairs",
    f"""SELECT d.vec_id AS left_id, e.vec_id AS right_id,
  round({q.cosine('d.embedding', 'e.embedding')}, 6) AS similarity
FROM embeddings d JOIN embeddings e ON e.vec_id = d.vec_id + 1""",
)
def cosine_of_pairs(t):
    a = t.embeddings.selectExpr("vec_id AS left_id", "embedding AS a", "vec_id + 1 AS right_id")
    b = t.embeddings.selectExpr("vec_id AS right_id", "embedding AS b")
    return a.join(b, "right_id").select(
        "left_id", "right_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity")
    )


@query(
    "vector_dimension_check",
    """SELECT count(*) FILTER (WHERE len(embedding) = 64) AS accepted,
  count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS rejected FROM embeddings""",
)
def vector_dimension_check(t):
    fit, rejects = vectors.split_by_dimension(t.embeddings.select("embedding"), "embedding", 64)
    both = fit.select(F.lit(True).alias("fits")).unionByName(rejects.select(F.col("reason").isNull().alias("fits")))
    return both.agg(F.count_if("fits").alias("accepted"), F.count_if(~F.col("fits")).alias("rejected"))


@query(
    "chunks_with_papers",
    """SELECT c.chunk_id, c.paper_id, p.title, p.year FROM paper_chunks c
JOIN papers p ON p.paper_id = c.paper_id WHERE p.is_processed""",
    "papers paper_chunks",
)
def chunks_with_papers(t):
    papers = sg.searchable_papers(t.papers).select("paper_id", "title", "year")
    return t.paper_chunks.select("chunk_id", "paper_id").join(papers, "paper_id")


@query(
    "year_range_filter",
    "SELECT paper_id, year FROM papers WHERE is_processed AND year >= 2000 AND year <= 2010",
    "papers",
)
def year_range_filter(t):
    return sg.searchable_papers(t.papers, 2000, 2010).select("paper_id", "year")


_ABOVE = f"""{_ALL_PAIRS} SELECT query_id, count(*) AS above FROM pairs
WHERE similarity > {MIN_SIM} AND query_id <> chunk_id GROUP BY query_id"""


def _above(t, **physical):
    left = t.embeddings.selectExpr("vec_id AS query_id", "vec_id AS own", "embedding")
    right = t.embeddings.selectExpr("vec_id AS chunk_id", "vec_id AS own", "embedding")
    return similarity.count_above(left, right, min_similarity=MIN_SIM, exclude="own", **physical)


@query("similarity_threshold", _ABOVE)
def similarity_threshold(t):
    """Rows above the threshold per request, counted where the products are formed; no row limit applies."""
    return _above(t)


@query("similarity_threshold_blocks", _ABOVE)
def similarity_threshold_blocks(t):
    return _above(t, broadcast_queries=0, n_cells=8, block_rows=500, query_block_rows=700)


# every document is scored for the request formed by the next document
_SCORE_BASE = """pairs AS (
  SELECT a.paper_id, a.title, a.abstract, a.year, a.citation_count,
         split_part(b.abstract, chr(10), 1) AS previous_sentence, split_part(b.abstract, chr(10), 2) AS paragraph
  FROM papers a JOIN papers b ON b.paper_id = a.paper_id + 1)"""


def _score_base(t):
    nxt = t.papers.selectExpr(
        "paper_id - 1 AS paper_id",
        "split_part(abstract, chr(10), 1) AS previous_sentence",
        "split_part(abstract, chr(10), 2) AS paragraph",
    )
    return t.papers.select("paper_id", "title", "abstract", "year", "citation_count").join(nxt, "paper_id")


@query(
    "context_score",
    f"""WITH {_SCORE_BASE} SELECT paper_id,
  round({q.context_score('previous_sentence', 'paragraph', 'title', 'abstract')}, 6) AS score FROM pairs""",
    "papers",
)
def context_score(t):
    c = [F.col(x) for x in ("previous_sentence", "paragraph", "title", "abstract")]
    return _score_base(t).select("paper_id", F.round(scoring.context_score(*c), 6).alias("score"))


@query(
    "token_overlap",
    f"""WITH {_SCORE_BASE} SELECT paper_id,
  {q.overlap(q.words('lower(previous_sentence)'), q.words('lower(title)'))} AS shared FROM pairs""",
    "papers",
)
def token_overlap(t):
    from citespark.functions.text import words

    shared = scoring.overlap(words(F.lower("previous_sentence")), words(F.lower("title")))
    return _score_base(t).select("paper_id", shared.cast("long").alias("shared"))


@query(
    "quality_score",
    f"SELECT paper_id, round({q.quality_score('citation_count')}, 6) AS score FROM papers",
    "papers",
)
def quality_score(t):
    return t.papers.select("paper_id", F.round(scoring.quality_score(F.col("citation_count")), 6).alias("score"))


@query(
    "recency_score",
    f"SELECT paper_id, round({q.recency_score('year', AS_OF_YEAR)}, 6) AS score FROM papers",
    "papers",
)
def recency_score(t):
    return t.papers.select("paper_id", F.round(scoring.recency_score(F.col("year"), AS_OF_YEAR), 6).alias("score"))


_SIM = "(0.3::DOUBLE + (paper_id % 60) * 0.01::DOUBLE)"
_REL_SQL = f"""WITH {_SCORE_BASE}, scored AS (
  SELECT *, {q.context_score('previous_sentence', 'paragraph', 'title', 'abstract')} AS context_score,
         {q.quality_score('citation_count')} AS quality_score, {q.recency_score('year', AS_OF_YEAR)} AS recency_score,
         {_SIM} AS similarity FROM pairs),
rel AS (SELECT *, {q.relevance('similarity', 'context_score', 'quality_score', 'recency_score')} AS relevance FROM scored)"""


def _scored(t):
    base = _score_base(t).withColumn("similarity", F.expr("0.3D + (paper_id % 60) * 0.01D"))
    return ranking.score_candidates(base, AS_OF_YEAR)


@query(
    "relevance",
    _REL_SQL + """ SELECT paper_id, round(relevance, 6) AS relevance, CASE WHEN relevance > 0.85 THEN 'high'
  WHEN relevance > 0.7 THEN 'medium' WHEN relevance > 0.5 THEN 'low' END AS band FROM rel""",
    "papers",
)
def relevance(t):
    return _scored(t).select("paper_id", F.round("relevance", 6).alias("relevance"), "band")


@query(
    "relevance_filter",
    _REL_SQL + " SELECT paper_id FROM rel WHERE relevance > 0.5",
    "papers",
)
def relevance_filter(t):
    return ranking.relevant(_scored(t)).select("paper_id")


@query(
    "relevance_breakdown",
    _REL_SQL + """ SELECT paper_id, round(similarity, 6) AS similarity, round(context_score, 6) AS context,
  round(quality_score, 6) AS quality, round(recency_score, 6) AS recency FROM rel""",
    "papers",
)
def relevance_breakdown(t):
    parts = scoring.breakdown(
        F.col("similarity"), F.col("context_score"), F.col("quality_score"), F.col("recency_score")
    )
    out = _scored(t).select("paper_id", parts.alias("b")).select("paper_id", "b.*")
    return out.select("paper_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_CANDS = f"""cands AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.vec_id % 100 AS paper_id,
         {q.cosine('a.embedding', 'b.embedding')} AS similarity
  FROM embeddings a, embeddings b)"""


@query(
    "cap_per_paper",
    f"""WITH {_CANDS}, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
                 FROM cands WHERE similarity > 0.1) WHERE rank <= 30)
SELECT query_id, paper_id, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY similarity DESC, chunk_id) AS nth FROM best)
WHERE nth <= 1""",
)
def cap_per_paper(t):
    left = t.embeddings.selectExpr("vec_id AS query_id", "embedding")
    right = t.embeddings.selectExpr("vec_id AS chunk_id", "embedding")
    best = similarity.similarity_join(left, right, k=30, min_similarity=0.1)
    best = best.withColumn("paper_id", F.expr("chunk_id % 100"))
    return ranking.cap_per_paper(best, 1).select("query_id", "paper_id", "chunk_id")


@query(
    "final_order",
    _REL_SQL + """ SELECT query_id, paper_id, position FROM (
  SELECT citation_count % 10 AS query_id, paper_id,
         row_number() OVER (PARTITION BY citation_count % 10 ORDER BY relevance DESC, similarity DESC, paper_id) AS position
  FROM rel) WHERE position <= 10""",
    "papers",
)
def final_order(t):
    rows = _scored(t).withColumn("query_id", F.expr("citation_count % 10"))
    return ranking.final_order(rows, 10, "query_id", "paper_id").select("query_id", "paper_id", "position")


@query(
    "display_text",
    f"SELECT paper_id, {q.display_text('authors', 'year')} AS display_text FROM papers",
    "papers",
)
def display_texts(t):
    return t.papers.select("paper_id", display_text(F.col("authors"), F.col("year")).alias("display_text"))


@query(
    "chunk_snippet",
    """SELECT chunk_id, CASE WHEN length(content) > 200 THEN concat(substr(content, 1, 200), '...') ELSE content END
  AS chunk_text FROM paper_chunks""",
    "paper_chunks",
)
def chunk_snippet(t):
    return t.paper_chunks.select("chunk_id", ranking.snippet().alias("chunk_text"))
