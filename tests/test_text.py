"""Literal text cases."""

import pytest
from pyspark.sql import functions as F

from citespark.functions import chunking, text as tx
from citespark.operators import chunks as co
from citespark.operators import embedding as em


def one(spark, expr, **values):
    row = [tuple(values.values())]
    types = {int: "int", str: "string", float: "double"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame(row, schema).select(expr.alias("x")).collect()[0].x


def test_sentences(spark):
    got = one(spark, tx.sentences(F.col("t")), t="First sentence. Second sentence! Third sentence?")
    assert got == ["First sentence.", "Second sentence!", "Third sentence?"]


@pytest.mark.parametrize("text,want", [
    ("...", ["..."]), ("", []), ("one\ntwo. three", ["one", "two.", "three"]), ("a\n\n...\nb", ["a", "b"]),
])
def test_sentence_fallback(spark, text, want):
    assert one(spark, tx.sentences(F.col("t")), t=text) == want


CONTEXT = "This is the first sentence. This is the second sentence. This is the third sentence."


def test_context_at_cursor(spark):
    c = one(spark, tx.extract_context(F.col("t"), F.lit(30)), t=CONTEXT)
    assert c.current_sentence == "This is the second sentence."
    assert c.previous_sentence == "This is the first sentence."
    assert c.next_sentence == "This is the third sentence."
    assert c.paragraph == CONTEXT
    assert c.position == 30


def test_context_at_end_and_start(spark):
    c = one(spark, tx.extract_context(F.col("t")), t=CONTEXT)
    assert c.current_sentence == "This is the third sentence."
    assert c.next_sentence is None
    c = one(spark, tx.extract_context(F.col("t"), F.lit(0)), t=CONTEXT)
    assert c.current_sentence == "This is the first sentence."
    assert c.previous_sentence is None
    assert one(spark, tx.extract_context(F.col("t")), t="short").current_sentence == ""


def test_context_skips_sentences_changed_by_cleaning(spark):
    text = "Strange  @@ spacing in here. The second sentence is plain."
    c = one(spark, tx.extract_context(F.col("t"), F.lit(3)), t=text)
    assert c.current_sentence == "The second sentence is plain."


def test_editor_context(spark):
    c = one(spark, tx.editor_context(F.col("t"), F.lit(25)), t="This is sentence one. This is sentence two. This is sentence three.")
    assert (c.previous_sentence, c.current_sentence, c.next_sentence) == (
        "This is sentence one.", "This is sentence two", "This is sentence three.",
    )
    assert c.paragraph == "This is sentence two."
    c = one(spark, tx.editor_context(F.col("t"), F.lit(999)), t="One here. Two here.")
    assert (c.previous_sentence, c.current_sentence, c.next_sentence) == ("One here.", "Two here", None)


@pytest.mark.parametrize("text,cursor,want", [
    ("a b\n\nc d\n \ne", 0, "a b"), ("a b\n\nc d\n \ne", 6, "c d"), ("a b\n\nc d\n \ne", 99, "e"), ("x", 1, "x"),
])
def test_paragraph(spark, text, cursor, want):
    assert one(spark, tx.paragraph_at_cursor(F.col("t"), F.lit(cursor)), t=text) == want


@pytest.mark.parametrize("text,want", [
    ("  multiple   spaces  ", "multiple spaces"), ("test@#$%text", "testtext"),
    ("This   has    extra   spaces... And multiple dots....", "This has extra spaces. And multiple dots."),
    ("Größe: ça va ?", "Größe: ça va?"), ("a b", "a b"),
])
def test_preprocess(spark, text, want):
    assert one(spark, tx.preprocess_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("old,new,want", [
    ("test", "test", False), ("test", "test.", False), ("old text", "completely new text", True),
    ("short", "this is a much longer text now", True), ("Machine learning is great", "Machine learning is great!", False),
    ("Machine learning is great", "Deep learning is even better", True), ("", "0123456789", False), ("", "0123456789a", True),
])
def test_should_update(spark, old, new, want):
    assert one(spark, tx.should_update(F.col("o"), F.col("n")), o=old, n=new) is want


@pytest.mark.parametrize("n,chunks", [(0, 0), (1, 1), (50, 1), (200, 1), (201, 2), (250, 2), (251, 2), (450, 3)])
def test_chunk_counts(spark, n, chunks):
    text = " ".join(f"w{i}" for i in range(n))
    got = one(spark, chunking.chunk_records(F.col("t")), t=text)
    assert len(got) == chunks
    rebuilt = [w for r in got for w in r.content.split()[: 200 if r is not got[-1] else None]]
    assert " ".join(rebuilt) == text


def test_chunk_offsets_and_sections(spark):
    text = "Introduction of it  the end the result x y"
    df = spark.createDataFrame([(1, text)], "paper_id int, full_text string")
    rows = co.chunk_papers(df, size=3, overlap=1).orderBy("chunk_index").collect()
    assert [r.content for r in rows] == ["Introduction of it", "it the end", "end the result", "result x y", "y"]
    assert [r.start_char for r in rows] == [0, text.find("it"), text.find("end"), text.find("result"), text.find("y")]
    assert [r.section_title for r in rows] == [
        "Introduction of it", "Introduction of it", "end the result", "result x y", "result x y",
    ]
    plain = " ".join(text.split())
    exact = co.chunk_papers(df, size=3, overlap=1, exact_offsets=True).collect()
    assert all(plain[r.start_char : r.end_char] == r.content for r in exact)


def test_embedding_cache(spark):
    calls = spark.sparkContext.accumulator(0)
    inner = em.hashed_embedder(16)

    def counting(texts):
        calls.add(len(texts))
        return inner(texts)

    df = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(20)], "id int, t string")
    out, fresh = em.embed_with_cache(df, "t", counting)
    rows = out.collect()
    assert len(rows) == 20 and all(len(r.embedding) == 16 for r in rows)
    assert calls.value == 11
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert em.embed_with_cache(df, "t", counting, cache)[1].count() == 0
    assert em.embed_with_cache(df.limit(0), "t", counting)[0].count() == 0


def test_unit_vectors(spark):
    df = spark.createDataFrame([("Größe und Maß",), ("",)], "t string")
    out = em.embed_texts(df, "t", em.hashed_embedder(32)).collect()
    assert abs(sum(x * x for x in out[0].embedding) - 1) < 1e-6
    assert sum(out[1].embedding) == 0
