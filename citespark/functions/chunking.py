"""Overlapping word chunks of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citespark.functions.text import bind, words

CHUNK_WORDS = 250
OVERLAP_WORDS = 50
# Words that mark a short chunk as a section heading.
SECTION_WORDS = [
    "introduction", "abstract", "method", "result", "discussion",
    "conclusion", "reference", "background", "related work",
]
SECTION_MAX_CHARS = 100


def word_chunks(text: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Array of word arrays; every ``size - overlap`` words a chunk starts."""
    return bind(words(text), lambda tokens: chunks_of(tokens, size, overlap))


def chunks_of(tokens: Column, size: int, overlap: int) -> Column:
    starts = F.when(
        F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size - overlap))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))


def exact_starts(tokens: Column, step: int) -> Column:
    """Where every ``step``-th token starts in the single-spaced text: each token is measured once, then steps are summed."""
    widths = F.transform(
        chunks_of(tokens, step, 0),
        lambda part: F.aggregate(part, F.lit(0), lambda n, w: n + F.length(w) + 1),
    )
    return F.aggregate(
        widths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
        lambda s: s["starts"],
    )


def is_section_heading(content: Column) -> Column:
    """A short chunk that holds one of the section words."""
    return (F.length(content) < SECTION_MAX_CHARS) & F.lower(content).rlike("|".join(SECTION_WORDS))


def chunk_records(
    text: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, exact_offsets: bool = False
) -> Column:
    """Chunks of a text as an array of records.

    Offsets follow the first occurrence of a chunk's first word anywhere in the
    text; with ``exact_offsets`` they are positions in the single-spaced text.
    A heading seen in a short chunk is carried to the chunks after it.
    """

    def start_of(chunk: Column, i: Column, exact: Column | None) -> Column:
        if exact is not None:
            return F.get(exact, i)
        return F.when(i == 0, 0).otherwise(F.call_function("instr", text, F.get(chunk, 0)) - 1)

    def record(chunk: Column, i: Column, exact: Column | None) -> Column:
        return F.struct(
            i.alias("chunk_index"),
            F.array_join(chunk, " ").alias("content"),
            F.size(chunk).alias("word_count"),
            start_of(chunk, i, exact).cast("int").alias("start_char"),
        )

    def finish(records: Column, headings: Column) -> Column:
        def last_heading(i: Column) -> Column:
            seen = F.filter(F.slice(headings, 1, i + 1), lambda h: h.isNotNull())
            return F.try_element_at(seen, F.lit(-1))

        return F.transform(
            records,
            lambda r: F.struct(
                r["chunk_index"].alias("chunk_index"),
                r["content"].alias("content"),
                r["word_count"].alias("word_count"),
                r["start_char"].alias("start_char"),
                (r["start_char"] + F.length(r["content"])).cast("int").alias("end_char"),
                # without any heading, the usual case, nothing is searched
                F.when(F.size(headings) > 0, last_heading(r["chunk_index"])).alias("section_title"),
            ),
        )

    def headings_of(records: Column) -> Column:
        found = F.transform(
            records, lambda r: F.when(is_section_heading(r["content"]), r["content"])
        )
        return bind(
            found,
            lambda h: F.when(F.exists(h, lambda x: x.isNotNull()), h).otherwise(
                F.array().cast("array<string>")
            ),
        )

    def finished(tokens: Column, exact: Column | None) -> Column:
        records = F.transform(chunks_of(tokens, size, overlap), lambda c, i: record(c, i, exact))
        return bind(records, lambda r: bind(headings_of(r), lambda h: finish(r, h)))

    def with_records(tokens: Column) -> Column:
        if not exact_offsets:
            return finished(tokens, None)
        return bind(exact_starts(tokens, size - overlap), lambda e: finished(tokens, e))

    return bind(words(text), with_records)
