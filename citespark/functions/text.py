"""Text cleaning, sentences, cursor context and change detection.

Patterns avoid look-around and inline flags, so that other engines with
RE2-style regular expressions can run them unchanged. Letters and digits are
Unicode-aware through ``\\p{L}`` / ``\\p{N}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
SENTENCE = rf"[^.!?\n]+[.!?]+{WS}*|[^.!?\n]+"
MIN_SENTENCE_CHARS = 10
MIN_REQUEST_CHARS = 10
MIN_CHANGE_RATIO = 0.2


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column used several times, or inside a lambda over an array, is otherwise
    evaluated at every use; as a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+", " ")


def words(text: Column) -> Column:
    """White-space tokens without empty ones; NULL counts as no text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{WS}+"), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` tokens; the rest of the text is not split."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"{WS}+", n + 2)
    return F.slice(F.filter(F.slice(parts, 1, n + 1), lambda w: w != ""), 1, n)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def char_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def preprocess_text(text: Column) -> Column:
    """Collapse spaces, drop symbols, shorten dot runs, close up end marks."""
    out = collapse_spaces(text)
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_.!?,;:\-() ]", "")
    out = F.regexp_replace(out, r"\.{2,}", ".")
    out = F.regexp_replace(out, r" +([.!?])", "$1")
    return strip(out)


def raw_sentences(text: Column) -> Column:
    """Sentences with their trailing space, or non-blank lines when none match."""
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    return bind(
        F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, found).otherwise(lines),
    )


def sentences(text: Column, min_chars: int = 0) -> Column:
    """Trimmed sentences of at least ``min_chars`` characters."""
    trimmed = F.transform(raw_sentences(text), strip)
    return F.filter(trimmed, lambda s: (F.length(s) >= min_chars) & (s != ""))


def strip_final_punct(sentence: Column) -> Column:
    """The sentence without end marks; unchanged when nothing else is left."""
    cleaned = strip(F.regexp_replace(sentence, rf"[.!?]+{WS}*$", ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), sentence)


def _neighbour(array: Column, index: Column) -> Column:
    return F.when(index >= 0, F.get(array, index))


def sentence_index_by_search(sents: Column, original: Column, cursor: Column) -> Column:
    """0-based sentence whose end, searched in ``original``, reaches the cursor.

    Sentences that do not occur in the original are passed over; when no end
    reaches the cursor the last sentence is taken. Empty input gives 0.
    """
    start = F.struct(
        F.lit(0).cast("int").alias("seen"),
        F.lit(0).cast("int").alias("end"),
        F.lit(-1).cast("int").alias("hit"),
    )

    def step(state: Column, sentence: Column) -> Column:
        at = F.call_function("locate", sentence, original, state["end"] + 1)
        stop = at - 1 + F.length(sentence)
        found = at > 0
        return F.struct(
            (state["seen"] + 1).cast("int").alias("seen"),
            F.when(found, stop).otherwise(state["end"]).cast("int").alias("end"),
            F.when((state["hit"] < 0) & found & (cursor <= stop), state["seen"])
            .otherwise(state["hit"])
            .cast("int")
            .alias("hit"),
        )

    return F.aggregate(
        sents,
        start,
        step,
        lambda s: F.when(s["hit"] >= 0, s["hit"]).otherwise(F.greatest(s["seen"] - 1, F.lit(0))),
    )


def sentence_index_by_length(raw: Column, cursor: Column) -> Column:
    """0-based sentence in which the running length reaches the cursor; default last."""
    start = F.struct(
        F.lit(0).cast("int").alias("seen"),
        F.lit(0).cast("int").alias("chars"),
        F.lit(-1).cast("int").alias("hit"),
    )

    def step(state: Column, sentence: Column) -> Column:
        end = state["chars"] + F.length(sentence)
        inside = (state["chars"] <= cursor) & (cursor <= end)
        return F.struct(
            (state["seen"] + 1).cast("int").alias("seen"),
            end.cast("int").alias("chars"),
            F.when((state["hit"] < 0) & inside, state["seen"])
            .otherwise(state["hit"])
            .cast("int")
            .alias("hit"),
        )

    return F.aggregate(
        raw, start, step, lambda s: F.when(s["hit"] >= 0, s["hit"]).otherwise(s["seen"] - 1)
    )


def paragraph_at_cursor(text: Column, cursor: Column) -> Column:
    """Paragraph whose end reaches the cursor; every break counts two characters."""
    parts = F.split(text, rf"\n{WS}*\n")
    start = F.struct(
        F.lit(0).cast("int").alias("offset"), F.lit(None).cast("string").alias("hit")
    )

    def step(state: Column, part: Column) -> Column:
        end = state["offset"] + F.length(part)
        return F.struct(
            (end + 2).cast("int").alias("offset"),
            F.when(state["hit"].isNull() & (cursor <= end), part)
            .otherwise(state["hit"])
            .alias("hit"),
        )

    return strip(
        F.aggregate(
            parts, start, step, lambda s: F.coalesce(s["hit"], F.try_element_at(parts, F.lit(-1)))
        )
    )


def extract_context(text: Column, cursor: Column | None = None, section: Column | None = None) -> Column:
    """Context record of one request: sentence, neighbours, paragraph, section, position."""
    position = F.length(text) if cursor is None else F.coalesce(cursor, F.length(text))

    def record(found: Column) -> Column:
        sents, index = found["sents"], found["index"]
        return F.struct(
            F.coalesce(F.get(sents, index), F.lit("")).alias("current_sentence"),
            _neighbour(sents, index - 1).alias("previous_sentence"),
            F.get(sents, index + 1).alias("next_sentence"),
            paragraph_at_cursor(text, position).alias("paragraph"),
            (F.lit(None) if section is None else section).cast("string").alias("section"),
            position.cast("int").alias("position"),
        )

    def located(sents: Column) -> Column:
        index = sentence_index_by_search(sents, text, position)
        return bind(F.struct(sents.alias("sents"), index.alias("index")), record)

    return bind(sentences(preprocess_text(text), MIN_SENTENCE_CHARS), located)


def editor_context(text: Column, cursor: Column | None = None) -> Column:
    """Context as an editor sends it: running lengths, matching text without end marks.

    Without a hit the last sentence is used, and then there is no next one.
    """

    def record(found: Column) -> Column:
        raw, index = found["raw"], found["index"]
        current = strip(F.get(raw, index))
        return F.struct(
            strip_final_punct(F.coalesce(current, F.lit(""))).alias("current_sentence"),
            strip(_neighbour(raw, index - 1)).alias("previous_sentence"),
            strip(F.get(raw, index + 1)).alias("next_sentence"),
            F.coalesce(current, F.lit("")).alias("paragraph"),
            F.coalesce(F.lit(None) if cursor is None else cursor, F.length(text))
            .cast("int")
            .alias("position"),
        )

    def located(raw: Column) -> Column:
        last = F.size(raw) - 1
        index = last if cursor is None else F.coalesce(sentence_index_by_length(raw, cursor), last)
        return bind(F.struct(raw.alias("raw"), index.alias("index")), record)

    return bind(raw_sentences(text), located)


def _both_clean(old: Column, new: Column) -> Column:
    clean = lambda x: collapse_spaces(strip(F.coalesce(x, F.lit(""))))
    return F.struct(clean(old).alias("o"), clean(new).alias("n"))


def _clean_ratio(pair: Column) -> Column:
    old, new = pair["o"], pair["n"]
    longest = F.greatest(F.length(old), F.length(new))
    same = F.size(
        F.filter(F.zip_with(F.split(old, ""), F.split(new, ""), lambda a, b: a == b), lambda x: x)
    )
    return (
        F.when(longest == 0, F.lit(0.0))
        .when((old == "") | (new == ""), F.lit(1.0))
        .otherwise(F.lit(1.0) - same.cast("double") / longest.cast("double"))
    )


def change_ratio(old: Column, new: Column) -> Column:
    """1 - share of equal characters at equal positions, over the longer text."""
    return bind(_both_clean(old, new), _clean_ratio)


def should_update(old: Column, new: Column) -> Column:
    """True when a text change is large enough to ask for new suggestions."""
    return F.when(old == new, F.lit(False)).otherwise(
        bind(
            _both_clean(old, new),
            lambda p: F.when(p["o"] == "", F.length(p["n"]) > MIN_SENTENCE_CHARS).otherwise(
                _clean_ratio(p) > MIN_CHANGE_RATIO
            ),
        )
    )


def long_enough(text: Column) -> Column:
    """Length gate of a suggestion request."""
    return F.length(strip(F.coalesce(text, F.lit("")))) >= MIN_REQUEST_CHARS


def text_key(text: Column) -> Column:
    """Cache key of a text."""
    return F.md5(text)


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def contains_pattern(value: Column, needle: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` of the needle act as wildcards, a backslash is itself."""
    plain = needle.replace("\\", "\\\\")
    return F.ilike(value, F.lit(f"%{plain}%"))


def split_names(value: Column) -> Column:
    """Author field of a form: split at ',' or ';', trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[,;]"), strip)
    return F.filter(parts, lambda x: x != "")
