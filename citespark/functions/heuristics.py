"""Title, authors and abstract of a paper guessed from its lines of text.

A text is turned into an array of lines once; candidates are filtered and
scored inside that array, so a document never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citespark.functions.identifiers import latest_year
from citespark.functions.text import bind, strip, words

# Word lists of the line classifiers.
HEADER_WORDS = [
    "page ", "copyright", "©", "all rights reserved", "preprint", "arxiv:", "doi:", "isbn",
    "issn", "vol.", "no.", "pp.", "journal", "conference", "proceedings",
]
LINK_MARKS = ["http://", "https://", "www.", "@"]
DATE_PATTERN = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
NON_TITLE_STARTS = ["figure", "table", "algorithm", "equation", "section", "chapter"]
SECTION_HEADINGS = ["abstract", "introduction", "references", "acknowledgments"]
TITLE_KEYWORDS = [
    "analysis", "study", "approach", "method", "system", "framework",
    "investigation", "examination", "review", "survey", "model",
]
AUTHOR_SKIP_WORDS = [
    "abstract", "introduction", "keywords", "doi:", "copyright",
    "received", "accepted", "published", "corresponding",
]
NAME_FORBIDDEN = "[@/\\\\|<>\\[\\]{}]"
AFFILIATION_MARKS = r"[0-9*†‡§¶]+"
HEADING_LINES = 100
CANDIDATE_LINES = 50
AUTHOR_LINES = 14
OPTIMAL_TITLE_CHARS = 100


def _any_of(values: list[str]) -> str:
    return "|".join(v.replace(".", r"\.") for v in values)


def is_header_footer(line: Column) -> Column:
    return F.lower(line).rlike(_any_of(HEADER_WORDS))


def has_link_or_date(line: Column) -> Column:
    return line.rlike(_any_of(LINK_MARKS)) | line.rlike(DATE_PATTERN)


def _without_marks(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\([^)]*\)", ""), AFFILIATION_MARKS, "")


def _name_parts(cleaned: Column) -> Column:
    def parts(c: Column) -> Column:
        by_comma, by_and = F.split(c, ","), F.split(c, r"(?i)\s+and\s+")
        return F.transform(F.when(c.contains(","), by_comma).otherwise(by_and), strip)

    return bind(cleaned, parts)


def looks_like_authors(line: Column) -> Column:
    """Comma or 'and' separated parts, at least half of one to five words."""

    def enough(parts: Column) -> Column:
        short = F.size(F.filter(parts, lambda p: F.size(words(p)).between(1, 5)))
        return bind(short, lambda n: (n >= 1) & (n >= F.size(parts) * F.lit(0.5)))

    separated = line.contains(",") | F.lower(line).contains(" and ")
    by_parts = bind(_name_parts(_without_marks(line)), enough)
    return F.coalesce(F.when((F.length(line) >= 5) & separated, by_parts), F.lit(False))


def is_valid_name(text: Column) -> Column:
    return bind(
        words(text),
        lambda tokens: F.size(tokens).between(1, 5)
        & F.exists(tokens, lambda w: w.rlike(r"^\p{Lu}"))
        & ~text.rlike(NAME_FORBIDDEN),
    )


def parse_author_line(line: Column) -> Column:
    """Valid names of one line; empty when there are none."""
    cleaned = strip(_without_marks(line))
    return F.filter(_name_parts(cleaned), is_valid_name)


def looks_like_title(line: Column, following: Column) -> Column:
    """``line`` is trimmed; ``following`` is the trimmed next line or NULL."""

    def mostly_capital(tokens: Column) -> Column:
        long_words = F.filter(tokens, lambda w: F.length(w) > 3)
        return (F.size(tokens) >= 2) & bind(
            long_words,
            lambda x: (F.size(x) > 0)
            & (F.size(F.filter(x, lambda w: w.rlike(r"^\p{Lu}"))) * 2 > F.size(x)),
        )

    shape = F.length(line).between(10, 300) & ~line.rlike(r"[.,;:]$")
    start_ok = ~F.lower(line).rlike(f"^(?:{'|'.join(NON_TITLE_STARTS)})")
    by_next = F.coalesce(looks_like_authors(following), F.lit(False))
    worded = bind(words(line), lambda t: (F.size(t) >= 3) | mostly_capital(t))
    return shape & start_ok & (worded | by_next)


def title_score(line: Column, following: Column, index: Column) -> Column:
    def capital_share(tokens: Column) -> Column:
        capitals = F.size(F.filter(tokens, lambda w: w.rlike(r"^\p{Lu}")))
        return F.when(F.size(tokens) > 0, capitals / F.size(tokens)).otherwise(0.0)

    length_part = F.greatest(F.lit(0), 100 - F.abs(F.length(line) - OPTIMAL_TITLE_CHARS)) / F.lit(100.0)
    position_part = F.when(index < 50, (50 - index) / F.lit(50.0)).otherwise(0.0)
    next_part = (
        F.when(following.isNull(), 0.0)
        .when(looks_like_authors(following), 2.0)
        .when(following == "", 0.5)
        .otherwise(0.0)
    )
    question_part = F.when(line.contains("?"), 0.5).otherwise(0.0)
    keyword_part = F.when(F.lower(line).rlike("|".join(TITLE_KEYWORDS)), 0.3).otherwise(0.0)
    capital_part = bind(words(line), capital_share)
    return length_part + position_part + capital_part + next_part + question_part + keyword_part


def extract_title(lines: Column) -> Column:
    """``struct(title, line)``: a markdown heading, else the best-scored candidate."""
    numbered = lambda n: F.transform(
        F.slice(lines, 1, n), lambda x, i: F.struct(x.alias("text"), i.alias("line"))
    )
    headings = F.filter(
        numbered(HEADING_LINES),
        lambda n: n["text"].startswith("# ")
        & (F.length(strip(n["text"])) > 10)
        & ~F.lower(n["text"]).rlike("|".join(SECTION_HEADINGS)),
    )
    stripped = F.transform(
        numbered(CANDIDATE_LINES),
        lambda n: F.struct(
            strip(n["text"]).alias("text"),
            strip(F.get(lines, n["line"] + 1)).alias("next"),
            n["line"].alias("line"),
        ),
    )
    candidates = F.filter(
        stripped,
        lambda n: F.length(n["text"]).between(10, 300)
        & ~is_header_footer(n["text"])
        & ~has_link_or_date(n["text"])
        & looks_like_title(n["text"], n["next"]),
    )
    scored = F.transform(
        candidates,
        lambda n: F.struct(
            title_score(n["text"], n["next"], n["line"]).alias("score"),
            (-n["line"]).alias("order"),
            n["text"].alias("text"),
        ),
    )
    by_heading = bind(
        F.get(headings, 0),
        lambda h: F.when(
            h.isNotNull(),
            F.struct(strip(F.substr(h["text"], F.lit(3))).alias("title"), h["line"].alias("line")),
        ),
    )
    by_score = bind(
        F.array_max(scored),
        lambda b: F.when(
            b.isNotNull(), F.struct(b["text"].alias("title"), (-b["order"]).alias("line"))
        ),
    )
    return F.coalesce(by_heading, by_score)


def extract_authors(lines: Column, title_line: Column) -> Column:
    """Names of the first parsable line after the title; NULL when none is."""
    after = F.transform(F.slice(lines, title_line + 2, AUTHOR_LINES), strip)
    usable = F.filter(
        after, lambda x: (x != "") & ~F.lower(x).rlike(_any_of(AUTHOR_SKIP_WORDS))
    )
    parsed = F.filter(F.transform(usable, parse_author_line), lambda names: F.size(names) > 0)
    return F.get(parsed, 0)


def _is_abstract_heading(line: Column) -> Column:
    return strip(line).rlike(r"(?i)^(#+\s*)?abstract\s*$")


def _cut_before(lines: Column, hits: Column) -> Column:
    """Lines before the first hit; all of them without a hit."""
    at = F.array_position(hits, F.lit(True)).cast("int")
    return bind(at, lambda p: F.when(p > 0, F.slice(lines, 1, p - 1)).otherwise(lines))


def _abstract_by_heading(lines: Column) -> Column:
    def block(rest: Column) -> Column:
        stops = F.transform(
            rest,
            lambda x: (x.startswith("#") | x.rlike(r"^\d+\.?\s+[A-Z]")) & ~_is_abstract_heading(x),
        )
        body = F.filter(_cut_before(rest, stops), lambda x: ~_is_abstract_heading(x))
        return F.array_join(F.filter(F.transform(body, strip), lambda x: x != ""), " ")

    first = F.array_position(F.transform(lines, _is_abstract_heading), F.lit(True)).cast("int")
    rest = bind(first, lambda p: F.when(p > 0, F.slice(lines, p + 1, F.size(lines))))
    return F.nullif(bind(rest, block), F.lit(""))


def _abstract_by_line(lines: Column) -> Column:
    def following(i: Column) -> Column:
        after = F.transform(F.slice(lines, i + 2, 9), strip)
        return bind(after, lambda a: F.array_join(_cut_before(a, F.transform(a, lambda x: x == "")), " "))

    def inline(line: Column, i: Column) -> Column:
        own = F.regexp_extract(line, r"(?i)^abstract[:\s]+(.+)$", 1)
        text = F.coalesce(strip(F.nullif(own, F.lit(""))), following(i))
        usable = F.lower(line).contains("abstract") & (i + 1 < F.size(lines))
        return F.when(usable, bind(text, lambda x: F.when(F.length(x) > 50, x)))

    return F.get(F.filter(F.transform(lines, inline), lambda x: x.isNotNull()), 0)


def extract_abstract(lines: Column) -> Column:
    """Lines from an abstract heading to the next heading, else an inline abstract."""
    return F.coalesce(_abstract_by_heading(lines), _abstract_by_line(lines))


def extract_metadata(text: Column, max_year: int = 2025) -> Column:
    """Record of title, authors, abstract and year; NULL where nothing was found."""

    def record(lines: Column, title: Column) -> Column:
        # texts that never say "abstract" need no search for one
        abstract = F.when(F.lower(text).contains("abstract"), extract_abstract(lines))
        return F.struct(
            title["title"].alias("title"),
            F.when(title.isNotNull(), extract_authors(lines, title["line"])).alias("authors"),
            abstract.alias("abstract"),
            latest_year(text, max_year).alias("year"),
        )

    return bind(
        F.split(text, "\n"), lambda lines: bind(extract_title(lines), lambda t: record(lines, t))
    )
