"""Paper identifiers in free text: arXiv ids, DOIs, PubMed ids, years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import strip

# Identifier patterns, tried in this order.
ARXIV_NUMBER = r"\d{4}\.\d{4,5}(?:v\d+)?"
ARXIV_PATTERNS = [
    rf"(?i)arXiv[:\s]+({ARXIV_NUMBER})",
    rf"(?i)10\.48550/arXiv\.({ARXIV_NUMBER})",
    rf"(?i)/arXiv\.({ARXIV_NUMBER})",
    rf"\b({ARXIV_NUMBER})\b",
]
DOI_BODY = r"10\.\d{4,}/[-._;()/:\p{L}\p{N}]+"
DOI_PATTERNS = [
    rf"(?i)(?:doi[:\s]+|https?://doi\.org/)({DOI_BODY})",
    rf"\b({DOI_BODY})\b",
]
PMID_PATTERN = r"(?:PMID|pmid)[:\s]+(\d+)"
ARXIV_VALID = r"^\d{4}\.\d{4,5}(v\d+)?$|^[a-z\-]+/\d{7}(v\d+)?$"
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "doi:"]
YEAR_PATTERN = r"\b(19[5-9]\d|20[0-2]\d)\b"
# Patterns of the highlighting view, every match of each is listed.
HIGHLIGHT_PATTERNS = [
    ("arXiv", rf"(?i)arXiv[:\s]+({ARXIV_NUMBER})"),
    ("arXiv", rf"(?i)10\.48550/arXiv\.({ARXIV_NUMBER})"),
    ("arXiv", rf"\b({ARXIV_NUMBER})\b"),
    ("DOI", r"(?i)(?:doi[:\s]+|https?://doi\.org/)(10\.\d{4,}/[-._;()/:a-zA-Z0-9]+)"),
    ("DOI", r"\b(10\.\d{4,}/[-._;()/:a-zA-Z0-9]+)\b"),
]


#: ``\\b`` of the editor, where only ASCII letters, digits and _ make words.
ASCII_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _first_match(text: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that matches; later ones run only if needed."""
    tries = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*tries)


def doi_in_text(text: Column, strip_punct: bool = False) -> Column:
    doi = _first_match(text, DOI_PATTERNS)
    return F.regexp_replace(doi, r"[.,;:]+$", "") if strip_punct else doi


def arxiv_in_text(text: Column) -> Column:
    doi = _first_match(text, DOI_PATTERNS)
    within = F.nullif(F.regexp_extract(doi, rf"(?i)arXiv\.({ARXIV_NUMBER})", 1), F.lit(""))
    return F.coalesce(_first_match(text, ARXIV_PATTERNS), F.when(doi.contains("arXiv"), within))


def pmid_in_text(text: Column) -> Column:
    return _first_match(text, [PMID_PATTERN])


def extract_identifiers(text: Column, strip_punct: bool = False) -> Column:
    """Record of the identifiers a whole text mentions first."""
    return F.struct(
        arxiv_in_text(text).alias("arxiv_id"),
        doi_in_text(text, strip_punct).alias("doi"),
        pmid_in_text(text).alias("pmid"),
    )


def arxiv_in_title(title: Column) -> Column:
    """arXiv id in an original file name."""
    return F.nullif(F.regexp_extract(title, rf"({ARXIV_NUMBER})", 1), F.lit(""))


def merge_identifiers(from_text: Column, from_title: Column) -> Column:
    """Field by field, the text wins over the file name."""
    return F.struct(
        F.coalesce(from_text["arxiv_id"], from_title).alias("arxiv_id"),
        from_text["doi"].alias("doi"),
        from_text["pmid"].alias("pmid"),
    )


def clean_arxiv_id(value: Column) -> Column:
    for prefix in ("arXiv:", "arxiv:"):
        value = F.replace(value, F.lit(prefix), F.lit(""))
    return strip(value)


def is_valid_arxiv_id(cleaned: Column) -> Column:
    return cleaned.rlike(ARXIV_VALID)


def clean_doi(value: Column) -> Column:
    for prefix in DOI_PREFIXES:
        value = F.replace(value, F.lit(prefix), F.lit(""))
    return strip(value)


def latest_year(text: Column, max_year: int = 2025) -> Column:
    """Most recent plausible publication year a text mentions."""
    years = F.transform(
        F.regexp_extract_all(text, F.lit(YEAR_PATTERN), F.lit(1)), lambda y: y.cast("int")
    )
    return F.array_max(F.filter(years, lambda y: y <= max_year))


def item_year(date: Column, date_added: Column) -> Column:
    """First four digits of the date, of the date added only when there is no date."""
    source = F.coalesce(F.nullif(date, F.lit("")), date_added)
    return F.nullif(F.regexp_extract(source, r"(\d{4})", 1), F.lit("")).cast("int")


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of one pattern with exact offsets.

    The pieces between matches come from splitting at the same pattern, so a
    match starts after all earlier pieces and matches. Word edges are those of the editor.
    A text is searched once, and split only if it has matches.
    """
    # a match between word edges is its own value and starts with a digit, which is tried first
    whole = pattern.startswith(r"\b")
    edged = (r"(?=\d)" if whole else "") + pattern.replace(r"\b", ASCII_EDGE)
    start = F.struct(
        F.lit(0).cast("int").alias("offset"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(state: Column, pair: Column) -> Column:
        at = state["offset"] + F.length(pair["gap"])
        return F.struct(
            (at + F.length(pair["hit"])).cast("int").alias("offset"),
            F.concat(state["starts"], F.array(at)).alias("starts"),
        )

    def placed(full: Column) -> Column:
        gaps = F.split(text, edged, -1)
        pairs = F.zip_with(
            F.slice(gaps, 1, F.size(full)), full, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))
        )
        starts = F.aggregate(pairs, start, step, lambda s: s["starts"])
        return F.transform(
            F.arrays_zip(starts.alias("s"), full.alias("f")),
            lambda m: F.struct(
                F.lit(kind).alias("type"),
                (m["f"] if whole else F.regexp_extract(m["f"], pattern, 1)).alias("value"),
                m["s"].alias("position"),
                m["f"].alias("full_match"),
            ),
        )

    # an array of one or no list of matches: its element is worked out once, whatever reads it
    found = F.filter(F.array(F.regexp_extract_all(text, F.lit(edged), F.lit(0))), lambda f: F.size(f) > 0)
    return F.flatten(F.transform(found, placed))


def find_all_identifiers(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per match of every highlighting pattern; overlaps repeat."""
    found = F.transform(F.array(text), lambda t: F.concat(*[_matches(t, kind, p) for kind, p in HIGHLIGHT_PATTERNS]))
    return df.select(key, F.inline(F.flatten(found)))
