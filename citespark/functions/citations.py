"""Citation texts: in-text form, keys, BibTeX entries, LaTeX escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citespark.functions.text import words

# Words that never enter a citation key.
KEY_STOP_WORDS = ["a", "an", "the", "of", "in", "on", "at", "to", "for"]
EDITOR_STOP_WORDS = ["the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but"]
# Venues of preprints.
PREPRINT_VENUES = ["arxiv", "biorxiv", "medrxiv"]
# LaTeX replacements, applied one after the other in this order.
LATEX_REPLACEMENTS = [
    ("\\", "\\textbackslash{}"),
    ("{", "\\{"),
    ("}", "\\}"),
    ("$", "\\$"),
    ("&", "\\&"),
    ("#", "\\#"),
    ("^", "\\textasciicircum{}"),
    ("_", "\\_"),
    ("~", "\\textasciitilde{}"),
    ("%", "\\%"),
]


def _last_word(name: Column, name_order: str) -> Column:
    if name_order == "last_first":
        family = F.when(name.contains(","), F.split(name, ",")[0])
        return F.coalesce(family, F.try_element_at(words(name), F.lit(-1)))
    return F.try_element_at(words(name), F.lit(-1))


def _first_author(authors: Column) -> Column:
    return F.nullif(F.get(authors, 0), F.lit(""))


def display_text(authors: Column, year: Column, name_order: str = "first_last") -> Column:
    """(Last et al., Year), (Last, Year) or (Unknown, Year)."""
    name = F.coalesce(_last_word(F.get(authors, 0), name_order), F.lit("Unknown"))
    several = F.when(F.size(authors) > 1, " et al.").otherwise("")
    return F.concat(
        F.lit("("), name, several, F.lit(", "), F.coalesce(year, F.lit(0)).cast("string"), F.lit(")")
    )


def _letters(value: Column) -> Column:
    return F.regexp_replace(value, "[^a-zA-Z]", "")


def citation_key(authors: Column, year: Column, title: Column) -> Column:
    """Letters of the last name, year or 0000, first title word that keeps a letter."""
    author = F.coalesce(_letters(_last_word(_first_author(authors), "first_last")), F.lit("Unknown"))
    when = F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("0000"))
    usable = F.filter(words(title), lambda w: ~F.lower(w).isin(KEY_STOP_WORDS) & (_letters(w) != ""))
    return F.concat(author, when, F.coalesce(_letters(F.get(usable, 0)), F.lit("")))


def citation_key_editor(authors: Column, year: Column, title: Column, paper_id: Column) -> Column:
    """The editor's key: 'nd' for no year, capitalised word, id when too short."""
    parts = F.split(F.trim(F.get(authors, 0)), " ")
    author = F.coalesce(_letters(F.try_element_at(parts, F.lit(-1))), F.lit("Unknown"))
    when = F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("nd"))
    usable = F.filter(
        F.split(F.coalesce(title, F.lit("")), " "), lambda w: ~F.lower(w).isin(EDITOR_STOP_WORDS)
    )
    word = F.coalesce(F.regexp_replace(F.get(usable, 0), "[^a-zA-Z0-9]", ""), F.lit(""))
    cased = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))
    key = F.concat(author, when, cased)
    fallback = F.concat(F.lit("Paper_"), F.substring(paper_id.cast("string"), 1, 8))
    return F.when((key == "Unknownnd") | (F.length(key) < 5), fallback).otherwise(key)


def _field(name: str, value: Column) -> Column:
    """One BibTeX line, NULL when the value is missing or empty."""
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.concat(F.lit(f"  {name} = {{"), text, F.lit("}"))


def bibtex_type(arxiv_id: Column, journal: Column) -> Column:
    preprint = F.coalesce(arxiv_id, F.lit("")) != ""
    venue = F.coalesce(F.lower(journal).isin(PREPRINT_VENUES), F.lit(False))
    return F.when(preprint | venue, "misc").otherwise("article")


def bibtex_entry(
    *,
    authors: Column,
    year: Column,
    title: Column,
    journal: Column,
    doi: Column,
    arxiv_id: Column,
    pubmed_id: Column,
    source_url: Column,
    abstract: Column,
) -> Column:
    """One entry; missing fields are left out and the last field has no comma."""
    kind = bibtex_type(arxiv_id, journal)
    plain_abstract = F.replace(F.replace(abstract, F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("''"))
    fields = F.concat_ws(
        ",\n",
        F.concat(F.lit("  title = {"), F.coalesce(title, F.lit("")), F.lit("}")),
        _field("author", F.array_join(authors, " and ")),
        _field("year", F.nullif(year, F.lit(0))),
        F.when(kind == "article", _field("journal", journal)).otherwise(
            _field("howpublished", journal)
        ),
        _field("doi", doi),
        _field("eprint", arxiv_id),
        F.when(F.coalesce(arxiv_id, F.lit("")) != "", F.lit("  archivePrefix = {arXiv}")),
        _field("pmid", pubmed_id),
        _field("url", source_url),
        _field("abstract", plain_abstract),
    )
    key = citation_key(authors, year, title)
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), fields, F.lit("\n}\n"))


def bibtex_of(df_columns: dict[str, Column] | None = None) -> Column:
    """``bibtex_entry`` over the columns of a papers table."""
    names = [
        "authors", "year", "title", "journal", "doi", "arxiv_id", "pubmed_id", "source_url", "abstract",
    ]
    given = df_columns or {}
    return bibtex_entry(**{n: given.get(n, F.col(n)) for n in names})


def escape_latex(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, replacement in LATEX_REPLACEMENTS:
        out = F.replace(out, F.lit(char), F.lit(replacement))
    return out
