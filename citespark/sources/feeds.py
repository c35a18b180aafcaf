"""Metadata payloads: Atom entries (XML), works records (JSON), BibTeX entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import collapse_spaces, strip

ENTRY_SCHEMA = (
    "title string, summary string, published string, author array<struct<name:string>>, "
    "link array<struct<_title:string,_type:string,_href:string,_rel:string>>, "
    "category array<struct<_term:string>>"
)
WORK_SCHEMA = (
    "title array<string>, author array<struct<given:string,family:string>>, abstract string, "
    "`published-print` struct<`date-parts`:array<array<int>>>, "
    "`published-online` struct<`date-parts`:array<array<int>>>, `container-title` array<string>, "
    "publisher string, URL string, `is-referenced-by-count` int"
)


def _clean(text: Column) -> Column:
    return F.nullif(collapse_spaces(strip(text)), F.lit(""))


def map_atom_entry(entries: DataFrame, xml: str) -> DataFrame:
    """Paper fields of one Atom entry per row."""
    parsed = entries.withColumn(
        "_e", F.from_xml(F.col(xml), ENTRY_SCHEMA, {"ignoreNamespace": "true"})
    )
    e = lambda c: F.col(f"_e.{c}")
    names = F.filter(F.transform(e("author"), lambda a: strip(a["name"])), lambda n: n != "")
    doi_href = F.get(F.filter(e("link"), lambda x: x["_title"] == "doi"), 0)["_href"]
    pdf = F.get(F.filter(e("link"), lambda x: x["_type"] == "application/pdf"), 0)
    terms = F.filter(F.transform(e("category"), lambda c: c["_term"]), lambda t: t != "")
    year = F.try_to_timestamp(e("published"))
    return parsed.select(
        *entries.columns,
        _clean(e("title")).alias("title"),
        F.when(F.size(names) > 0, names).alias("authors"),
        _clean(e("summary")).alias("abstract"),
        F.year(year).alias("year"),
        F.when(year.isNotNull(), e("published")).alias("published_date"),
        F.when(doi_href.contains("doi.org/"), F.try_element_at(F.split(doi_href, r"doi\.org/"), F.lit(-1))).alias("doi"),
        F.when(pdf.isNotNull(), F.coalesce(pdf["_href"], F.lit(""))).alias("pdf_url"),
        F.when(F.size(terms) > 0, terms).alias("categories"),
        F.concat(F.lit("arXiv ("), F.get(terms, 0), F.lit(")")).alias("venue"),
    )


def _first_year(date: Column) -> Column:
    return F.get(F.get(date["date-parts"], 0), 0)


def map_works_record(works: DataFrame, json: str) -> DataFrame:
    """Paper fields of one works record per row.

    A print date that is present but empty gives no year; the online date
    counts only when there is no print date at all.
    """
    parsed = works.withColumn("_w", F.from_json(F.col(json), WORK_SCHEMA))
    w = lambda c: F.col("_w")[c]
    names = F.filter(
        F.transform(w("author"), lambda a: F.concat_ws(" ", a["given"], a["family"])), lambda n: n != ""
    )
    year = F.when(w("published-print").isNotNull(), _first_year(w("published-print"))).otherwise(
        _first_year(w("published-online"))
    )
    return parsed.select(
        *works.columns,
        F.get(w("title"), 0).alias("title"),
        F.when(F.size(names) > 0, names).alias("authors"),
        w("abstract").alias("abstract"),
        year.alias("year"),
        F.get(w("container-title"), 0).alias("journal"),
        w("publisher").alias("publisher"),
        w("URL").alias("url"),
        w("is-referenced-by-count").alias("citation_count"),
    )


def _bib_field(text: Column, name: str) -> Column:
    """Value of a field, whole: to the brace that closes it, to the quote outside of braces, or to the next comma.

    The end is found in one walk over the marks that can end a value and the
    runs between them; it counts open braces. What a step needs of the value is
    in its state, as anything else in a walk is worked out anew at every step.
    Braces inside a value only protect its spelling and are left out.
    """
    opening = rf"(?i)(?:^|[,{{\s]){name}\s*=\s*"
    start = F.regexp_instr(text, F.lit(opening)) + F.length(F.regexp_extract(text, opening, 0))
    # an array of one or no value: its elements are worked out once, whatever reads them
    found = F.when(F.regexp_like(text, F.lit(opening)), F.array(F.substr(text, start)))
    return F.get(F.transform(found, _bib_value), 0)


def _bib_value(rest: Column) -> Column:
    """The value at the start of ``rest``."""
    first = F.substring(rest, 1, 1)
    marks = F.when(first == "{", r"[{}]|[^{}]+").when(first == '"', r'[{}"]|[^{}"]+').when(
        first == "'", r"[{}']|[^{}']+"
    ).otherwise(r"[{},\n]|[^{},\n]+")
    runs = F.regexp_extract_all(rest, marks, F.lit(0))

    def walk(state: Column, run: Column) -> Column:
        depth = state["depth"] + F.when(run == "{", 1).when(run == "}", -1).otherwise(0)
        quote = state["quote"]
        ended = F.when(quote == "{", depth == 0).when(
            quote != "", (state["at"] > 0) & (run == quote) & (depth == 0)
        ).otherwise(((run == ",") & (depth == 0)) | (depth < 0) | (run == "\n"))
        step = F.struct(
            quote.alias("quote"), depth.cast("int").alias("depth"), (state["at"] + F.length(run)).alias("at"),
            # a mark is one character: the value ends with it
            F.when(ended, state["at"] + 1).otherwise(F.lit(0)).alias("end"),
        )
        return F.when(state["end"] > 0, state).otherwise(step)

    nothing = F.lit(0).cast("int")
    quote = F.when(first.isin("{", '"', "'"), first).otherwise("")
    state = F.struct(quote.alias("quote"), nothing.alias("depth"), nothing.alias("at"), nothing.alias("end"))
    # without an end the value runs to the end of the entry
    end = F.aggregate(runs, state, walk, lambda s: F.when(s["end"] == 0, s["at"] + 1).otherwise(s["end"]))
    skip = F.when(first.isin("{", '"', "'"), 1).otherwise(0)
    value = F.substr(rest, F.lit(1) + skip, end - 1 - skip)
    return F.nullif(strip(F.translate(value, "{}", "")), F.lit(""))


def parse_bibtex(entries: DataFrame, text: str) -> DataFrame:
    """Paper fields of one BibTeX entry per row; 'Last, First' names are turned round."""
    t = F.col(text)
    author_text = collapse_spaces(_bib_field(t, "author"))

    def turned(name: Column) -> Column:
        last = strip(F.substring_index(name, ",", 1))
        first = strip(F.substr(name, F.call_function("instr", name, F.lit(",")) + 1))
        return F.when(name.contains(","), F.concat(first, F.lit(" "), last)).otherwise(strip(name))

    bare_year = F.nullif(F.regexp_extract(t, r"(?i)\byear\s*=\s*[{\"']*(\d{4})", 1), F.lit(""))
    return entries.select(
        *entries.columns,
        _bib_field(t, "title").alias("title"),
        F.transform(F.split(author_text, " and "), turned).alias("authors"),
        bare_year.cast("int").alias("year"),
        F.coalesce(_bib_field(t, "journal"), _bib_field(t, "booktitle")).alias("journal"),
        _bib_field(t, "doi").alias("doi"),
        _bib_field(t, "abstract").alias("abstract"),
        F.coalesce(_bib_field(t, "arxivid"), _bib_field(t, "eprint")).alias("arxiv_id"),
        F.lit("bibtex").alias("source"),
    )
