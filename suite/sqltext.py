"""Snippets of DuckDB SQL shared by the oracle texts."""

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def overlap(a: str, b: str) -> str:
    return f"len(list_distinct(list_intersect({a}, {b})))"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 12)"


def context_score(previous: str, paragraph: str, title: str, abstract: str) -> str:
    title_words = words(f"lower({title})")
    start = f"list_slice({words(f'lower({abstract})')}, 1, 50)"
    prev_words, para_words = words(f"lower({previous})"), words(f"lower({paragraph})")
    return (
        f"(0.5::DOUBLE + CASE WHEN coalesce({previous}, '') <> '' THEN least({overlap(prev_words, title_words)}"
        f" * 0.1::DOUBLE, 0.3::DOUBLE) ELSE 0 END + CASE WHEN coalesce({paragraph}, '') <> '' THEN "
        f"least({overlap(para_words, start)} * 0.02::DOUBLE, 0.2::DOUBLE) ELSE 0 END)"
    )


def quality_score(cites: str) -> str:
    return (
        f"(0.5::DOUBLE + CASE WHEN coalesce({cites}, 0) > 100 THEN 0.3::DOUBLE "
        f"WHEN coalesce({cites}, 0) > 10 THEN 0.2::DOUBLE ELSE 0::DOUBLE END)"
    )


def recency_score(year: str, as_of_year: int) -> str:
    age = f"({as_of_year} - coalesce({year}, 0))"
    return (
        f"(CASE WHEN {age} <= 2 THEN 1.0::DOUBLE WHEN {age} <= 5 THEN 0.8::DOUBLE "
        f"WHEN {age} <= 10 THEN 0.6::DOUBLE ELSE greatest(0.3::DOUBLE, 1.0::DOUBLE - {age} * 0.02::DOUBLE) END)"
    )


def relevance(sim: str, context: str, quality: str, recency: str) -> str:
    return (
        f"least(greatest({sim} * 0.4::DOUBLE + {context} * 0.25::DOUBLE + {quality} * 0.15::DOUBLE "
        f"+ {recency} * 0.1::DOUBLE + 0.05::DOUBLE, 0::DOUBLE), 1::DOUBLE)"
    )


def display_text(authors: str, year: str) -> str:
    last = words(f"{authors}[1]") + "[-1]"
    return (
        f"concat('(', coalesce({last}, 'Unknown'), CASE WHEN len({authors}) > 1 THEN ' et al.' ELSE '' END, "
        f"', ', CAST(coalesce({year}, 0) AS VARCHAR), ')')"
    )
