"""Editor documents (JSON trees): node table, plain text, LaTeX, Markdown.

A tree is unfolded inside its row (VARIANT arrays; one cast reads all of a
node), so rendering is a narrow job without shuffles. Each node yields a text
before and a text after its children; sorting these pieces by path and joining
them gives the document. Rules that need a look at neighbours ("drop empty
paragraphs", "blank between non-empty parts") are marks in private-use
characters, resolved by regular expressions on the joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.citations import escape_latex

BOLD, ITALIC, STRIKE, CODE = 1, 2, 8, 16
# LaTeX commands of heading levels.
HEADINGS = {"h1": "\\section", "h2": "\\subsection", "h3": "\\subsubsection",
            "h4": "\\paragraph", "h5": "\\subparagraph"}

# marks; see render_latex for their meaning
_S, _E, _U, _V, _W, _X, _Y, _R = (chr(0xE000 + i) for i in range(8))
# The same characters in a text are data: while marks are at work they stand as _HIDE and a character of the next block.
_HIDE = chr(0xE008)
_OWN = [chr(0xE000 + i) for i in range(9)]
_AWAY = [chr(0xE010 + i) for i in range(9)]
_LAST = 2**31 - 1

# what is read of a node, all at once; a node that is no object is NULL, as are fields of another kind.
# Numbers are read as they are stored: a cast of its own for each value costs more than the rest of the node.
_FIELDS = ("type:string,text:string,format:bigint,tag:string,listType:string,citationKey:string,citation_key:string,key:string,"
           "paperId:string,paper_id:string,title:string,authors:array<string>,year:bigint")
_NODE = f"struct<{_FIELDS},children:array<variant>>"
_PLACED = f"struct<path:array<int>,mode:string,node:{_NODE}>"
# levels that are nested transforms; deeper ones take a slower way to the same nodes
FIRST_LEVELS = 4


def _hide(text: Column) -> Column:
    """A text without mark characters, to be turned back by ``_show``."""
    moved = F.translate(F.regexp_replace(text, f"([{_OWN[0]}-{_OWN[-1]}])", f"{_HIDE}$1"), "".join(_OWN[:8]), "".join(_AWAY[:8]))
    # the escape character itself: every one that a text holds has just been doubled
    moved = F.replace(moved, F.lit(_HIDE + _HIDE), F.lit(_HIDE + _AWAY[8]))
    return F.when(F.regexp_like(text, F.lit(f"[{_OWN[0]}-{_OWN[-1]}]")), moved).otherwise(text)


def _show(text: Column) -> Column:
    out = text
    for own, away in zip(_OWN, _AWAY):
        out = F.replace(out, F.lit(_HIDE + away), F.lit(own))
    return F.when(text.contains(_HIDE), out).otherwise(text)


def depth(content: Column) -> Column:
    """How deep braces are nested in a JSON text, found in one pass; braces inside its strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(content, r"\\.", ""), '"[^"]*"', "")
    braces = F.split(F.regexp_replace(bare, "[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, brace: Column) -> Column:
        now = s["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda s: s["most"])


def _placed(content: Column, root_mode: str, child_mode: Callable) -> Column:
    """All nodes below the root as they were read, with path and mode, parents before their children.

    Every node carries a mode its parent chose: ``child_mode(mode, type, has_text, node)``.
    The first levels are nested transforms. What lies below them is unfolded level by level,
    each subtree by itself: ``aggregate`` copies its state at every step, so the state holds
    the nodes of one such subtree only. A node stands in braces of its own, so the depth of
    braces bounds the levels. The JSON parser takes texts of up to 1,000 nested brackets,
    that is about 490 levels of nodes.
    """
    top = F.coalesce(
        F.try_variant_get(F.try_parse_json(content), "$.root.children", f"array<{_NODE}>"),
        F.array().cast(f"array<{_NODE}>"),
    )
    front = F.transform(
        top,
        lambda c, i: F.struct(
            F.array(i).alias("path"), F.lit(root_mode).alias("mode"), c.alias("node")
        ),
    )

    def below(n: Column) -> Column:
        mode = child_mode(n["mode"], n["node"]["type"], n["node"]["text"].isNotNull(), n["node"])
        return F.transform(
            n["node"]["children"],
            lambda c, k: F.struct(
                F.concat(n["path"], F.array(k)).alias("path"), mode.alias("mode"), F.try_variant_get(c, "$", _NODE).alias("node")
            ),
        )

    def leaf(n: Column) -> Column:
        return F.coalesce(F.size(n["node"]["children"]), F.lit(0)) == 0

    def step(s: Column, _: Column) -> Column:
        return F.struct(
            F.concat(s["done"], F.array(s["front"])).alias("done"),
            F.flatten(F.transform(F.filter(s["front"], lambda n: ~leaf(n)), below)).alias("front"),
        )

    def deep(n: Column) -> Column:
        state = F.struct(F.array().cast(f"array<array<{_PLACED}>>").alias("done"), F.array(n).alias("front"))
        # the node itself, its braces, and children of the innermost that have none
        levels = F.lit(2) + depth(F.to_json(n["node"]["children"]))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), levels), state, step, lambda s: s["done"]))

    def subtree(n: Column, levels: int) -> Column:
        if levels == 0:
            return F.when(leaf(n), F.array(n)).otherwise(deep(n))
        under = F.flatten(F.transform(below(n), lambda c: subtree(c, levels - 1)))
        return F.when(leaf(n), F.array(n)).otherwise(F.concat(F.array(n), under))

    return F.flatten(F.transform(front, lambda n: subtree(n, FIRST_LEVELS - 1)))


def _typed(n: Column) -> dict[str, Column]:
    """The attributes of a placed node, with defaults."""
    v = n["node"]
    return {
        "path": n["path"],
        "mode": n["mode"],
        "type": F.coalesce(v["type"], F.lit("")),
        "text": v["text"],
        "format": F.coalesce(v["format"].try_cast("int"), F.lit(0)),
        "tag": F.coalesce(v["tag"], F.lit("h1")),
        "list_type": F.coalesce(v["listType"], F.lit("bullet")),
        "n_children": F.coalesce(F.size(v["children"]), F.lit(0)),
        "citation_key": F.coalesce(*[F.nullif(v[k], F.lit("")) for k in ("citationKey", "citation_key", "key")]),
        "paper_id": F.coalesce(*[F.nullif(v[k], F.lit("")) for k in ("paperId", "paper_id")]),
        "title": F.coalesce(v["title"], F.lit("")),
        "authors": F.coalesce(v["authors"], F.array().cast("array<string>")),
        "year": v["year"].try_cast("int"),
    }


def unfold(content: Column, root_mode: str, child_mode: Callable) -> Column:
    """All nodes below the root as an array of typed records, see ``_placed``."""
    nodes = _placed(content, root_mode, child_mode)
    return F.transform(nodes, lambda n: F.struct(*[c.alias(name) for name, c in _typed(n).items()]))


def _keep_mode(mode: Column, kind: Column, has_text: Column, node: Column) -> Column:
    return mode


def node_table(documents: DataFrame, key: str, content: str) -> DataFrame:
    """One row per node with its path, type and attributes."""
    nodes = unfold(F.col(content), "", _keep_mode)
    return documents.select(key, F.inline(nodes)).drop("mode")


def tree_citations(documents: DataFrame, key: str, content: str) -> DataFrame:
    """Citation nodes anywhere in the trees, in path order per document."""
    found = F.filter(unfold(F.col(content), "", _keep_mode), lambda n: n["type"] == "citation")
    rows = documents.select(key, F.inline(found))
    return rows.select(
        key, "path", "paper_id", "title", "authors", "year",
        F.coalesce("citation_key", F.lit("")).alias("citation_key"),
    )


def _in_order(pieces: Column) -> Column:
    """Texts of (path, text) pieces in document order as one."""
    return F.array_join(F.sort_array(F.filter(pieces, lambda p: p["text"] != ""))["text"], "")


def _joined(nodes: Column, piece: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Texts before and after each node in document order."""

    def both(n: Column) -> Column:
        before, after = piece(n)
        return F.array(
            F.struct(n["path"].alias("at"), before.alias("text")),
            F.struct(F.concat(n["path"], F.array(F.lit(_LAST))).alias("at"), after.alias("text")),
        )

    return _in_order(F.flatten(F.transform(nodes, both)))


def tree_plain_text(content: Column) -> Column:
    """Text nodes in document order, joined by a blank."""
    nodes = unfold(content, "", _keep_mode)
    texts = F.filter(nodes, lambda n: (n["type"] == "text") & n["text"].isNotNull())
    ordered = F.sort_array(F.transform(texts, lambda n: F.struct(n["path"].alias("p"), n["text"].alias("t"))))
    return F.array_join(ordered["t"], " ")


def _cite(n: Column | dict[str, Column], shown: Callable[[Column], Column] = _hide) -> Column:
    return F.concat(
        F.lit("\\cite{"), shown(F.coalesce(n["citation_key"], n["paper_id"], F.lit("unknown"))), F.lit("}")
    )


def _has(n: Column, bit: int) -> Column:
    return n["format"].bitwiseAND(bit) != 0


def _fix(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _latex_mode(mode: Column, kind: Column, has_text: Column, node: Column) -> Column:
    inline = mode.isin("inline", "raw") | ((mode == "li") & (kind != "paragraph"))
    return (
        F.when(mode == "drop", "drop")
        .when((mode == "block") & kind.isin("paragraph", "heading", "quote"), "inline")
        .when((mode == "block") & (kind == "list"), "item")
        .when((mode == "block") & kind.isin("code", "citation", "text"), "drop")
        .when(mode == "block", "block")
        .when((mode == "item") & (kind == "listitem"), "li")
        .when((mode == "item") | ((mode == "li") & (kind == "paragraph")), "inline")
        .when(inline & (kind.isin("text", "citation") | has_text), "drop")
        .otherwise("raw")
    )


def render_latex(content: Column) -> Column:
    """LaTeX body of a tree.

    Marks: S/E block start and end, U after a non-empty inline part, V after a
    block, W after a top-level node, Y/X around a foreign inline node, R after
    each of its texts.
    """
    nodes = F.filter(unfold(content, "block", _latex_mode), lambda n: n["mode"] != "drop")
    lit = F.lit

    def piece(n: Column) -> tuple[Column, Column]:
        kind, mode = n["type"], n["mode"]
        text = _hide(F.coalesce(n["text"], lit("")))
        escaped = escape_latex(text)
        styled = (
            F.when(_has(n, BOLD), F.concat(lit("\\textbf{"), escaped, lit("}")))
            .when(_has(n, ITALIC), F.concat(lit("\\textit{"), escaped, lit("}")))
            .otherwise(escaped)
        )
        command = F.coalesce(
            *[F.when(n["tag"] == tag, cmd) for tag, cmd in HEADINGS.items()], lit("\\paragraph")
        )
        env = F.when(n["list_type"] == "bullet", "itemize").otherwise("enumerate")
        unit = (mode == "inline") | ((mode == "li") & (kind != "paragraph"))
        mark = lambda c: F.when(c != "", F.concat(c, lit(_U))).otherwise("")
        block = mode == "block"
        before = (
            F.when(block & (kind == "paragraph"), lit(_S))
            .when(block & (kind == "heading"), F.concat(command, lit("{")))
            .when(block & (kind == "quote"), lit("\\begin{quote}\n"))
            .when(
                block & (kind == "list"),
                F.concat(lit("\\begin{"), env, lit("}"), F.when(n["n_children"] == 0, "\n").otherwise("")),
            )
            .when(
                block & (kind == "code"),
                F.concat(lit("\\begin{verbatim}\n"), text, lit(f"\n\\end{{verbatim}}{_V}")),
            )
            .when(block & (kind == "citation"), F.concat(_cite(n), lit(_V)))
            .when(mode == "item", lit("\n  \\item "))
            .when(unit & (kind == "text"), mark(F.when(text != "", styled).otherwise("")))
            .when(unit & (kind == "citation"), F.concat(_cite(n), lit(_U)))
            .when(unit & n["text"].isNotNull(), mark(text))
            .when(unit, lit(_Y))
            .when((mode == "raw") & (n["text"].isNotNull() | (n["n_children"] == 0)), F.concat(text, lit(_R)))
            .otherwise("")
        )
        after = (
            F.when(block & (kind == "paragraph"), lit(_E + _V))
            .when(block & (kind == "heading"), lit(f"{_E}}}{_V}"))
            .when(block & (kind == "quote"), lit(f"{_E}\n\\end{{quote}}{_V}"))
            .when(block & (kind == "list"), F.concat(lit("\n\\end{"), env, lit(f"}}{_V}")))
            .when(mode == "item", lit(_E))
            .when(unit & ~kind.isin("text", "citation") & n["text"].isNull(), lit(_X))
            .otherwise("")
        )
        return before, F.concat(after, F.when(F.size(n["path"]) == 1, _W).otherwise(""))

    body = _fix(
        _joined(nodes, piece),
        [
            (_R + _X, _X), (_R, " "), (_Y + _X, ""), (_Y, ""), (_X, _U),
            (_U + _E, _E), (_U, " "), (_S + _E + _V, ""), (f"[{_S}{_E}]", ""),
            (_V + _W, _W), (_V, " "), (f"^{_W}+|{_W}+$", ""), (f"{_W}+", "\n\n"),
        ],
    )
    return _show(body)


def _markdown_mode(mode: Column, kind: Column, has_text: Column, node: Column) -> Column:
    return (
        F.when((mode == "code") | (kind == "code"), "code")
        .when(kind.isin("text", "citation"), "drop")
        .when((mode == "flow") & (kind == "list"), F.coalesce(node["listType"], F.lit("bullet")))
        .otherwise("flow")
    )


def render_markdown(content: Column, title: Column) -> Column:
    """Markdown text of a tree under its title; S/E enclose paragraphs."""
    nodes = F.filter(unfold(content, "flow", _markdown_mode), lambda n: n["mode"] != "drop")
    lit = F.lit

    def piece(n: Column) -> tuple[Column, Column]:
        kind, mode = n["type"], n["mode"]
        text = _hide(F.coalesce(n["text"], lit("")))
        styled = text
        for bit, around in ((BOLD, "**"), (ITALIC, "*"), (STRIKE, "~~"), (CODE, "`")):
            styled = F.when(_has(n, bit), F.concat(lit(around), styled, lit(around))).otherwise(styled)
        item = ~mode.isin("flow", "code")
        bullet = F.when(mode == "bullet", "-").otherwise(
            F.concat((F.try_element_at(n["path"], lit(-1)) + 1).cast("string"), lit("."))
        )
        hashes = F.when(n["tag"] == "h1", "#").when(n["tag"] == "h2", "##").otherwise("###")
        lonely = F.when(F.trim(text) != "", F.concat(text, lit("\n\n"))).otherwise("")
        before = (
            F.when(mode == "code", F.when(kind == "linebreak", "\n").otherwise(text))
            .when(item, F.concat(bullet, lit(" ")))
            .when(kind == "citation", _cite(n))
            .when(kind == "text", styled)
            .when(kind == "paragraph", lit(_S))
            .when(kind == "heading", F.concat(hashes, lit(" ")))
            .when(kind == "list", F.when(n["n_children"] == 0, "\n").otherwise(""))
            .when(kind == "quote", lit("> "))
            .when(kind == "code", F.concat(lit("```\n"), text))
            .when(n["n_children"] == 0, lonely)
            .otherwise("")
        )
        after = (
            F.when(mode == "code", lit(""))
            .when(item, lit("\n"))
            .when(kind == "paragraph", lit(_E))
            .when(kind.isin("heading", "quote"), lit("\n\n"))
            .when(kind == "list", lit("\n"))
            .when(kind == "code", lit("\n```\n\n"))
            .otherwise("")
        )
        return before, after

    body = _fix(_joined(nodes, piece), [(_S + _E, ""), (_S, ""), (_E, "\n\n")])
    return F.concat(lit("# "), title, lit("\n\n"), _show(body))


def _text_mode(mode: Column, kind: Column, has_text: Column, node: Column) -> Column:
    return F.when(kind == "citation", "drop").otherwise(mode)


def render_text(content: Column, title: Column) -> Column:
    """Plain text with citations under an underlined title; one line per top node."""
    nodes = F.filter(_placed(content, "flow", _text_mode), lambda n: n["mode"] != "drop")

    def piece(placed: Column) -> Column:
        n = _typed(placed)
        own = F.when(n["type"] == "citation", _cite(n, lambda text: text)).when(n["type"] == "linebreak", "\n").otherwise(
            F.when(n["n_children"] == 0, F.coalesce(n["text"], F.lit(""))).otherwise("")
        )
        starts_line = (F.size(n["path"]) == 1) & (F.get(n["path"], 0) > 0)
        return F.struct(n["path"].alias("at"), F.when(starts_line, F.concat(F.lit("\n"), own)).otherwise(own).alias("text"))

    body = _in_order(F.transform(nodes, piece))
    return F.concat(title, F.lit("\n"), F.repeat(F.lit("="), F.length(title)), F.lit("\n\n"), body)


def render_json(content: Column, title: Column, exported_at: str) -> Column:
    """Title, tree and export time as one JSON text."""
    return F.to_json(
        F.struct(
            title.alias("title"),
            F.try_parse_json(content).alias("content"),
            F.lit(exported_at).alias("exportDate"),
        )
    )


def node_text(content: Column) -> Column:
    """Raw texts of all nodes (leaves without text count as ''), joined by a blank."""
    leaf_mode = lambda m, k, has_text, n: F.when(has_text | (m == "drop"), "drop").otherwise(m)
    nodes = unfold(content, "raw", leaf_mode)
    leaves = F.filter(
        nodes, lambda n: (n["mode"] != "drop") & (n["text"].isNotNull() | (n["n_children"] == 0))
    )
    ordered = F.sort_array(
        F.transform(leaves, lambda n: F.struct(n["path"].alias("p"), F.coalesce(n["text"], F.lit("")).alias("t")))
    )
    return F.array_join(ordered["t"], " ")


def export_documents(
    documents: DataFrame, fmt: str, exported_at: str = "", key: str = "document_id"
) -> DataFrame:
    """(document, content) in 'markdown', 'txt' or 'json'."""
    content, title = F.col("content"), F.col("title")
    rendered = {
        "markdown": lambda: render_markdown(content, title),
        "txt": lambda: render_text(content, title),
        "json": lambda: render_json(content, title, exported_at),
    }[fmt]()
    return documents.select(key, rendered.alias("content"))


def latex_bodies(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """(document, body) for documents with a tree."""
    return documents.filter(F.col("content").isNotNull()).select(
        key, render_latex(F.col("content")).alias("body")
    )
