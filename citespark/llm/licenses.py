"""License scan: identifier tags, notice phrases and licence expressions.

One Aho-Corasick automaton over normalised words finds the notice phrases, another
one over the lower-cased text finds identifier tags. The expression behind a tag
is parsed by a shunting-yard parser and evaluated over and / or / with.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import text_udf

#: Phrases of whole words and the label each one gives.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases of the method; they add labels and leave the base columns alone.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "bsd license": "bsd", "isc license": "isc", "eclipse public license": "epl",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Licence identifiers by the start of their name, and how freely a text under them may be used (0 to 1).
FAMILIES = {
    "agpl": 0.2, "apache": 0.9, "bsd": 0.9, "cc0": 1.0, "cc-by-nc": 0.3, "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc-by": 0.8,
    "epl": 0.5, "gpl": 0.3, "isc": 0.9, "lgpl": 0.4, "mit": 0.9, "mpl": 0.5, "unlicense": 1.0, "public-domain": 1.0,
    "proprietary": 0.0,
}
EXCEPTION_GAIN = 0.2
UNKNOWN = 0.1
NO_NOTICE = 0.5

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
_LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:_-]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The family of a licence identifier, or None if it is unknown: ``gpl-2.0-only`` is ``gpl``."""
    name = identifier.rstrip("+")
    fits = [f for f in FAMILIES if name == f or name.startswith(f + "-") or name.startswith(f + ".")]
    return max(fits, key=len) if fits else None


def tokens_after(text: str, at: int) -> list[str]:
    """Tokens of the expression that starts at ``at``; it ends at the end of the line or at a sign no expression has."""
    out: list[str] = []
    depth, operand = 0, True
    while match := _TOKEN.match(text, at):
        token = match[1]
        if token not in "()" and token not in _PRECEDENCE:
            token = token.rstrip(".:")
        if operand:
            if token == ")" or token in _PRECEDENCE or not token:
                break
            depth += token == "("
            operand = token == "("
        else:
            if token == ")":
                if not depth:
                    break
                depth -= 1
            elif token not in _PRECEDENCE:
                break
            else:
                operand = True
        out.append(token)
        at = match.end()
    while out and (out[-1] in _PRECEDENCE or out[-1] == "("):  # an operator without right side
        out.pop()
    return out


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: with before and before or, left to right; parentheses left open are closed at the end."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif token in _PRECEDENCE:
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    out += [t for t in reversed(held) if t != "("]
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], float] | None:
    """Labels and freedom of an expression: ``or`` takes the freer side, ``and`` the stricter, an exception adds a bit.

    Labels name every family in it, whichever side ``or`` takes. None if it is empty.
    """
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            known = family(token)
            stack.append(({known}, FAMILIES[known]) if known else (set(), UNKNOWN))
            continue
        if len(stack) < 2:
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], min(1.0, left[1] + EXCEPTION_GAIN)))
        else:
            stack.append((left[0] | right[0], (max if token == "or" else min)(left[1], right[1])))
    return stack[-1] if stack else None


def unknown_names(tokens: list[str]) -> set[str]:
    """Identifiers outside the families, in lower case; what follows ``with`` is an exception, no licence."""
    pairs = zip(["", *tokens], tokens)
    return {t for before, t in pairs if t not in "()" and t not in _PRECEDENCE and before != "with" and family(t) is None}


def scanner(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> Callable[[str], tuple]:
    """text -> n_words, n_base, first_word, last_word, base labels, labels, score."""
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in {**notices, **phrases}:
        plain = phrase.encode().translate(_WORD_BYTES).split()
        words.add_word(" " + b" ".join(plain).decode("latin-1") + " ", (phrase, len(plain)))
    for tag in TAGS:
        tags.add_word(tag, tag)
    words.make_automaton()
    tags.make_automaton()

    def scan(text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        found = data.translate(_WORD_BYTES).split()
        line = " " + b" ".join(found).decode("latin-1") + " "
        base, first, last, base_labels, labels = 0, None, None, set(), set()
        seen_to, before = 0, 0
        freedom = []
        for end, (phrase, size) in words.iter(line):
            before += line.count(" ", seen_to, end)  # spaces before the closing one
            seen_to = end
            start = before - size
            if phrase in phrases:
                base += 1
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
                base_labels.add(phrases[phrase])
            label = phrases.get(phrase) or notices[phrase]
            labels.add(label)
            freedom.append(FAMILIES[label])
        if b":" in data:
            lower = data.translate(_LOWER_ASCII).decode("latin-1")
            for end, _ in tags.iter(lower):
                tokens = tokens_after(lower, end + 1)
                value = evaluate(to_postfix(tokens))
                if value is not None:
                    labels |= value[0] | unknown_names(tokens)
                    freedom.append(value[1])
        score = min(freedom) if freedom else NO_NOTICE
        return (
            len(found), base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(score),
        )

    return scan


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(
    docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
) -> DataFrame:
    """Adds the struct ``scan`` to every row, in one pass without a shuffle.

    n_words, n_base (places of base phrases), first_word / last_word (NULL without
    a place), base_labels, labels (with those of notices and expressions; both
    distinct, sorted, '' if none) and score: how freely the text may be used, the
    strictest of its notices, 0.5 without any. NULL and empty texts have no words.
    """
    base = PHRASES if phrases is None else phrases
    more = NOTICES if notices is None else notices

    def make():
        scan = scanner(base, more)

        def work(texts: list) -> dict:
            rows = [scan(t) for t in texts]
            columns = {name: [r[k] for r in rows] for k, name in enumerate(FIELDS)}
            for name in ("first_word", "last_word"):
                columns[name] = pd.array(columns[name], dtype="Int64")
            return columns

        return work

    fields = (
        "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, "
        "score: double>"
    )
    return docs.withColumn("scan", text_udf(fields, make)(F.col(text)))
