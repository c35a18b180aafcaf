"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned from labelled texts too: words, and beginnings of words,
that toxic texts hold far more often than others. Features are rates of lexicon
words (also behind disguised spelling), their nearness to a second person,
capitals, punctuation, digits and disguised words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import labelled_sample, map_rows, text_udf

#: Bounds of what is learned from: labelled documents and words of the lexicon.
SAMPLE_DOCS = 20_000
LEXICON_WORDS = 2_000
MIN_DOCS = 4
MIN_LOG_ODDS = 2.5
STEM = 5
NEAR_WORDS = 4
#: Second persons of the four languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer "
    "ti tus tuyo usted ustedes vosotros".encode().split()
)
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!|*", "oieastasiii")

_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 or b in b"'" else 32 for b in range(256))
_ONE_LINE = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
_INSIDE = re.compile(rb"[0-9@$!|*._-]+(?=[a-z\x80-\xff])")
_UPPER = bytes(range(65, 91))
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[bytes]:
    """Lower-case words as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def share_of(data: bytes, characters: bytes) -> float:
    return (len(data) - len(data.translate(None, characters))) / max(1, len(data))


def disguised_words(lower: bytes) -> list[str]:
    """Words with digits or signs between letters, with the letters that these stand for."""
    line, out, done = lower.translate(_ONE_LINE), [], 0
    for match in _INSIDE.finditer(line):
        at = match.start()
        if at < done or not at or not (line[at - 1] >= 128 or 97 <= line[at - 1] <= 122):
            continue
        done = line.find(b" ", at)
        done = len(line) if done < 0 else done
        word = line[line.rfind(b" ", 0, at) + 1 : done].decode("utf-8", "replace")
        out.append(re.sub(r"[\W_]", "", word.translate(DISGUISES)))
    return out


def matcher(lexicon: dict[bytes, float], stems: dict[bytes, float]) -> ahocorasick.Automaton:
    """Finds lexicon words, stems and second persons in words joined by single spaces, with a space at both ends."""
    found = ahocorasick.Automaton()
    for word in SECOND_PERSON:
        found.add_word(f" {word.decode('latin-1')} ", ("you", 0.0, word))
    for word, weight in lexicon.items():
        found.add_word(f" {word.decode('latin-1')} ", ("word", weight, word))
    for stem, weight in stems.items():
        found.add_word(" " + stem.decode("latin-1"), ("stem", weight, stem))
    found.make_automaton()
    return found


def features_of(text: str, lexicon: dict[bytes, float], find: ahocorasick.Automaton) -> list[float]:
    """Sixteen rates and counts of a text; ``find`` is the matcher of the lexicon."""
    lower = text.lower().encode("utf-8", "surrogatepass")
    words = lower.translate(_WORDS).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    n = max(1, len(words))
    places: dict[str, list[int]] = {"you": [], "word": [], "stem": []}
    weights, stem_weights, kinds = [], [], set()
    seen_to = before = 0
    for end, (kind, weight, word) in find.iter(line):
        before += line.count(" ", seen_to, end)
        seen_to = end
        places[kind].append(before)
        if kind == "word":
            weights.append(weight)
            kinds.add(word)
        elif kind == "stem" and line[end + 1] != " ":  # a stem is the beginning of a longer word
            stem_weights.append(weight)
    near = 0
    if places["you"] and weights:
        you, hits = np.array(places["you"]), np.array(places["word"])
        near = int((np.searchsorted(you, hits + NEAR_WORDS, "right") > np.searchsorted(you, hits - NEAR_WORDS)).sum())
    data = text.encode("utf-8", "surrogatepass")
    disguised = disguised_words(lower)
    revealed = sum(w.encode() in lexicon for w in disguised)
    total = sum(weights)
    return [
        len(weights) / n, len(weights), total / n, max(weights, default=0.0), len(kinds),
        len(stem_weights) / n, len(stem_weights), max(stem_weights, default=0.0),
        near / n, len(places["you"]) / n, share_of(data, _UPPER), share_of(data, b"!?"), share_of(data, _MARKS),
        len(disguised) / n, revealed, float(np.log1p(len(words))),
    ]


@dataclass
class Trees:
    """Boosted trees of equal depth, as arrays: node i has the children 2i+1 and 2i+2."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(feature) and node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48) -> Trees:
    """Gradient boosting on the logistic loss: histogram splits, Newton leaves, lasso-free ridge of 1."""
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(base=float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # a quantile grid has no edge beside a value that almost all rows share
    edges = [np.unique(np.append(e, c.min())) for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    width = int(binned.max()) + 1
    raw = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.full(count, 1e-6)
            cut = np.full(count, width)
            for f, codes in enumerate(binned):
                cells = at * width + codes
                gs = np.bincount(cells, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(cells, h, count * width).reshape(count, width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain[:, len(edges[f]) :] = -1
                top = gain.argmax(1)
                value = gain[np.arange(count), top]
                better = value > best
                best[better], cut[better] = value[better], top[better]
                feature[first : first + count][better] = f
            for k in range(count):
                if cut[k] < width:
                    limit[first + k] = edges[feature[first + k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + 1) * rate
        raw += leaf[node - inner]
        model.feature.append(feature)
        model.limit.append(limit)
        model.leaf.append(leaf)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone curve nearest to the labels (pooled adjacent violators)."""
    order = np.argsort(raw, kind="stable")
    values: list[list[float]] = []  # sum, count, first and last raw score
    for r, t in zip(raw[order].tolist(), y[order].tolist()):
        values.append([t, 1.0, r, r])
        while len(values) > 1 and values[-2][0] * values[-1][1] >= values[-1][0] * values[-2][1]:
            s, n, _, high = values.pop()
            values[-1][0] += s
            values[-1][1] += n
            values[-1][3] = high
    # one unseen row of either kind at both ends keeps the curve off 0 and 1
    heights = [(v[0] + 0.01) / (v[1] + 0.02) for v in values]
    xs = np.array([e for v in values for e in (v[2], v[3])])
    ys = np.array([h for h in heights for _ in (0, 1)])
    return xs, ys


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float]
    stems: dict[bytes, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list, find: ahocorasick.Automaton | None = None) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        find = find or matcher(self.lexicon, self.stems)
        x = np.array([features_of(t, self.lexicon, find) for t in texts], np.float64)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Words and word beginnings with high log-odds for toxic texts, counted once per text over the whole sample."""

    def make():
        def work(texts: list, labels: list) -> list:
            totals: dict[bytes, Counter] = {b"word": Counter(), b"stem": Counter()}
            toxic: dict[bytes, Counter] = {b"word": Counter(), b"stem": Counter()}
            for text, y in zip(texts, labels):
                words = set(words_of(text))
                for kind, found in ((b"word", words), (b"stem", {w[:STEM] for w in words if len(w) > STEM})):
                    totals[kind].update(found)
                    if y:
                        toxic[kind].update(found)
            rows = [(kind.decode(), w, toxic[kind][w], n) for kind in totals for w, n in totals[kind].items()]
            return [list(c) for c in zip(*rows)] if rows else [[], [], [], []]

        return work

    counts = map_rows(sample.select("text", "y"), "kind string, word binary, toxic long, docs long", make, rows=1000)
    both = sample.agg(F.sum("y"), F.count("*")).first()
    n_toxic, n_other = int(both[0] or 0), int(both[1]) - int(both[0] or 0)
    if not n_toxic or not n_other:
        return {}, {}
    summed = counts.groupBy("kind", "word").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("docs") - F.col("toxic") + 0.5) / (n_other + 1))
    strong = summed.withColumn("odds", odds).filter((F.col("toxic") >= MIN_DOCS) & (F.col("odds") >= MIN_LOG_ODDS))
    rows = strong.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "kind", "word").limit(LEXICON_WORDS).collect()
    pick = lambda kind: {bytes(r["word"]): float(r["odds"]) for r in rows if r["kind"] == kind}
    return pick("word"), pick("stem")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
) -> ToxicityModel:
    """Learns from at most ``sample_docs`` labelled documents among those that ``keep`` allows.

    Three quarters of them grow the trees, one quarter calibrates. Without labels
    of both kinds every score is 0.
    """
    sample = labelled_sample(docs, labels, "toxic", keep, sample_docs, doc_id, text)
    lexicon, stems = learn_lexicon(sample)

    def make():
        find = matcher(lexicon, stems)

        def work(ids: list, texts: list, ys: list) -> list:
            return [ids, ys, [features_of(t, lexicon, find) for t in texts]]

        return work

    table = map_rows(sample.select(F.col("doc_id").cast("long"), "text", "y"), "id long, y int, x array<double>", make)
    rows = table.withColumn("part", F.crc32(F.col("id").cast("string").cast("binary")) % 16).toPandas()
    none = ToxicityModel(lexicon, stems, Trees(base=-9.0), (np.array([-9.0, 9.0]), np.array([0.0, 0.0])))
    if rows.empty or rows["y"].nunique() < 2:
        return none
    rows = rows.sort_values(["id", "y"], kind="stable", ignore_index=True)
    x, y = np.array(rows["x"].tolist(), np.float64), rows["y"].to_numpy(np.float64)
    check = (rows["part"] % 4 == 0).to_numpy()
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check = np.ones(len(y), bool)
        trees = fit_trees(x, y)
    else:
        trees = fit_trees(x[~check], y[~check])
    return ToxicityModel(lexicon, stems, trees, isotonic(trees.raw(x[check]), y[check]))


def toxicity_score(model: ToxicityModel) -> Callable[[Column], Column]:
    """A column with the probability that a text is toxic; NULL and empty texts get the score of an empty text."""

    def make():
        find = matcher(model.lexicon, model.stems)
        return lambda texts: model.score(texts, find)

    return text_udf("double", make)
