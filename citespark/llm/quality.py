"""Quality: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of the lines
beside it; transitions tie neighbours together. Forward-backward gives each
line's probability of being good, and their mean, weighted by line length, is
the quality of the document. A monotone curve maps it to the share of good
documents among the labelled ones.

Labels exist for documents only. Training starts with the document's label on
each line; then lines of bad documents that look good are relabelled by the
model itself, and it is fitted again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import labelled_sample, map_rows, mixed, text_udf
from citespark.llm.toxicity import isotonic

SAMPLE_DOCS = 4_000
#: Lines the fit holds at most; their features are about 350 bytes each.
SAMPLE_LINES = 400_000
OWN = 14
WIDTH = 3 * OWN + 1
#: Characters scored at once; longer documents are one part of their own.
PART_CHARACTERS = 1 << 19

# classes of code points: 0 other, 1 space, 2 lower, 3 upper, 4 digit, 5 sentence mark, 6 other mark, 7 column mark
_CLASSES = np.zeros(0x250, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASSES[_c] = (
        1 if _s.isspace() else 2 if _s.islower() else 3 if _s.isupper() else 4 if _s.isdigit()
        else 5 if _s in ".,;:?'-\"" else 7 if _s in "|\\<>{}[]=_~^" else 6 if _c > 32 and not _s.isalpha() else 0
    )


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the length of each line and the number of lines of each text.

    Lines end at \\n; a text without text has one empty line. Columns: log length,
    shares of seven character classes, word length, share of repeated words and of
    one-word lines, upper-case words, repeated lines, final full stop.
    """
    lines = [line for t in texts for line in t.split("\n")]
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    lengths = np.array([len(line) for line in lines], np.int64)
    joined = "\n".join(lines) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < 0x250, _CLASSES[np.minimum(codes, 0x24F)], 0).astype(np.uint8)
    starts = np.zeros(len(lines), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    safe = np.maximum(lengths, 1)
    x = np.zeros((len(lines), OWN))
    x[:, 0] = np.log1p(lengths) / 8
    for k in range(1, 8):
        marked = (kinds == k).astype(np.int32)
        total = np.add.reduceat(marked, starts) - (1 if k == 1 else 0)  # the line's own \n is no part of it
        x[:, k] = total / safe
    words = x[:, 1] * safe + 1
    x[:, 8] = np.minimum(safe / words, 40) / 10
    seen: set[str] = set()
    at, row = 0, 0
    for n in counts.tolist():
        seen.clear()
        for line in lines[at : at + n]:
            found = line.split()
            if found:
                x[row, 9] = 1 - len(set(found)) / len(found)
                x[row, 10] = len(found) < 3
                x[row, 11] = line.isupper()
                x[row, 12] = line in seen
                x[row, 13] = found[-1][-1:] == "."
                seen.add(line)
            row += 1
        at += n
    return x, lengths, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (0 at the ends of a document), and a constant."""
    out = np.zeros((len(x), WIDTH))
    out[:, :OWN], out[:, -1] = x, 1.0
    ends = np.cumsum(counts)
    first = np.zeros(len(x), bool)
    first[ends - counts] = True
    last = np.zeros(len(x), bool)
    last[ends - 1] = True
    out[1:, OWN : 2 * OWN] = x[:-1]
    out[first, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = x[1:]
    out[last, 2 * OWN : 3 * OWN] = 0
    return out


def line_scores(x: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``with_neighbours(x, counts) @ weights`` without the wide table: neighbours' shares are shifted instead."""
    own, before, after = (x @ weights[k * OWN : (k + 1) * OWN] for k in range(3))
    ends = np.cumsum(counts)
    out = own + weights[-1]
    before, after = np.roll(before, 1), np.roll(after, -1)
    before[ends - counts] = 0
    after[ends - 1] = 0
    return out + before + after


def forward_backward(emit: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 per line, summed pair marginals (2 x 2) and log-partition of each document.

    ``emit`` is the score of label 1 over label 0 for every line, ``move`` the
    transition scores. Documents run side by side, the longest first, so one
    step handles all documents that still have a line.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # documents with more than t lines
    total = len(emit)
    ahead, scale = np.empty((total, 2)), np.empty(total)
    moves = np.exp(move)
    with np.errstate(over="ignore"):
        one = 1 / (1 + np.exp(-emit))
    local = np.stack([1 - one, one], 1) + 1e-300
    norm = np.logaddexp(0, emit)
    at = starts.copy()
    state = local[at]
    for t in range(steps):
        n = alive[t]
        rows = starts[:n] + t
        if t:
            state = (state[:n] @ moves) * local[rows]
        s = state.sum(1)
        state = state / s[:, None]
        ahead[rows], scale[rows] = state, s
    marginal, pairs = np.empty(total), np.zeros((2, 2))
    back = np.ones((0, 2))
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        rows = starts[:n] + t
        grown = np.ones((n, 2))
        if t + 1 < steps:
            m = alive[t + 1]
            nexts = rows[:m] + 1
            weight = back * local[nexts] / scale[nexts][:, None]
            grown[:m] = weight @ moves.T
            pairs += moves * (ahead[rows[:m]].T @ weight)
        back = grown
        both = ahead[rows] * back
        marginal[rows] = both[:, 1] / both.sum(1)
    logz = np.zeros(len(counts))
    np.add.at(logz, np.repeat(np.arange(len(counts)), counts), np.log(scale) + norm)
    return marginal, pairs, logz


@dataclass
class QualityModel:
    weights: np.ndarray
    move: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def means(self, features: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the good-line probabilities of each document."""
        emit = line_scores(features, counts, self.weights)
        good, _, _ = forward_backward(emit, counts, self.move)
        return weighted(good, lengths, counts)

    def score(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        low = 0
        while low < len(texts):  # parts of bounded size; documents are never cut
            high, size = low + 1, len(texts[low])
            while high < len(texts) and size + len(texts[high]) <= PART_CHARACTERS:
                size += len(texts[high])
                high += 1
            out[low:high] = self.means(*line_features(texts[low:high]))
            low = high
        return np.clip(np.interp(out, *self.knots), 0.0, 1.0)


def weighted(good: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    weight = lengths + 1.0
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def fit_chain(x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 120, start=None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the mean conditional log-likelihood of the line labels ``y``."""
    lines = max(1, len(x))
    weights, move = (np.zeros(x.shape[1]), np.zeros((2, 2))) if start is None else (start[0].copy(), start[1].copy())
    firsts = np.cumsum(counts) - counts
    inner = np.ones(lines, bool)
    inner[firsts] = False
    before = np.zeros(lines, np.int64)
    before[1:] = y[:-1]
    seen = np.bincount(2 * before[inner] + y[inner].astype(np.int64), minlength=4).reshape(2, 2).astype(float)
    m1, m2 = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        marginal, pairs, _ = forward_backward(x @ weights, counts, move)
        slope = np.concatenate([x.T @ (y - marginal) / lines - 1e-4 * weights, ((seen - pairs) / lines - 1e-3 * move).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        change = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        weights, move = weights + change[:-4], np.clip(move + change[-4:].reshape(2, 2), -4, 4)
    return weights, move


def lines_each(counts: np.ndarray, bound: int) -> int:
    """The largest number of lines a document may keep so that all together keep at most ``bound``; at least one."""
    sizes = np.sort(np.asarray(counts, np.int64))
    below = np.cumsum(sizes) - sizes
    left = len(sizes) - np.arange(len(sizes))
    if not len(sizes) or below[-1] + sizes[-1] <= bound:
        return int(sizes[-1]) if len(sizes) else 1
    at = np.flatnonzero(below + sizes * left > bound)[0]  # from here on documents are cut
    return max(1, int((bound - below[at]) // left[at]))


def run_of_lines(text: str, most: int, key: int) -> str:
    """The text, or a run of ``most`` lines from a place that depends on ``key`` where it has more."""
    if text.count("\n") < most:
        return text
    lines = text.split("\n")
    at = int(mixed(np.array([key], np.int64), 3)[0] % np.uint64(len(lines) - most + 1))
    return "\n".join(lines[at : at + most])


def fit_quality(
    docs: DataFrame, labels: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
    sample_lines: int = SAMPLE_LINES,
) -> QualityModel:
    """Learns from at most ``sample_docs`` labelled documents among those that ``keep`` allows.

    Only line features travel to the fit, not texts, and those of at most ``sample_lines`` lines (but one of every
    document): where there are more, the longest documents give one run of consecutive lines each, all of one length.
    Without labels of both kinds every score is 1.
    """
    sample = labelled_sample(docs, labels, "quality", keep, sample_docs, doc_id, text)
    sizes = sample.select((F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).toPandas()
    most = lines_each(sizes["n"].to_numpy(np.int64), sample_lines)

    def make():
        def work(ids: list, texts: list, ys: list) -> list:
            texts = [run_of_lines(t, most, i) for i, t in zip(ids, texts)]
            x, lengths, counts = line_features(texts) if texts else (np.zeros((0, OWN)), np.zeros(0), np.zeros(0, int))
            ends = np.cumsum(counts)
            parts = [x[e - n : e].astype(np.float32).tobytes() for e, n in zip(ends, counts)]
            sizes = [lengths[e - n : e].tolist() for e, n in zip(ends, counts)]
            return [ids, ys, sizes, parts]

        return work

    table = map_rows(
        sample.select(F.col("doc_id").cast("long"), "text", "y"), "id long, y int, lengths array<long>, x binary", make, rows=64
    )
    rows = table.toPandas()
    if rows.empty or rows["y"].nunique() < 2:
        return QualityModel(np.zeros(WIDTH), np.zeros((2, 2)), (np.array([0.0, 1.0]), np.array([1.0, 1.0])))
    rows = rows.sort_values(["id", "y"], kind="stable", ignore_index=True)
    counts = np.array([len(n) for n in rows["lengths"]], np.int64)
    lengths = np.concatenate([np.asarray(n, np.int64) for n in rows["lengths"]])
    own = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, OWN) for b in rows["x"]]).astype(np.float64)
    label = rows["y"].to_numpy(np.int64)
    x, y = with_neighbours(own, counts), np.repeat(label, counts)
    weights, move = fit_chain(x, counts, y)
    # lines of bad documents that look good are good lines; every bad document keeps its worst lines
    good, _, _ = forward_backward(x @ weights, counts, move)
    usual = np.quantile(good[y == 1], 0.25)
    worst = np.minimum.reduceat(good, np.cumsum(counts) - counts)
    y = np.where((y == 0) & (good >= usual) & (good > np.repeat(worst, counts)), 1, y)
    weights, move = fit_chain(x, counts, y, start=(weights, move))
    model = QualityModel(weights, move, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    raw = model.means(own, lengths, counts)
    return QualityModel(weights, move, isotonic(raw, label.astype(np.float64)))


def quality_score(model: QualityModel) -> Callable[[Column], Column]:
    """A column with the probability that a text is good; NULL and empty texts get the score of one empty line."""
    return text_udf("double", lambda: lambda texts: model.score(texts))
