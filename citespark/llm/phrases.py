"""Collocations of words by Toivonen's mining: a sample proposes, full passes count exactly until nothing is missing.

The sample proposes words and word pairs that are frequent in it at a lowered
threshold. Their negative border is every phrase that is not proposed while all
its parts are: any other word, other pairs of proposed words, triples of proposed
pairs. A full pass counts the proposed phrases and those of the border that occur,
exactly. A frequent phrase of the border is a failure: longer phrases with it may
be frequent and were not counted. So each further pass adds the frequent phrases
found so far to the proposal and counts what has become eligible by that, and
nothing twice, until a pass leaves no failure. Counts never depend on the sample.

Tasks hold a proposal as a Bloom filter of fixed size. A filter has no false
negative, and a false positive only has one more phrase counted; the same filters
say in later passes what was counted before. Tasks count whole texts in chunks,
words as numbers, and send one row per distinct phrase and chunk. Rows carry
64-bit hashes of (group, word). The first pass sees every word and proves that no
two share a hash (else it starts again with another seed), so counts by hashes
are exact; words come back at the end, for the frequent phrases only.

Defined cases: a NULL text is empty; a NULL group is ``und``; rows are never
joined by id, so repeated rows count as often as they occur. A text without words
adds nothing; an empty table gives no phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.common import arrow_schema, checkpoint

LEAST, MOST_WORDS, TOP = 10, 3, 2000
#: The share of rows in the sample, and the least count in it of what is proposed (more if the share asks for more).
SAMPLE, PROPOSED = 0.1, 2
#: Bytes of texts that a task counts at once; longer texts are cut between words.
CHUNK = 8 << 20
#: Bits of a filter, and bits that a phrase sets; it is sent to the tasks, 4 MB whatever the number of phrases.
FILTER_BITS, FILTER_HASHES = 1 << 25, 4
SEGMENT_BITS = 1 << 16
#: Rows of a group are cut to its best ones in so many parts before they meet.
SALTS = 64
#: Ends of pieces become line ends, tabs blanks, and A-Z a-z.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\t"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + STOPS + BLANKS, bytes(range(97, 123)) + b"\n" * len(STOPS) + b" ")
_CUT = re.compile(rb"[ \n]")
#: Hashes of the words, 0 after the last. Rows of one word name group and word, with a line end between them;
#: the row without a hash counts all words of its group.
COUNTS = "h1 long, h2 long, h3 long, name binary, n long"
KEYS = ["h1", "h2", "h3", "name"]
_ARROW = arrow_schema(COUNTS)


# ---- words and filters inside a task


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chained(*words: np.ndarray) -> np.ndarray:
    """A hash of phrases from the hashes of their words."""
    return reduce(lambda done, h: mixed(done * np.uint64(0x9E3779B97F4A7C15) + h), words[1:], words[0])


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The bits that phrases set, one row for each of the ``FILTER_HASHES``."""
    step = mixed(hashes) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + np.uint64(k) * step) & np.uint64(FILTER_BITS - 1) for k in range(FILTER_HASHES)])


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where a filter (packed bits) may hold a phrase."""
    at = bits_of(hashes)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


class Chunk:
    """Texts of up to ``CHUNK`` bytes by group, and the counts of their phrases.

    ``passes`` are the filters (words, pairs) of all passes so far; None counts words and all pairs.
    """

    def __init__(self, passes: list[tuple[np.ndarray, np.ndarray]] | None, seed: int):
        self.passes, self.seed = passes, seed
        self.clear()

    def clear(self) -> None:
        #: by group: texts with blanks around words and line ends, and how many of their first words were counted before
        self.texts: dict[str, list[bytes]] = {}
        self.seen: dict[str, list[int]] = {}
        self.size = 0

    def add(self, group: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Takes a text; counts are given whenever the chunk is full."""
        low, tail = 0, []
        while low < len(text):
            high = low + CHUNK
            cut = _CUT.search(text, high) if high < len(text) else None  # between words
            high = cut.end() if cut else len(text)
            part = text[low:high].replace(b"\n", b" \n ")
            low = high
            self.texts.setdefault(group, []).append(b" ".join([*tail, part, b"\n"]))
            self.seen.setdefault(group, []).append(len(tail))
            self.size += len(part)
            if low < len(text):  # the last words again, as the start of what goes on; their own counts are done
                tail = [*tail, *filter(None, part.split(b" "))][1 - MOST_WORDS :]
            if self.size >= CHUNK:
                yield from self.counts()

    def counts(self) -> Iterator[pa.RecordBatch]:
        for group in self.texts:
            yield from self.of_group(group)
        self.clear()

    def numbered(self, group: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The words of a group as numbers from 1, 0 between pieces; which were not counted before; the words, by number."""
        lists = pc.split_pattern(pa.array(self.texts[group], pa.large_binary()), b" ")
        starts, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        number = np.arange(1, len(words) + 1)
        for word, value in ((b"", -1), (b"\n", 0)):
            if word in words:
                number[words.index(word)] = value
        ids = number[coded.indices.to_numpy()]
        fresh = np.ones(len(ids), bool)
        for at, k in zip(starts.tolist(), self.seen[group]):
            fresh[at : at + k] = False
        real = ids >= 0
        return np.concatenate([[0], ids[real]]), np.concatenate([[False], fresh[real]]), [b"", *words]

    def of_group(self, group: str) -> Iterator[pa.RecordBatch]:
        """One row for each phrase that this pass counts."""
        ids, fresh, words = self.numbered(group)
        n = len(words)
        seed = xxhash.xxh64_intdigest(group, seed=self.seed)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w, seed=seed) or 1 for w in words], np.uint64)
        pairs, ends = self.ending(ids, fresh, 2)
        left, right = ids[pairs - 1], ids[pairs]
        if self.passes is None or len(self.passes) == 1:
            once = np.bincount(ids[fresh], minlength=n)
            once[0] = 0
            found = np.flatnonzero(once)
            prefix = group.encode() + b"\n"
            yield from self.rows(hashes, [found], once[found], [prefix + words[i] for i in found.tolist()])
            yield pa.RecordBatch.from_pylist([{"h1": 0, "h2": 0, "h3": 0, "name": prefix, "n": int(once.sum())}], schema=_ARROW)
        if self.passes is None:
            yield from self.rows(hashes, *self.distinct([left, right], n))
            return
        known = [holds(singles, hashes) for singles, _ in self.passes]
        new = self.new([k[left] & k[right] for k in known])
        yield from self.rows(hashes, *self.distinct([left[new], right[new]], n))
        # whether a pair is held is looked up once for each distinct pair
        codes, back = np.unique(ids[ends - 1] * n + ids[ends], return_inverse=True)
        pair_hash = chained(hashes[codes // n], hashes[codes % n])
        held = np.zeros((len(self.passes), len(ids)), bool)
        for k, (_, doubles) in enumerate(self.passes):
            held[k, ends] = holds(doubles, pair_hash)[back]
        at, _ = self.ending(ids, fresh, 3)
        at = at[self.new([h[at - 1] & h[at] for h in held])]
        yield from self.rows(hashes, *self.distinct([ids[at - 2], ids[at - 1], ids[at]], n))

    @staticmethod
    def new(may: list[np.ndarray]) -> np.ndarray:
        """Eligible now and in no earlier pass."""
        return reduce(lambda out, earlier: out & ~earlier, may[:-1], may[-1])

    @staticmethod
    def ending(ids: np.ndarray, fresh: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of a size end whose last word was not counted before, and where any do."""
        whole = ids > 0
        inside = reduce(np.logical_and, [whole[size - 1 - k : len(ids) - k] for k in range(size)]) if len(ids) >= size else np.zeros(0, bool)
        ends = np.flatnonzero(inside) + size - 1
        return ends[fresh[ends]], ends

    @staticmethod
    def distinct(columns: list[np.ndarray], n: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct rows of word numbers and their counts."""
        codes, tables = columns[0], []
        for k, column in enumerate(columns[1:]):
            table = None
            if k:  # dense numbers for what is in use keep three words within 64 bits
                table, codes = np.unique(codes, return_inverse=True)
            tables.append(table)
            codes = codes * n + column
        codes, counts = np.unique(codes, return_counts=True)
        out = []
        for table in reversed(tables):
            out.append(codes % n)
            codes = codes // n if table is None else table[codes // n]
        return [codes, *reversed(out)], counts

    @staticmethod
    def rows(hashes: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, names: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
        step = 1 << 16
        for low in range(0, len(counts), step):
            k = len(counts[low : low + step])
            arrays = [pa.array(hashes[c[low : low + step]].view(np.int64)) for c in columns]
            arrays += [pa.array(np.zeros(k, np.int64))] * (MOST_WORDS - len(columns))
            arrays += [pa.nulls(k, pa.binary()) if names is None else pa.array(names[low : low + step], pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts[low : low + step], pa.int64())], schema=_ARROW)


# ---- passes


def counted(texts: DataFrame, passes: list[tuple[np.ndarray, np.ndarray]] | None, seed: int) -> DataFrame:
    """Counts of the phrases of (grp, text as binary) that a pass counts, as ``COUNTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(passes, seed)
        for batch in batches:
            for group, text in zip(batch.column(0), batch.column(1)):
                yield from chunk.add(group.as_py(), text.as_py().translate(_TABLE))
        yield from chunk.counts()

    return texts.select("grp", "text").mapInArrow(run, COUNTS).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """The hashes of phrases of one size, from the hashes of their words."""
    return chained(*(c.to_numpy().view(np.uint64) for c in batch.columns))


def bloom(phrases: DataFrame) -> np.ndarray:
    """The filter of phrases of one size (hashes of their words); only its bits, a fixed number, come to the driver."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            marked[bits_of(row_hashes(batch)).ravel()] = True
        at = np.flatnonzero(marked)
        segments, starts = np.unique(at // SEGMENT_BITS, return_index=True)
        places = [part.astype("<u2").tobytes() for part in np.split(at % SEGMENT_BITS, starts[1:])] if len(at) else []
        yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(places, pa.binary())], names=["segment", "places"])

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        part = np.zeros(SEGMENT_BITS, np.uint8)
        for places in table.column("places"):
            part[np.frombuffer(places.as_py(), "<u2")] = 1
        return pa.table({"segment": [key[0].as_py()], "bits": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    marks = phrases.mapInArrow(positions, "segment long, places binary")
    for row in marks.groupBy("segment").applyInArrow(packed, "segment long, bits binary").collect():
        low = row["segment"] * SEGMENT_BITS // 8
        bits[low : low + SEGMENT_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def outside(phrases: DataFrame, bits: np.ndarray) -> int:
    """How many phrases a filter does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((~holds(bits, row_hashes(batch))).sum())], pa.int64())], names=["n"])

    return phrases.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def singles(counts: DataFrame) -> DataFrame:
    return counts.filter("h1 != 0 AND h2 = 0").select("h1")


def doubles(counts: DataFrame) -> DataFrame:
    return counts.filter("h2 != 0 AND h3 = 0").select("h1", "h2")


def named(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(grp, phrase, size, n) from counts by hashes; all words of a frequent phrase are frequent."""
    # a word holds no line end, so the last one in a name stands between group and word
    name = F.col("name").cast("string")
    parts = {"grp": F.regexp_replace(name, r"\n[^\n]*\z", ""), "word": F.substring_index(name, "\n", -1)}
    words = checkpoint(counts.filter("h1 != 0 AND h2 = 0").withColumns(parts).select("h1", "grp", "word", "n"))
    word = lambda k: words.select(F.col("h1").alias(f"h{k}"), F.col("word").alias(f"w{k}"))
    longer = checkpoint(counts.filter("h2 != 0").select("h1", "h2", "h3", "n"))
    longer = longer.join(words.select("h1", "grp", F.col("word").alias("w1")), "h1").join(word(2), "h2").join(word(3), "h3", "left")
    size = F.when(F.col("h3") == 0, 2).otherwise(3)
    tables = [
        totals.select(parts["grp"].alias("grp"), F.lit("").alias("phrase"), F.lit(0).alias("size"), "n"),
        words.select("grp", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n"),
        longer.select("grp", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), size.alias("size"), "n"),
    ]
    return checkpoint(reduce(DataFrame.unionByName, tables))


def frequent_phrases(
    docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, sample: float = SAMPLE, seed: int = 42,
) -> tuple[DataFrame, list[dict]]:
    """((grp, phrase, size, n), log): all phrases of 1 to 3 words that occur at least ``least`` times in their group, exactly.

    Size 0 has the number of all words of a group. The log has a row per full
    pass: failures of the border, words and pairs.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"), body.alias("text"))
    lowered = max(PROPOSED, int(least * sample))
    proposed = checkpoint(counted(texts.sample(False, sample, seed), None, seed).filter((F.col("n") >= lowered) & (F.col("h1") != 0)))
    passes = [(bloom(singles(proposed)), bloom(doubles(proposed)))]
    frequent = F.col("n") >= least
    first = checkpoint(counted(texts, passes, seed).filter(frequent | (F.col("h2") == 0)))
    if not first.filter("h1 != 0 AND h2 = 0").groupBy("h1").count().filter("count > 1").isEmpty():
        return frequent_phrases(docs, text, group, least, sample, seed + 1)
    found = first.filter(frequent & (F.col("h1") != 0))
    log: list[dict] = []
    while True:
        log.append({"words": outside(singles(found), passes[-1][0]), "pairs": outside(doubles(found), passes[-1][1])})
        if not any(log[-1].values()):
            return named(found, first.filter("h1 = 0")), log
        # all that is frequent so far joins what was proposed
        passes.append((passes[-1][0] | bloom(singles(found)), passes[-1][1] | bloom(doubles(found))))
        found = found.unionByName(checkpoint(counted(texts, passes, seed).filter(frequent)))


# ---- scores


def cuts(size: int) -> Column:
    """(k, first, rest) of a phrase of some words, cut after the first k."""
    words = F.split("phrase", " ")
    parts = [
        F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"), F.array_join(F.slice(words, k + 1, size - k), " ").alias("rest"))
        for k in range(1, size)
    ]
    return F.array(*parts)


def scored(found: DataFrame) -> DataFrame:
    """(grp, phrase, size, a, l, r, score): candidates with the lowest-scoring cut, ties to the shortest first part.

    The arithmetic is exact for counts below 10**15: products are decimals of 38 digits.
    """
    candidates = found.filter("size > 1").withColumnRenamed("n", "a")
    parts = F.when(F.col("size") == 2, cuts(2)).otherwise(cuts(3))
    cut = checkpoint(candidates.select("grp", "phrase", "size", "a", F.inline(parts)))
    known = lambda name, n: found.filter("size BETWEEN 1 AND 2").select("grp", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cut.join(known("first", "l"), ["grp", "first"]).join(known("rest", "r"), ["grp", "rest"])
    big = lambda name: F.col(name).cast("decimal(15,0)")
    both = both.withColumns({"a2": F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), "lr": big("l") * big("r")})
    both = both.withColumn("score", F.expr("a2 div lr"))
    best = both.groupBy("grp", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("best"))
    return best.select("grp", "phrase", "best.size", "best.a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame) -> DataFrame:
    """Without the phrases that stand inside a longer candidate which has at least half of their occurrences."""
    words = F.split("phrase", " ")
    inside = F.array(*(F.array_join(F.slice(words, k, MOST_WORDS - 1), " ") for k in range(1, 3)))
    longer = candidates.filter(F.col("size") == MOST_WORDS).select("grp", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("a").alias("whole"))
    most = longer.groupBy("grp", "phrase").agg(F.max("whole").alias("whole"))
    joined = candidates.join(most, ["grp", "phrase"], "left")
    return joined.filter("whole IS NULL OR 100 * whole < 50 * a").drop("whole")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, top: int = TOP, sample: float = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's best phrases of 2 and 3 words.

    Groups are cut to their best rows in ``SALTS`` parts first, so no task ranks
    more than ``SALTS * top`` rows of a group at the end.
    """
    found, _ = frequent_phrases(docs, text, group, least, sample)
    candidates = checkpoint(scored(found))
    kept = uncovered(candidates)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("rank") <= top)
    sizes = found.filter("size = 0").select("grp", F.col("n"))
    out = last.join(sizes, "grp")
    return out.select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
