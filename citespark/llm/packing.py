"""Best-fit packing with certified repacking.

Documents become token pieces of at most ``capacity``. Partitions of bounded size
pack their pieces by best-fit decreasing. Dual-feasible functions give a lower
bound on the number of sequences of each partition, computed in the task that
packs it, and of the whole table. A partition that needs no more than its bound is
certified: no packing of its pieces alone is better, and it offers only its
emptiest sequence to others. Partitions above their bound offer every sequence with
a gap. While the whole table is above its bound, what is offered is dealt to new
partitions, so partitions exchange documents, and packed once more. A round whose
count does not fall is discarded; after it every sequence with a gap is offered,
certified or not, as long as that gains.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.bpe import PATTERN, Vocabulary, coder, read_file
from citespark.llm.common import checkpoint, map_rows
from citespark.llm.tokens import once_per_worker, text_encoder

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 2000
ROUNDS = 8
LONG_PIECE = 256
#: Sequences with at least this share of room left are opened for the exchange.
OPEN_SHARE = 0.005
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_tokenizer(path: str) -> Callable[[], Callable[[str], bytes]]:
    """A factory of text -> ids for tasks, from a byte-level ``tokenizers`` file; its content travels with the job.

    ids are those of the ``tokenizers`` library. Pieces not seen before are merged
    by ``tiktoken`` over the same vocabulary, where ids and merge order agree (they
    do in the public file), because that library is several times faster.
    """
    content = read_file(path)

    def load() -> Callable[[str], bytes]:
        from tiktoken import Encoding

        vocabulary = Vocabulary(content)
        order = [whole for _, whole in sorted((when, whole) for whole, when in vocabulary.born.items())]
        if order == sorted(order):
            ranks = {b: i for i, b in vocabulary.bytes.items() if i not in vocabulary.special.values()}
            short = Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            def merge(piece: str) -> list[int]:
                # its merging takes quadratic time in a piece; the backtracking encoder stays linear
                return short(piece) if len(piece) <= LONG_PIECE else list(array("I", coder(content)[0](piece)))
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(content)
            merge = lambda piece: library.encode(piece, add_special_tokens=False).ids
        return text_encoder(merge, vocabulary.special)

    return lambda: once_per_worker(("packing", path), load)


def token_pieces(
    docs: DataFrame, tokenizer: Callable[[], Callable[[str], bytes]], doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of every document: ids and one ``end_id``; longer documents are cut, the first piece takes the rest."""

    def make():
        encode, end = tokenizer(), np.array([end_id], dtype="<u4").tobytes()

        def work(ids: list, texts: list) -> list:
            out = [[], [], [], [], []]
            for i, t in zip(ids, texts):
                data = (encode(t) if t else b"") + end
                n = len(data) // 4
                low, number = 0, 0
                high = n % capacity or min(capacity, n)
                while low < n:
                    row = (i, number, low, high - low, zlib.crc32(data[4 * low : 4 * high]))
                    for column, value in zip(out, row):
                        column.append(value)
                    low, high, number = high, high + capacity, number + 1
            return out

        return work

    return map_rows(docs.select(F.col(doc_id).cast("long"), text), PIECES, make)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing of these pieces has fewer sequences: the largest bound of a family of dual-feasible functions.

    u_k rounds a size to k-ths (sizes on the grid stay), f_t drops sizes below t
    and lifts those above capacity - t to a whole sequence. Each maps every set
    of sizes that fits a sequence to a sum of at most 1, so sums over all pieces
    are bounds.
    """
    if not len(lengths):
        return 0
    w, n, c = lengths.astype(np.int64), counts.astype(np.int64), int(capacity)
    best = -(-int((w * n).sum()) // c)
    for k in range(1, 17):
        grid = (k + 1) * w
        parts = np.where(grid % c == 0, w * k, (grid // c) * c)  # u_k(w) * k * c
        best = max(best, -(-int((parts * n).sum()) // (k * c)))
    # f_t for every threshold at once, from running sums over the sizes
    order = np.argsort(w, kind="stable")
    w, n = w[order], n[order]
    pieces, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(w * n)])
    t = np.unique(np.minimum(w, c - w))
    low, high = np.searchsorted(w, t, "left"), np.searchsorted(w, c - t, "right")
    sums = (pieces[-1] - pieces[high]) * c + np.maximum(tokens[high] - tokens[low], 0)
    return max(best, -(-int(sums.max()) // c))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece: longest first, each into the fullest sequence that takes it."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by room left
    some, made = 0, 0  # bit r: a sequence with room r exists
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, number, made = capacity, made, made + 1
        where[i], offset[i] = number, capacity - room
        rest = room - size
        if rest:
            if not rooms[rest]:
                some |= 1 << rest
            rooms[rest].append(number)
    return where, offset


def _packed(pieces: DataFrame, groups: int, first: int, capacity: int, seed: int) -> DataFrame:
    """Pieces with sequence_id, offset, the room of their sequence and whether their group offers it to others.

    One task packs a group of bounded size and certifies it by its own lower bound.
    """
    columns = PIECES + ", sequence_id long, offset long, gap long, certified boolean, offered boolean"
    least = max(1, int(capacity * OPEN_SHARE))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], kind="stable", ignore_index=True)
        where, offset = best_fit(pdf["length"].to_numpy(), capacity)
        filled = np.bincount(where, weights=pdf["length"].to_numpy()).astype(np.int64)
        pdf["sequence_id"] = where + (np.int64(first + number) << 32)
        pdf["offset"], pdf["gap"] = offset, capacity - filled[where]
        certified = len(filled) <= lower_bound(*np.unique(pdf["length"].to_numpy(), return_counts=True), capacity)
        gaps = capacity - filled
        offered = gaps >= least
        if certified:
            offered &= np.arange(len(gaps)) == gaps.argmax()
        pdf["certified"], pdf["offered"] = certified, offered[where]
        return pdf.drop(columns="grp")

    dealt = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed))
    keyed = pieces.withColumn("grp", F.pmod(dealt, F.lit(groups)).cast("long"))
    return keyed.groupBy("grp").applyInPandas(run, columns)


def _histogram(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by length: at most ``capacity`` rows, whatever the size of the table."""
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    return np.array([r["length"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def best_fit_packing(
    pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, gapless from 0.

    ``pieces`` has doc_id, piece, start, length, ids_crc32, lengths from 1 to
    ``capacity``. Whole-length pieces are sequences of their own and leave no
    gap. ``group_pieces`` bounds what one task packs. Repeated rows are packed
    as often as they occur; ties go by crc and id.
    """
    pieces = checkpoint(pieces)
    lengths, counts = _histogram(pieces)
    if not len(lengths):
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    bound = lower_bound(lengths, counts, capacity)
    used = lambda n: max(1, -(-int(n) // group_pieces))
    groups = used(counts.sum())
    result = checkpoint(_packed(pieces, groups, 0, capacity, 0))
    first = groups
    sequences = result.filter("offset = 0").count()
    opened, wide = F.col("offered"), False
    for seed in range(1, rounds):
        if sequences <= bound:
            break
        before, rows = result.filter(opened).agg(F.count(F.when(F.col("offset") == 0, 1)), F.count("*")).first()
        if before >= 2:
            # rows of a pool are few: smaller groups would leave a gap each
            groups = used(rows)
            pool = result.filter(opened).drop("sequence_id", "offset", "gap", "certified", "offered")
            again = checkpoint(_packed(pool, groups, first, capacity, seed))
            first += groups
            after = again.filter("offset = 0").count()
            if after < before:
                sequences -= before - after
                result = result.filter(~opened).unionByName(again)
                continue
        if wide:
            break
        # what certificates leave closed may still gain across partitions
        wide, opened = True, F.col("gap") >= max(1, int(capacity * OPEN_SHARE))
    return result.drop("gap", "certified", "offered")


def pack_documents(docs: DataFrame, tokenizer, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Every document's pieces in as few sequences as found; NULL texts are empty ones and hold the end id only."""
    capacity = limits.get("capacity", CAPACITY)
    return best_fit_packing(token_pieces(docs, tokenizer, doc_id, text, capacity), **limits)
