"""Encoder, decoder, counts and packing against the libraries and exact rules."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from citespark.llm import bpe, packing, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "\n", "\t", "a", "the", "ing", "é", "ß", "中", "😀", "'s", "'ll", "12", "\x1c", "\x85", "!!", "---", "<|endoftext|>", "<|endof",
    "A", "́", "٣", "Ⅷ", "\x00", "a" * 40, "​", "ſ", "’", "_", "x.y",
]


@pytest.fixture(scope="module")
def texts(sf_dir):
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return made + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() + ["ab" * 30_000, "xyzzy" * 9_000]


@pytest.fixture(scope="module")
def expected(texts):
    library = Tokenizer.from_file(BYTE_BPE)
    return [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_backtracking_is_exact(texts, expected):
    encode, decode = bpe.coder(bpe.read_file(BYTE_BPE))
    library = Tokenizer.from_file(BYTE_BPE)
    for text, ids in zip(texts, expected):
        assert encode(text) == ids, text[:80]
        assert decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_packing_tokenizer_is_the_library(texts, expected):
    encode = packing.byte_tokenizer(BYTE_BPE)()
    assert [encode(t) for t in texts] == expected


def test_pair_table_agrees_with_merging():
    vocabulary = bpe.Vocabulary(bpe.read_file(BYTE_BPE))
    table, encoder = bpe.PairTable(vocabulary), bpe.Encoder(vocabulary)

    def merged(data: bytes) -> list[int]:
        ids = {b: i for i, b in vocabulary.bytes.items()}
        parts = [ids[bytes([b])] for b in data]
        while True:
            ranked = [(vocabulary.rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in vocabulary.rank]
            if not ranked:
                return parts
            _, k = min(ranked)
            parts[k : k + 2] = [ids[vocabulary.bytes[parts[k]] + vocabulary.bytes[parts[k + 1]]]]

    rng = random.Random(5)
    tokens = [i for i in vocabulary.bytes if i not in vocabulary.special.values()]
    for _ in range(400):
        a, b = rng.choice(tokens), rng.choice(tokens)
        data = vocabulary.bytes[a] + vocabulary.bytes[b]
        assert table[a, b] == (merged(data) == [a, b])
        assert encoder.encode(data) == merged(data)


def test_decoding_replaces_bad_utf8():
    _, decode = bpe.coder(bpe.read_file(BYTE_BPE))
    vocabulary = bpe.Vocabulary(bpe.read_file(BYTE_BPE))
    byte = {b: i for i, b in vocabulary.bytes.items()}
    ids = [byte[b"\xc3"], byte[b"a"], 50256]
    library = Tokenizer.from_file(BYTE_BPE)
    assert decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_digests_on_spark(spark, texts, expected):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["coded"] for r in bpe.round_trip(docs, BYTE_BPE).collect()}
    for i, (text, ids) in enumerate(zip(texts, expected)):
        assert rows[i]["n_tokens"] == len(ids) // 4
        assert rows[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_counts_are_stored_and_reused(spark, texts, tmp_path):
    texts = [t for t in texts if len(t) < 20_000]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer, cache = token_counts.Tokenizer(PIECES), str(tmp_path / "cache")
    docs = spark.createDataFrame([*enumerate(texts), (-1, texts[0]), (-2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_counts.token_counts(docs, tokenizer, cache).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["n_tokens"] == len(library.encode(text)) and rows[i]["n_bytes"] == len(text.encode())
    assert rows[-1]["n_tokens"] == rows[0]["n_tokens"] and rows[-2]["n_tokens"] == 0
    stored = token_counts.stored_counts(spark, cache, tokenizer)
    assert stored.count() == len({*texts, ""})
    more = docs.union(spark.createDataFrame([(-3, "quite new")], docs.schema))
    assert [r["content"] for r in token_counts.missing_contents(more, stored).collect()] == ["quite new"]
    other = token_counts.Tokenizer(BYTE_BPE)
    assert other.version != tokenizer.version and token_counts.stored_counts(spark, cache, other).count() == 0
    token_counts.token_counts(more, tokenizer, cache).collect()
    assert token_counts.stored_counts(spark, cache, tokenizer).count() == len({*texts, "", "quite new"})


def check_packing(rows, capacity):
    rows = rows.sort_values(["sequence_id", "offset"])
    within = rows.groupby("sequence_id")["length"]
    assert within.sum().max() <= capacity
    assert (rows["offset"] == within.cumsum() - rows["length"]).all()
    return rows["sequence_id"].nunique()


def test_pieces_and_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, packing.byte_tokenizer(BYTE_BPE), capacity=512, group_pieces=150).toPandas()
    used = check_packing(rows, 512)
    assert used <= -(-rows["length"].sum() // 512) * 1.03 + 1
    library = Tokenizer.from_file(BYTE_BPE)
    for r in docs.toPandas().itertuples():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows["doc_id"] == r.doc_id].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids)
        assert (own["length"].iloc[1:] == 512).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_bounds_never_exceed_the_optimum():
    def optimum(sizes, capacity):
        best = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= sizes[i]:
                    place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return best[0]

    rng = random.Random(11)
    reached = 0
    for _ in range(150):
        capacity = rng.choice([10, 12, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        lengths, counts = np.unique(np.array(sizes), return_counts=True)
        bound, best = packing.lower_bound(lengths, counts, capacity), optimum(sizes, capacity)
        assert bound <= best
        reached += bound == best
        where, offset = packing.best_fit(np.array(sizes), capacity)
        assert best <= where.max() + 1
        for number in set(where.tolist()):
            own = [(o, s) for o, s, w in zip(offset.tolist(), sizes, where.tolist()) if w == number]
            assert sum(s for _, s in own) <= capacity
            assert [o for o, _ in sorted(own)] == [sum(s for _, s in sorted(own)[:k]) for k in range(len(own))]
    assert reached > 120


def test_partitions_are_certified_by_their_own_bound(spark):
    """A certified partition offers one sequence at most, another all that have a gap; flags follow the bound."""
    rng = random.Random(4)
    sizes = [rng.choice([51, 50, 49, 34, 33, 20]) for _ in range(900)] + [rng.randint(1, 100) for _ in range(900)]
    pieces = spark.createDataFrame([(i, 0, 0, s, i) for i, s in enumerate(sizes)], packing.PIECES)
    rows = packing._packed(pieces, 6, 0, 100, 0).toPandas()
    rows["grp"] = rows["sequence_id"] // 2**32
    for _, group in rows.groupby("grp"):
        lengths, counts = np.unique(group["length"].to_numpy(), return_counts=True)
        used = group["sequence_id"].nunique()
        certified = used <= packing.lower_bound(lengths, counts, 100)
        assert (group["certified"] == certified).all()
        offered = group[group["offered"]]
        assert (offered["gap"] > 0).all()
        gaps = group[group["gap"] > 0]["sequence_id"].nunique()
        assert offered["sequence_id"].nunique() == (min(1, gaps) if certified else gaps)
    whole = packing.best_fit_packing(pieces, 100, 300).toPandas()
    assert check_packing(whole, 100) <= rows["sequence_id"].nunique() and len(whole) == len(sizes)


def test_every_threshold_counts():
    rng = np.random.default_rng(6)
    for _ in range(40):
        capacity = int(rng.integers(5, 200))
        lengths, counts = np.unique(rng.integers(1, capacity + 1, rng.integers(1, 60)), return_counts=True)
        best = 0
        for t in range(capacity // 2 + 1):
            parts = np.where(lengths > capacity - t, capacity, np.where(lengths < t, 0, lengths))
            best = max(best, -(-int((parts * counts).sum()) // capacity))
        assert packing.lower_bound(lengths, counts, capacity) >= best
