"""Merkle manifest, archives with merged index and phrase mining against brute force."""

import gzip
import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import TEXTS, edge_docs  # noqa: E402

from citespark.llm import merkle, phrases, warc  # noqa: E402

# ---- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row[f] for f in merkle.FIELDS[:-1]] + [text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_manifest(rows):
    """The expected rows, by lists."""
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    trees = {}
    for row in rows:
        leaf = plain_leaf(row, row["text"])
        tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
        other = plain_leaf(row, row["text"].translate(lower)) if tampered and row["text"] is not None else leaf
        key = (row["doc_id"] is not None, row["doc_id"] or 0, leaf)
        trees.setdefault(row["lang"], []).append((key, row["doc_id"], leaf, other))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {name: plain_levels([leaf for _, _, leaf, _ in sorted(trees[name])]) for name in names}
    upper = plain_levels([levels[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for rank, (_, doc_id, leaf, other) in enumerate(sorted(trees[name])):
            proof, fold = "", other
            for tree, start in ((levels[name], rank), (upper, at)):
                for nodes in tree[:-1]:
                    low = start // 8 * 8
                    before, after = "".join(nodes[low:start]), "".join(nodes[start + 1 : low + 8])
                    proof, fold, start = proof + before + after, sha(before + fold + after), start // 8
            root = upper[-1][0]
            out.append((doc_id, leaf, levels[name][-1][0], root, sha(proof), fold, fold == root))
    return out


def rows_of(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, rank string, tree string, digest string, item string"
    return spark.createDataFrame([(*r, "z", "z", "z", "z") for r in rows], schema)


def check_manifest(spark, rows):
    docs = rows_of(spark, rows)
    got = sorted((tuple(r) for r in merkle.verified_manifest(docs).collect()), key=repr)
    want = plain_manifest([dict(zip(merkle.FIELDS, (i, s, lang, n, t))) for i, s, lang, n, t in rows])
    assert got == sorted(want, key=repr)
    return got


def test_manifest_is_brute_force(spark):
    rng = random.Random(3)
    sizes = {"en": 530, "de": 64, "fr": 9, "es": 8, None: 3, "x": 1, "ä": 1, **{f"l{i}": 1 for i in range(5)}}
    rows = [(rng.randrange(10**6), rng.choice(["web", None, "Bücher"]), lang, rng.randrange(99), f"Text {i} Ä B")
            for lang, n in sizes.items() for i in range(n)]
    got = check_manifest(spark, rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("lang", [None, "en"])
def test_one_group(spark, lang):
    for n in (1, 2, 8, 9, 65):
        check_manifest(spark, [(i, "s", lang, 1, "Some Text") for i in range(n)])


def test_manifest_edges(spark):
    rows = [(1, None, "en", None, None), (1, None, "en", None, ""), (None, "s", "en", 2, "A"), (None, None, None, None, None)]
    rows += [(7, "s", "en", 1, "Same Row")] * 40 + [(2, "s", "", 5, "x" * 200_000 + "É")]
    check_manifest(spark, rows)
    assert merkle.verified_manifest(rows_of(spark, rows).limit(0)).collect() == []


def test_changed_row_changes_the_root(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(20)]
    root = lambda r: {x["root"] for x in merkle.verified_manifest(rows_of(spark, r)).collect()}
    assert root(rows) == root(rows[::-1]) != root([*rows[:-1], (19, "s", "en", 1, "T19")])


# ---- archives

CRLF = "\r\n"
TRAP = f"a{CRLF}{CRLF}WARC/1.1{CRLF}WARC-Type: response{CRLF}Content-Length: 5{CRLF}{CRLF}hello{CRLF}{CRLF}" + "z" * 100
PAGES = [
    (1, "http://www.Example.com/B?x=1", "short"), (2, "http://www.example.com/b?x=1", "short"), (3, None, None), (4, "http://a.org", ""),
    (9, "https://news.example.com:8080/x", "ä" * 100), (5, "http://news.example.com/x", "ä" * 100), (7, "http://e.com/", "ä" * 100),
    (6, "http://e.com/\r\nWARC-Type: metadata", TRAP), (8, "http://[bad", TRAP), (10, "http://e.com/", "y" * 99), (11, "http://e.com/", "y" * 99),
    (12, "http://e.com/", "y" * 100), (13, "http://e.com/", "y" * 100), (None, "http://e.com/", "y" * 100), (14, "http://f.com/", "\x00<html>\n" * 50_000),
]


def pages_of(spark):
    return spark.createDataFrame([(i, u, h, "z", "z") for i, u, h in PAGES], "page_id long, url string, html string, digest string, n_bytes string")


def expected(pages):
    first = {}
    for page_id, _, html in pages:
        if html and len(html.encode()) >= 100 and page_id is not None:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        to = first.get(html)
        raw = (html or "").encode()
        revisit = to is not None and to != page_id
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_round_trip(spark, tmp_path, compression):
    folder = str(tmp_path / "warc")
    warc.write_archives(pages_of(spark).repartition(4), folder, compression=compression)
    found = warc.captures(spark, folder).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=repr) == expected(PAGES)
    assert all(r["intact"] for r in found)
    whole = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.payloads(spark, folder).collect()}
    assert whole == {(i, h or "") for i, _, h in PAGES}
    assert found == sorted(found, key=lambda r: warc.order_key(r.asDict()))


def test_offsets_point_at_records(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_archives(pages_of(spark), folder)
    for row in warc.captures(spark, folder).collect():
        with open(f"{folder}/{row['archive']}", "rb") as file:
            file.seek(row["offset"])
            record = file.read(row["length"])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert f"sha256:{row['payload_digest']}".encode() in record


def test_histories_by_time(spark, tmp_path):
    folder = str(tmp_path / "warc")
    rows = [(i, f"http://h{i % 3}.org/p", f"body {i}", f"2024-01-{1 + i * 7 % 28:02d} 10:00:00") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at string")
    warc.write_archives(pages.repartition(5), folder, captured=F.to_timestamp("at"))
    runs = warc.capture_runs(spark, folder, rows=4)
    assert runs.select("run").distinct().count() >= 15
    got = [(r["url_key"], r["captured"], r["page_id"]) for r in warc.merged(runs, rows=10).collect()]
    assert got == sorted((f"org,h{i % 3})/p", f"2024-01-{1 + i * 7 % 28:02d}T10:00:00Z", i) for i in range(60))


def test_damaged_and_empty_archives(spark, tmp_path):
    folder = tmp_path / "warc"
    warc.write_archives(pages_of(spark).coalesce(1), str(folder))
    part = next(p for p in folder.iterdir() if p.name.startswith("part-"))
    data = part.read_bytes()
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "part-0.warc").write_bytes(data[:-30])
    (cut / "part-1.warc").write_bytes(b"no archive")
    (cut / "part-2.warc.gz").write_bytes(gzip.compress(data[:400]) + b"junk")
    (cut / "part-3.warc").write_bytes(b"")
    half = data.find(b"WARC/1.1", 10)
    (cut / "part-4.warc.gz").write_bytes(gzip.compress(data[:half]) + gzip.compress(data[half : data.find(b"WARC/1.1", half + 10)]))
    kinds = Counter((r["archive"], r["record_type"]) for r in warc.captures(spark, str(cut)).collect())
    assert kinds["part-0.warc", "damaged"] == 1 and kinds["part-1.warc", "damaged"] == 1 and kinds["part-2.warc.gz", "damaged"] >= 1
    assert sum(n for (a, _), n in kinds.items() if a == "part-0.warc") == len(PAGES)
    assert kinds["part-4.warc.gz", "response"] + kinds["part-4.warc.gz", "revisit"] == 2 and not kinds["part-4.warc.gz", "damaged"]
    none = str(tmp_path / "none")
    warc.write_archives(pages_of(spark).limit(0), none)
    assert warc.captures(spark, none).collect() == []


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(12))) for _ in range(k)]
    got = list(warc.loser_tree([iter(r) for r in runs]))
    assert got == sorted((key, i) for i, r in enumerate(runs) for key in r) or [(key, i) for i, key in got] == sorted((key, i) for i, r in enumerate(runs) for key in r)


def test_url_keys():
    keys = [warc.url_key(u) for u in ("HTTP://WWW.Example.com:80/A?B", "https://example.com/a?b#c", None, "", "http://h.org", "x y")]
    assert keys == ["com,example)/a?b", "com,example)/a?b", "", "", "org,h)/", ")x y"]


# ---- phrases


def plain_phrases(rows, least=10, top=2000):
    counts, totals = Counter(), Counter()
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang or "und", tuple(words[i : i + size])] += 1
    best = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            score, k = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            best[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])
    covered = set()
    for (lang, p), row in best.items():
        for sub in (p[:2], p[1:]) if len(p) == 3 else ():
            if (lang, sub) in best and 100 * row[1] >= 50 * best[lang, sub][1]:
                covered.add((lang, sub))
    out = []
    for lang in totals:
        ranked = sorted(((-s, -a, " ".join(p).encode(), le, r) for (g, p), (s, a, le, r) in best.items() if g == lang and (g, p) not in covered))
        out += [(lang, i + 1, p.decode(), -a, le, r, totals[lang], -s) for i, (s, a, p, le, r) in enumerate(ranked[:top])]
    return sorted(out)


def random_texts(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Über", "naïve", "WORD", "a'b", " x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        line = rng.choices(words, weights, k=rng.randrange(120))
        text = "".join(w + rng.choice([" "] * 12 + [". ", ",", "\n", "\t", "  ", "!? ", "\r\n"]) for w in line)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(g, t, "z", "z") for g, t in rows], "lang string, text string, grp string, n string").repartition(4)


def got_phrases(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def test_group_names_with_line_ends(spark):
    rows = [("a\nb", "one two three"), ("a", "one two"), ("\n", "one two")] * 12
    assert got_phrases(frame(spark, rows)) == plain_phrases(rows)


@pytest.mark.parametrize("sample", [0.1, 1.0])
def test_phrases_are_brute_force(spark, sample):
    rows = random_texts(1, 250)
    assert got_phrases(frame(spark, rows), sample=sample, top=50) == plain_phrases(rows, top=50)


def test_border_failures_are_counted(spark):
    """A sample that sees nothing leaves all to the border and to further passes; results do not change."""
    rows = random_texts(2, 200)
    found, log = phrases.frequent_phrases(frame(spark, rows), sample=1e-9)
    assert log[0]["words"] > 0 and len(log) == 3 and log[1]["pairs"] > 0 and log[-1] == {"words": 0, "pairs": 0}
    whole, once = phrases.frequent_phrases(frame(spark, rows), sample=1.0)
    assert once == [{"words": 0, "pairs": 0}]
    key = lambda df: sorted(tuple(r) for r in df.select("grp", "phrase", "size", "n").collect())
    assert key(found) == key(whole)


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(phrases, "PROPOSED", 1)
    rows = random_texts(3, 150, vocabulary=400)
    assert got_phrases(frame(spark, rows)) == plain_phrases(rows)


def test_chunks_cut_texts(monkeypatch):
    """Texts cut at any place and chunks of any size give the same counts."""
    text = " ".join(t for _, t in random_texts(4, 20)).encode().translate(phrases._TABLE)
    everything = np.full(phrases.FILTER_BITS // 8, 255, np.uint8)

    def counts():
        chunk, total = phrases.Chunk([(everything, everything)], 1), Counter()
        for batch in [*chunk.add("g", text), *chunk.add("h", b"a b a b a"), *chunk.counts()]:
            for row in batch.to_pylist():
                total[row["h1"], row["h2"], row["h3"], row["name"]] += row["n"]
        return total

    want = counts()
    assert want[0, 0, 0, b"h\n"] == 5 and len(want) > 500
    for size in (1, 7, 60, 1000):
        monkeypatch.setattr(phrases, "CHUNK", size)
        assert +counts() == +want


def test_equal_hashes_start_again(spark, monkeypatch):
    """Two words with one hash are found by the first pass."""
    rows = [("en", "one two. one three. two three")] * 12
    plain = phrases.xxhash.xxh64_intdigest

    class Weak:
        @staticmethod
        def xxh64_intdigest(data, seed=0):
            if seed == plain("en", seed=42):
                return 5 if data in (b"one", b"two") else plain(data, seed=seed)
            return plain(data, seed=seed)

    monkeypatch.setattr(phrases, "xxhash", Weak)
    chunk = phrases.Chunk(None, 42)
    list(chunk.add("en", b"one two"))
    first = [row["h1"] for batch in chunk.counts() for row in batch.to_pylist() if row["name"] and row["h1"]]
    assert first == [5, 5]
    assert got_phrases(frame(spark, rows)) == plain_phrases(rows)


def test_phrase_edges(spark):
    docs = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert got_phrases(docs) == plain_phrases([(None, t) for _, t in TEXTS])
    assert got_phrases(docs.limit(0)) == []
    rows = [("en", "same three words")] * 500 + [("en", "x " * 30_000)] + [("de", " \t\n")]
    assert got_phrases(frame(spark, rows)) == plain_phrases(rows)


def test_large_counts_stay_exact(spark):
    a, l, r = 987_654_321_012_345, 998_877_665_544_332, 987_654_321_012_399
    found = spark.createDataFrame([("g", "x", 1, l), ("g", "y", 1, r), ("g", "x y", 2, a)], "grp string, phrase string, size int, n long")
    assert phrases.scored(found).first()["score"] == 1_000_000 * a * a // (l * r)
