"""Byte-level BPE: a backtracking encoder with exact merges and an offset-table decoder.

The encoder never replays merges. Aho-Corasick finds every vocabulary token in a
word; the encoder takes the longest token at each position that is compatible
with the token before it, and steps back to a shorter token, or to the previous
position, where none is. A table of pairs says whether two tokens may stand side
by side in an encoded text, that is, whether no merge would have crossed their
boundary. A sequence whose neighbours are all compatible is the sequence that
merging gives, so the result is exact, and each position of a word is refused at
most once, so the time is linear in its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import text_udf
from citespark.llm.tokens import once_per_worker, text_encoder

#: The splitting pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that the pattern splits into letters and marks; the others go through the pattern.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
NEVER = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in own}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
    return table


class Vocabulary:
    """Token bytes, merge ranks and special strings of a ``tokenizers`` BPE file."""

    def __init__(self, content: str):
        data = json.loads(content)
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {i: s.encode() for s, i in self.special.items()}
        for name, i in data["model"]["vocab"].items():
            if i not in self.bytes:
                self.bytes[i] = bytes(symbols[c] for c in name)
        ids = data["model"]["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for order, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, whole = ids[a], ids[b], ids[a + b]
            self.rank[x, y] = order
            if whole not in self.halves:
                self.halves[whole], self.born[whole] = (x, y), order


class PairTable(dict):
    """(left, right) -> may the two tokens be neighbours; entries are worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def __missing__(self, pair: tuple[int, int]) -> bool:
        # Undo the merges on both sides of the boundary, the latest first. At every stage two
        # tokens face each other; they would have merged if their merge comes before the one that
        # ended the left one, and not after the one that ended the right one (ties go left to right).
        v, (x, y) = self.v, pair
        rank, halves, born = v.rank, v.halves, v.born
        x_ends = y_ends = NEVER
        verdict = True
        while True:
            merge = rank.get((x, y))
            if merge is not None and merge < x_ends and merge <= y_ends:
                verdict = False
                break
            x_born, y_born = born.get(x, -1), born.get(y, -1)
            if x_born < 0 and y_born < 0:
                break
            if x_born > y_born:
                x, x_ends = halves[x][1], x_born
            else:
                y, y_ends = halves[y][0], y_born
        self[pair] = verdict
        return verdict


class Encoder:
    """Words to token ids by longest matches with backtracking."""

    def __init__(self, vocabulary: Vocabulary):
        self.pairs = PairTable(vocabulary)
        tokens = {i: b for i, b in vocabulary.bytes.items() if i not in vocabulary.special.values()}
        self.whole = {b.decode("latin-1"): i for i, b in tokens.items()}
        self.size = [0] * (max(tokens) + 1)
        self.shorter = [-1] * (max(tokens) + 1)  # the longest token that is a proper prefix
        self.automaton = ahocorasick.Automaton()
        for word, i in self.whole.items():
            self.automaton.add_word(word, i)
            self.size[i] = len(word)
            cut = len(word) - 1
            while cut and word[:cut] not in self.whole:
                cut -= 1
            self.shorter[i] = self.whole[word[:cut]] if cut else -1
        self.automaton.make_automaton()

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one word (bytes)."""
        word = data.decode("latin-1")
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        pairs, tokens, last = self.pairs, [], -1
        for _, token in self.automaton.iter_long(word):  # longest matches, left to right
            if last >= 0 and not pairs[last, token]:
                return self.backtrack(word, tokens, token)
            tokens.append(token)
            last = token
        return tokens

    def longest_tokens(self, word: str) -> Callable[[int], int]:
        """Position -> longest token there. Long words are searched once; for short ones a search per position is cheaper."""
        if len(word) <= 32:
            search = self.automaton.iter_long
            return lambda at: next(search(word, at))[1]
        found, size = [0] * len(word), self.size
        for end, token in self.automaton.iter(word):
            found[end - size[token] + 1] = token  # of the tokens at a position the longest ends last
        return found.__getitem__

    def backtrack(self, word: str, tokens: list[int], token: int) -> list[int]:
        """Continues after compatible ``tokens`` from a ``token`` that does not go with the last of them."""
        pairs, size, shorter = self.pairs, self.size, self.shorter
        n, at = len(word), sum(size[t] for t in tokens)
        longest = self.longest_tokens(word)
        open_at = bytearray(b"\x01") * (n + 1)  # 0: no valid sequence continues from here
        last = tokens[-1]
        while True:
            while token >= 0 and not (open_at[at + size[token]] and (last < 0 or pairs[last, token])):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                last = token
                at += size[token]
                if at >= n:
                    return tokens
                token = longest(at)
            elif tokens:
                open_at[at] = 0
                dropped = tokens.pop()
                at -= size[dropped]
                last = tokens[-1] if tokens else -1
                token = shorter[dropped]
            else:
                raise ValueError("the vocabulary lacks a byte of this word")


def encoder_of(vocabulary: Vocabulary) -> Callable[[str], bytes]:
    """text -> ids as little-endian unsigned 32-bit integers."""
    words, find, simple = Encoder(vocabulary).encode, regex.compile(PATTERN).findall, SIMPLE.fullmatch

    def piece_ids(piece: str) -> list[int]:
        match = simple(piece)
        if match is None:
            return [i for w in find(piece) for i in words(w.encode())]
        word, marks = match.groups()
        return words(word.encode()) + words(marks.encode()) if marks else words(word.encode())

    return text_encoder(piece_ids, vocabulary.special)


def decoder_of(vocabulary: Vocabulary) -> Callable[[bytes], str]:
    """ids -> text by a table of token bytes and offsets; special tokens are kept, bad UTF-8 is replaced."""
    size = max(vocabulary.bytes) + 1
    parts = [vocabulary.bytes.get(i, b"") for i in range(size)]
    offsets = np.zeros(size + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    table = np.frombuffer(b"".join(parts), np.uint8)

    def decode(ids: bytes) -> str:
        out = []
        for low in range(0, len(ids), 1 << 20):
            part = np.frombuffer(ids[low : low + (1 << 20)], "<u4")
            lengths = offsets[part + 1] - offsets[part]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[part] - ends + lengths, lengths)
            out.append(table[places].tobytes())
        return b"".join(out).decode("utf-8", errors="replace")

    return decode


def coder(content: str) -> tuple[Callable[[str], bytes], Callable[[bytes], str]]:
    """Encoder and decoder of a vocabulary file's content; a worker makes them once."""

    def make():
        vocabulary = Vocabulary(content)
        return encoder_of(vocabulary), decoder_of(vocabulary)

    return once_per_worker(("coder", hashlib.sha256(content.encode()).hexdigest()), make)


def read_file(path: str) -> str:
    """A tokenizer file's content, read once on the driver (a few MB); it travels with the job."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of each whole text (binary, little-endian unsigned 32-bit); NULL encodes as ''."""
    content = read_file(path)

    def make():
        encode, _ = coder(content)
        return lambda texts: [encode(t) for t in texts]

    return docs.withColumn(out, text_udf("binary", make)(F.col(text)))


def decode_ids(table: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of each row's ids; NULL ids stay NULL."""
    content = read_file(path)

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, work = coder(content)
        for series in parts:
            yield series.map(lambda x: None if x is None else work(bytes(x)))

    return table.withColumn(out, decode(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: n_tokens, ids_sha256 and decoded_sha256 of every text beside ``docs``' columns.

    The columns appear in the struct ``coded``; ids and texts stay inside the task.
    """
    content = read_file(path)

    def make():
        encode, decode = coder(content)

        def work(texts: list) -> dict:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                ids = encode(t)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decode(ids).encode()).hexdigest())
            return out

        return work

    fields = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"
    return docs.withColumn("coded", text_udf(fields, make)(F.col(text)))
