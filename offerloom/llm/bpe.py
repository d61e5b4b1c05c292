"""Byte-level BPE: an exact linear-time encoder and an offset-table decoder.

A text is cut into words by the vocabulary's split pattern. For each word an Aho-Corasick
automaton gives the longest token that starts at each byte; a walk takes the longest token
that is compatible with the one before it, and steps back to shorter tokens at dead ends.
Two neighbouring tokens are compatible if merging their joined bytes by rank would yield
exactly these two; such verdicts fill a pair table. A token sequence whose neighbours are all
compatible is the one that the merges give, so the result is exact.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ids_and_texts, slices, small_batches

#: Unicode's White_Space characters, and the split pattern of this vocabulary family.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Entries of a worker's caches before they start afresh; a bound on memory, not on results.
CACHE = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class Vocabulary:
    """Tokens, merges, the automaton, the pair table and the offset table of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        spelled = lambda s: bytes(letter[c] for c in s)
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for s, i in ids.items():
            self.tokens[i] = spelled(s)
        # Order of making: bytes first, then merges by rank. All comparisons are in this order.
        self.made_of: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.order = [-1] * size
        made = 0
        for i in ids.values():
            if len(self.tokens[i]) == 1:
                self.order[i], made = made, made + 1
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            new = ids[a + b]
            self.pair[ids[a], ids[b]] = new
            if self.order[new] < 0:
                self.order[new], made = made, made + 1
                self.made_of[new] = (ids[a], ids[b])
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.compatible: dict[int, bool] = {}
        usable = [i for i in ids.values() if self.order[i] >= 0]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        by_bytes = self.whole = {self.tokens[i]: i for i in usable}
        self.shorter = [-1] * size
        for i in usable:
            t = self.tokens[i]
            self.shorter[i] = next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1)
        self.length = [len(t) for t in self.tokens]
        # Decoding: token i is bytes starts[i] to starts[i + 1] of one blob.
        self.starts = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _judge(self, a: int, b: int) -> bool:
        """Would the bytes of a and b together be merged into exactly (a, b)? Undo the later
        of the two innermost tokens step by step; a merge across the seam that comes before
        the undone one would have happened first."""
        order, made_of, pair = self.order, self.made_of, self.pair
        deadline = len(order)
        while True:
            across = pair.get((a, b))
            if across is not None and order[across] < deadline:
                return False
            can_a, can_b = a in made_of, b in made_of
            if not can_a and not can_b:
                return True
            # On equal rank the left one is merged first, so the right one is undone first.
            if can_a and (not can_b or order[a] > order[b]):
                deadline, a = order[a], made_of[a][1]
            else:
                deadline, b = order[b] + 1, made_of[b][0]

    def fits(self, a: int, b: int) -> bool:
        if len(self.compatible) >= 4 * CACHE:
            self.compatible.clear()
        known = self.compatible[a << 32 | b] = self._judge(a, b)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word of the split pattern."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        n, size, table = len(word), self.length, self.compatible
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(word.decode("latin-1")):  # by end, so the longest of a start is set last
            longest[end + 1 - size[token]] = token
        out: list[int] = []
        dead, pos, token, last = set(), 0, longest[0], -1
        while pos < n:
            if token < 0:  # no way on from here: take the last token back and try its shorter ones
                if last < 0:
                    raise ValueError("a byte of the text is not in the vocabulary")
                dead.add(pos)
                token = out.pop()
                pos -= size[token]
                token, last = self.shorter[token], out[-1] if out else -1
                continue
            if last >= 0:
                known = table.get(last << 32 | token)
                if not (self.fits(last, token) if known is None else known):
                    token = self.shorter[token]
                    continue
            if dead and pos + size[token] in dead:
                token = self.shorter[token]
                continue
            out.append(token)
            pos += size[token]
            last, token = token, longest[pos]
        return out

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids end to end, and n + 1 offsets of the ids in them."""
        ids = ids.astype(np.int64)
        first, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.blob[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


class _Odd(Exception):
    """A piece that starts with white space: the text must be cut with care."""


class Encoder:
    """Encodes texts to little-endian 32-bit ids.

    A space before a character that is not white space always starts a word, so a text can be
    cut there and the pieces looked up in a bounded cache. ``of_piece`` gives the ids of a
    piece that is not cached; without it each word goes through the backtracking encoder.
    """

    def __init__(self, path: str, of_piece=None):
        if of_piece is None:
            self.vocabulary = Vocabulary(path)
            self.special = self.vocabulary.special
            self._words: dict[str, bytes] = {}
            of_piece = self._backtrack
        else:
            with open(path, encoding="utf-8") as f:
                self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self._of_piece = of_piece
        self._find = regex.compile(SPLIT).findall
        self._cut = regex.compile(rf" (?=[^{WHITE}])").split
        self._specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else None
        encoder = self

        class Pieces(dict):
            """Two generations: what was used lately moves on, the rest is dropped."""

            older: dict = {}

            def __missing__(self, piece: str) -> bytes:
                if not piece or piece[0].isspace():
                    raise _Odd
                found = self.older.get(piece)
                if found is None:
                    found = encoder._of_piece(" " + piece)
                if len(self) >= CACHE:
                    self.older = dict(self)
                    self.clear()
                if len(piece) < 64:
                    self[piece] = found
                return found

        self._pieces = Pieces()

    def _backtrack(self, piece: str) -> bytes:
        out = b""
        for word in self._find(piece):
            found = self._words.get(word)
            if found is None:
                if len(self._words) >= CACHE:
                    self._words.clear()
                found = pack(f"<{len(ids := self.vocabulary.encode_word(word.encode()))}I", *ids)
                if len(word) < 64:
                    self._words[word] = found
            out += found
        return out

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            # An empty first piece means a leading space; then the careful way is taken below.
            if first and not first[-1:].isspace():
                return self._of_piece(first) + b"".join(map(self._pieces.__getitem__, rest))
        except _Odd:
            pass
        first, *rest = self._cut(text)
        out = [self._of_piece(first)] if first else []
        for piece in rest:
            found = self._pieces.get(piece)
            out.append(self._of_piece(" " + piece) if found is None else found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self._specials is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self._specials(text))


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of ids and of the decoded text; one row per document, no shuffle.

    Null texts count as empty (no tokens). Repeated rows and any other columns pass no
    influence; an empty table gives an empty result. ``ids`` holds the ids themselves.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                coded = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                n = np.array([len(c) // 4 for c in coded], np.int64)
                data, ends = encoder.vocabulary.decode_bytes(np.frombuffer(b"".join(coded), "<u4"))
                whole = data.tobytes()
                edges = ends[np.concatenate([[0], np.cumsum(n)])].tolist()
                texts = [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                coded = [np.frombuffer(encoder.encode(t or ""), "<u4").astype(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coded, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every row of ``encode``'s result."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary(vocabulary)
        for batch in batches:
            texts = [table.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
