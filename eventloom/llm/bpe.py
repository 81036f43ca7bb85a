"""Byte-level BPE, encoding and decoding, by replay of the merges over a corpus.

A task gathers the distinct words of a slab of documents that it has not met in slabs before. An inverted index from token
pair to positions in those words is walked in rank order: each merge applies to all its places at once, and only the pairs
with the merged tokens' new neighbours are indexed again. Documents are then rows of word numbers, and their ids a gather
from the words' tokens. Known words are forgotten at a number of tokens, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import text_slabs

#: Bytes of text whose new words are replayed together.
SLAB = 2_000_000
#: Tokens of known words at which a task forgets them all and begins anew.
KNOWN = 1_000_000


class Vocabulary:
    """Ranks as pairs: (left, right) -> merged, and the bytes of every token."""

    def __init__(self, lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.of_byte = np.zeros(256, np.int64)
        for b in range(256):
            self.of_byte[b] = ranks[bytes([b])]
        # every pair of tokens whose joined bytes are a token merges at that token's rank
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.keys, self.merged = key[order], np.array(out, np.int64)[order]

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of every pair, -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(path: str) -> Vocabulary:
    with open(path, "rb") as f:  # a file of the installation, on every machine
        return Vocabulary(f.read())


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, one after another, and where each word's tokens start (one more entry than words).

    Tokens live at the position of their first byte; ``after`` links to the next token of the word and ``before`` to the
    last one, -1 at its ends.
    """
    size = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    token = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = size > 0
    after[starts[1:][filled] - 1] = -1
    before[starts[:-1][filled]] = -1
    alive, marked = np.ones(n, bool), np.zeros(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(places: np.ndarray) -> None:
        """Indexes the pairs that start at places by the rank of their merge."""
        places = places[after[places] >= 0]
        rank = vocabulary.merges(token[places], token[after[places]])
        places, rank = places[rank >= 0], rank[rank >= 0]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        cut = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        for r, a, b in zip(rank[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(rank)], strict=True):
            if r in index:
                index[r].append(places[a:b])
            else:
                index[r] = [places[a:b]]
                heapq.heappush(queue, r)

    add(np.arange(n))
    while queue:
        rank = heapq.heappop(queue)
        found = index.pop(rank)
        places = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        places = places[alive[places] & (after[places] >= 0)]
        places = places[vocabulary.merges(token[places], token[after[places]]) == rank]
        while len(places):
            # of places that overlap - the next token is a place too - the leftmost of each run goes first
            marked[places] = True
            inside = marked[after[places]]
            marked[places] = False
            if inside.any():
                marked[after[places]] = True
                first = ~marked[places]
                marked[after[places]] = False
                now, rest = places[first], places[~first]
            else:
                now, rest = places, places[:0]
            gone = after[now]
            token[now] = rank
            alive[gone] = False
            beyond = after[gone]
            after[now] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = now[linked]
            left = before[now]
            left = left[left >= 0]
            marked[now] = True
            left = left[~marked[left]]
            marked[now] = False
            add(np.concatenate([now, left]))
            if not len(rest):
                break
            rest = rest[alive[rest] & (after[rest] >= 0)]
            places = rest[vocabulary.merges(token[rest], token[after[rest]]) == rank]
    kept = np.cumsum(np.concatenate([[0], alive]))
    return token[alive], kept[starts]


class Words(dict):
    """word -> its number in order of first sight, and the tokens of all words whose merges are replayed."""

    def __init__(self):
        super().__init__()
        self.tokens, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.new: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word.encode("utf-8"))
        return number

    def learn(self, vocabulary: Vocabulary) -> None:
        """Replays the merges of the words met since the last time."""
        if self.new:
            tokens, starts = replay(self.new, vocabulary)
            self.tokens, self.starts = np.concatenate([self.tokens, tokens.astype(np.int32)]), np.concatenate([self.starts, starts[1:] + self.starts[-1]])
            self.new = []


def encode(texts: list[str], vocabulary: Vocabulary, pattern: regex.Pattern, words: Words | None = None) -> Iterator[np.ndarray]:
    """The ids of every text; words holds what is known from other texts and grows by the new ones."""
    words = Words() if words is None else words
    rows = [np.fromiter(map(words.__getitem__, pattern.findall(t)), np.int32) for t in texts]
    words.learn(vocabulary)
    length = np.diff(words.starts)
    for row in rows:
        n = length[row]
        ends = np.cumsum(n)
        yield words.tokens[np.repeat(words.starts[:-1][row] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, keep_ids: bool = False) -> Iterator[pa.RecordBatch]:
    """encode_column() for one task's batches of doc_id and text."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids)
    vocabulary, matches, words = loaded(path), regex.compile(pattern), Words()
    for part, texts in text_slabs(batches, 1, SLAB):
        words = words if len(words.tokens) < KNOWN else Words()
        out = []
        for doc_id, row in zip(part.column(0).to_pylist(), encode(texts, vocabulary, matches, words), strict=True):
            one = {"doc_id": doc_id, "n_tokens": len(row), "ids_sha256": hashlib.sha256(row.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(vocabulary.decode(row)).hexdigest()}
            out.append(one | ({"ids": row.astype(np.int32)} if keep_ids else {}))
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def encode_column(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array<int>).

    One row per input row, in whole texts; null counts as empty and has no ids. Ids are as the rank file's library gives
    them without special tokens. path is the rank file, a file of the installation on every machine.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encode_batches(batches, path, pattern, keep_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, decoded (binary); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(path)
        for batch in batches:
            decoded = [vocabulary.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
