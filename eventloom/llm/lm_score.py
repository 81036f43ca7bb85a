"""Language-model scores: masked pseudo-likelihood with a bidirectional window network in numpy.

Every token is predicted from the two tokens on each of its sides. Tokens are words; the network has classes for some
thousands of words - the most frequent words are classes of their own, all others share some by hash - and a word's chance
within a shared class comes from its own count over the corpus: the counts of all words are a table that grows with the
corpus and is joined to the documents' words. The network sums embeddings of the context's classes by place and predicts
first a group of classes, then the class within the group, both from the context. It is trained on all tokens of all
documents: in each pass every task trains its own copy on its share of the texts, and the copies' rows are averaged, each
weighing as often as its task met it. A document's score is the sum of its tokens' conditional log-probabilities.

Texts are split into words once: training and scoring read a table of each text's classes, two bytes a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, forget, text_slabs, written

MEMBERS = 48  #: classes of a group
GROUPS = 48
CLASSES = GROUPS * MEMBERS
SHARED = 2 * MEMBERS - 1  #: classes that all words share that have none of their own
TOP = CLASSES - SHARED - 1  #: words that are classes of their own, by frequency
EDGE = TOP + SHARED  #: the class around a text
REACH = 2  #: tokens to each side
PLACES = [i for i in range(-REACH, REACH + 1) if i]
WIDTH = 16  #: hidden units; the last one is always 1, so that a row's last number is its bias
BATCH = 8192  #: tokens of a training step
ROWS = 512  #: rows of a softmax at once, few enough for a core's cache
BLOCKS = 32  #: parts in which copies of the network are averaged
FREQUENT = 100_000  #: words whose counts go to the tasks with the code; all others' are joined
SLAB = 4_000_000  #: bytes of text that a task codes at once
CODED = 2_000_000  #: bytes of classes that a task trains on or scores at once
REMEMBERED = 300_000  #: words whose codes a task keeps from slab to slab


@dataclass(frozen=True)
class Shares:
    """The log of a word's share of its class by the word's number, (n + 1) / total of the class; words not in the corpus
    have n 0 and, all together, one more in the total."""

    counts: DataFrame  # h, n of all words but the top ones, a table in the shared folder
    frequent: np.ndarray  # numbers of the most frequent of them, ascending after a -1
    n: np.ndarray  # their counts
    totals: np.ndarray  # (SHARED,): sum of n + 1 over a class's words, and 1

    def __getitem__(self, h: int) -> float:
        row = self.counts.where(F.col("h") == int(h)).select("n").first()
        return float(np.log((row.n if row else 0) + 1) - np.log(self.totals[h % SHARED]))


@dataclass(frozen=True)
class Model:
    top: dict[bytes, int]  # word -> its class
    within: Shares  # log of a word's share of its class
    net: np.ndarray  # the network's rows, see parts()


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def number(word: bytes) -> int:
    """A word's number: 60 bits of its MD5, so that even 100 million words hardly ever share one."""
    return int.from_bytes(md5(word).digest()[:8], "big") >> 4


class Lookup(dict):
    """word -> its code: the class of a frequent word, else CLASSES + its number."""

    def __init__(self, top: dict[bytes, int]):
        super().__init__(top)

    def __missing__(self, word: bytes) -> int:
        self[word] = code = CLASSES + number(word)
        return code


class Met(dict):
    """word -> its place among the words met by a task, the top ones first; and what is known of each place's word."""

    def __init__(self, top: dict[bytes, int]):
        super().__init__(zip(top, range(len(top)), strict=True))
        self.new, self.columns = list(top.values()), []

    def __missing__(self, word: bytes) -> int:
        self.new.append(CLASSES + number(word))
        self[word] = place = len(self)
        return place

    def known(self, of_words) -> list[np.ndarray]:
        """The columns that of_words gives for codes, by place."""
        if self.new or not self.columns:
            more = of_words(np.array(self.new, np.int64))
            self.columns = [np.concatenate(x) for x in zip(self.columns, more, strict=True)] if self.columns else list(more)
            self.new = []
        return self.columns


def class_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < CLASSES, codes, TOP + (codes - CLASSES) % SHARED)


def coded(docs: DataFrame, top: dict[bytes, int], within: Shares) -> DataFrame:
    """docs (doc_id, text) -> a table in the shared folder, a row for each of docs: row (its own number), doc_id, n_tokens,
    classes (of its words, 16 bits each), share (the sum of its words' log shares, but for the counts that are to be
    joined), words and times (the numbers of the words whose counts are to be joined, and how often it has each)."""
    frequent, n_frequent, totals = within.frequent, within.n, within.totals

    def of_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: classes, log shares, numbers, and whether their counts are to be joined."""
        h = codes - CLASSES
        k = np.searchsorted(frequent, h, "right") - 1
        k = np.where(frequent[k] == h, k, 0)  # 0: in none
        own = codes < CLASSES
        return class_of(codes).astype(np.uint16), np.where(own, 0.0, np.log(n_frequent[k] + 1) - np.log(totals[h % SHARED])), h, ~own & (k == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(top)
        for part, texts in text_slabs(batches, 2, SLAB):
            if len(met) > len(top) + REMEMBERED:  # words once met are kept while they are not too many
                met = Met(top)
            found, ends = [], [0]
            for t in texts:
                found += lower_words(t.encode("utf-8", "replace"))
                ends.append(len(found))
            at = np.fromiter(map(met.__getitem__, found), np.int32, len(found))
            sizes = np.diff(ends)
            row = np.repeat(np.arange(len(sizes)), sizes)
            classes, share, h, joined = met.known(of_words)
            asked = np.flatnonzero(joined[at])
            pairs, times = np.unique(row[asked] * len(h) + at[asked], return_counts=True)
            owner, word = np.divmod(pairs, max(1, len(h)))
            lists = pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32())
            bounds = pa.py_buffer(2 * np.array(ends, np.int32))
            coded_texts = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(classes[at])])
            shares = pa.array(np.bincount(row, share[at], len(sizes)), pa.float64())
            columns = [part.column(0), part.column(1), pa.array(sizes), coded_texts, shares, pa.ListArray.from_arrays(lists, pa.array(h[word])), pa.ListArray.from_arrays(lists, pa.array(times))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "classes", "share", "words", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row long, doc_id long, n_tokens long, classes binary, share double, words array<long>, times array<long>"
    return written(rows.mapInArrow(run, schema), "lm-codes")


def class_slabs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of coded()'s table, their classes with REACH times EDGE before each text and at the end, and the texts' numbers
    of words."""
    edge = np.full(REACH, EDGE, np.uint16)
    for part, classes in text_slabs(batches, column, CODED):
        rows = [np.frombuffer(x or b"", np.uint16) for x in classes]
        yield part, np.concatenate([x for r in rows for x in (edge, r)] + [edge]), np.array([len(r) for r in rows], np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (A-Z lowered), n over all documents."""
    spaced = F.col("text")
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = docs.select(F.explode(F.split(spaced, " ")).alias("raw")).where("raw <> ''").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def parts(net: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views of a network: embeddings by place and class, output rows of classes and of groups, and the hidden layer's
    bias."""
    n = len(PLACES) * CLASSES
    return net[:n].reshape(len(PLACES), CLASSES, WIDTH), net[n : n + CLASSES], net[n + CLASSES : -1], net[-1]


def start(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """A network that gives every class its share of the counts (and one), whatever the context."""
    net = np.zeros((len(PLACES) * CLASSES + CLASSES + GROUPS + 1, WIDTH), np.float32)
    embeddings, classes, groups, _ = parts(net)
    embeddings[:] = 0.3 * np.random.default_rng(seed).standard_normal(embeddings.shape)
    classes[:, -1] = np.log(counts + 1.0)
    groups[:, -1] = np.log((counts + 1.0).reshape(GROUPS, MEMBERS).sum(1))
    return net


def softmax(z: np.ndarray) -> np.ndarray:
    """Of each row, in its place."""
    ones = np.ones(z.shape[1], z.dtype)
    for a in range(0, len(z), ROWS):
        x = z[a : a + ROWS]
        e = np.exp(x - x.max())
        sums = e @ ones
        if sums.min() < 1e-30:  # a row is far below the largest number of all
            e = np.exp(x - x.max(1, keepdims=True))
            sums = e.sum(1)
        np.divide(e, sums[:, None], out=x)
    return z


def log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, at one place, whatever the other rows; z is overwritten."""
    got = np.empty(len(z))
    for a in range(0, len(z), ROWS):
        x = z[a : a + ROWS]
        x -= x.max(1, keepdims=True)
        own = x[np.arange(len(x)), at[a : a + ROWS]]
        got[a : a + ROWS] = own - np.log(np.exp(x, out=x).sum(1))
    return got


def hidden(net: np.ndarray, near: np.ndarray) -> np.ndarray:
    embeddings, _, _, bias = parts(net)
    h = embeddings[0][near[:, 0]]
    for j in range(1, len(PLACES)):
        h += embeddings[j][near[:, j]]
    h += bias
    np.tanh(h, out=h)
    h[:, -1] = 1
    return h


def firsts(x: np.ndarray) -> np.ndarray:
    """Where each value of an ascending array stands first."""
    return np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]])[: len(x)])


def grouped(group: np.ndarray) -> list[tuple[int, slice]]:
    """Each group that occurs in an ascending array, and where."""
    first = firsts(group)
    return [(g, slice(a, b)) for g, a, b in zip(group[first].tolist(), first, [*first[1:], len(group)], strict=True)]


def by_target(near: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in the order of their targets, and that order."""
    order = np.argsort(target.astype(np.uint16), kind="stable")
    return near[order], target[order], order


def windows(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of classes with edges: where tokens stand, and the classes around each of them."""
    at = np.flatnonzero(c != EDGE)
    return at, np.stack([c[at + i] for i in PLACES], 1)


def log_chances(net: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | near) of each window."""
    _, classes, groups, _ = parts(net)
    out = np.zeros(len(target))
    for a in range(0, len(target), BATCH):
        x, t, order = by_target(near[a : a + BATCH], target[a : a + BATCH])
        h = hidden(net, x)
        group, member = np.divmod(t, MEMBERS)
        got = log_softmax(h @ groups.T, group)
        for g, i in grouped(group):
            rows = classes[g * MEMBERS : (g + 1) * MEMBERS]
            got[i] += log_softmax(h[i] @ rows.T, member[i])
        out[a + order] = got
    return out


class Trainer:
    """A task's copy of the network: steps by Adagrad, and how often each row was met."""

    def __init__(self, net: np.ndarray, rate: float):
        self.net, self.rate = net.copy(), rate
        self.past = np.ones_like(net)
        self.met = np.zeros(len(net), np.float32)

    def move(self, rows, gradient: np.ndarray, met) -> None:
        """Against the gradient of some rows (an index or a slice) that were met so often."""
        past = self.past[rows] + gradient * gradient
        self.past[rows] = past
        self.net[rows] -= self.rate * gradient / np.sqrt(past)
        self.met[rows] += met

    def step(self, near: np.ndarray, target: np.ndarray) -> None:
        _, classes, groups, _ = parts(self.net)
        near, target, _ = by_target(near, target)
        h, n = hidden(self.net, near), len(PLACES) * CLASSES
        group, member = np.divmod(target, MEMBERS)
        off = softmax(h @ groups.T)
        off[np.arange(len(h)), group] -= 1
        back = off @ groups
        for g, i in grouped(group):
            rows = classes[g * MEMBERS : (g + 1) * MEMBERS]
            miss = softmax(h[i] @ rows.T)
            miss[np.arange(len(miss)), member[i]] -= 1
            back[i] += miss @ rows
            self.move(slice(n + g * MEMBERS, n + (g + 1) * MEMBERS), miss.T @ h[i], len(miss))
        self.move(slice(n + CLASSES, n + CLASSES + GROUPS), off.T @ h, len(h))
        back *= 1 - h * h  # 0 for the last unit
        self.move(slice(len(self.net) - 1, None), back.sum(0, keepdims=True), len(h))
        for j in range(len(PLACES)):
            order = np.argsort(near[:, j].astype(np.uint16), kind="stable")
            found = near[order, j]
            first = firsts(found)
            self.move(j * CLASSES + found[first].astype(np.int64), np.add.reduceat(back[order], first), np.diff(first, append=len(order)))


def averaged(codes: DataFrame, net: np.ndarray, rate: float) -> np.ndarray:
    """One pass over all tokens: the mean of all tasks' copies, row by row, by how often each task met the row.

    A task emits the rows that it met, in blocks; a block's sums are added up in one task, batch by batch, and make one row. To
    the driver comes one network."""
    per = -(-len(net) // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, r = Trainer(net, rate), np.random.default_rng(5)
        for _, c, _ in class_slabs(batches, 0):
            at, near = windows(c)
            order = r.permutation(len(at))
            for a in range(0, len(at), BATCH):
                i = order[a : a + BATCH]
                trainer.step(near[i], c[at[i]])
        for k in range(BLOCKS):
            rows = np.flatnonzero(trainer.met[k * per : (k + 1) * per])
            if len(rows):
                met, values = trainer.met[k * per + rows, None], trainer.net[k * per + rows]
                yield packed(k, rows, np.hstack([values * met, met]))

    def packed(block: int, rows: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rows.astype(np.int32).tobytes()]), pa.array([sums.astype(np.float32).tobytes()])], ["block", "rows", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, rows, sums in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                total = totals.setdefault(block, np.zeros((per, WIDTH + 1)))
                total[np.frombuffer(rows, np.int32)] += np.frombuffer(sums, np.float32).reshape(-1, WIDTH + 1)
        for block, total in totals.items():
            rows = np.flatnonzero(total[:, -1])
            yield packed(block, rows, total[rows])

    schema = "block int, rows binary, sums binary"
    table = written(codes.select("classes").mapInArrow(run, schema).repartition(BLOCKS, "block").mapInArrow(added, schema), "lm-network")
    out = net.copy()
    for r in table.collect():
        sums = np.frombuffer(r["sums"], np.float32).reshape(-1, WIDTH + 1)
        out[r.block * per + np.frombuffer(r["rows"], np.int32)] = sums[:, :-1] / sums[:, -1:]
    forget(table)
    return out


def counted(docs: DataFrame) -> tuple[dict[bytes, int], Shares, np.ndarray]:
    """The top words and their classes, all others' shares and the counts of classes, over all of docs. The counts of all
    words stay a table in the shared folder; to the driver come TOP + FREQUENT words and SHARED sums at most."""
    h = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 15), 16, 10).cast("long")
    words = written(word_counts(docs).select("word", h.alias("h"), "n"), "lm-words")
    counts = np.zeros(CLASSES)
    top = {}
    for i, r in enumerate(words.orderBy(F.desc("n"), "word").limit(TOP).collect()):
        top[r.word.encode()], counts[i] = i, r.n
        last = (r.n, r.word)
    others = words.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1]))) if top else words
    totals = np.ones(SHARED)
    for r in others.groupBy((F.col("h") % SHARED).alias("c")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        totals[r.c] += r.n
    often = sorted((r.h, r.n) for r in others.select("h", "n").orderBy(F.desc("n"), "h").limit(FREQUENT).collect())
    frequent, n = np.array([(-1, 0), *often], np.int64).T
    counts[TOP:EDGE] = totals - 1
    return top, Shares(others.select("h", "n"), frequent, n, totals), counts


def trained(codes: DataFrame, counts: np.ndarray, passes: int = 1, rate: float = 0.2) -> np.ndarray:
    """The network, trained on all of coded()'s table; a network a pass comes to the driver."""
    net = start(counts)
    for _ in range(passes):
        net = averaged(codes, net, rate)
    return net


def fit(docs: DataFrame, passes: int = 1, rate: float = 0.2) -> Model:
    """The model of all of docs, to score these or others."""
    top, within, counts = counted(docs)
    codes = coded(docs.withColumn("doc_id", F.lit(0)), top, within)
    net = trained(codes, counts, passes, rate)
    forget(codes)
    return Model(top, within, net)


def scores(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, log_prob (sum), mean_log_prob: one row per input row, over whole texts.

    Null and empty texts have no tokens, log_prob 0 and mean_log_prob null. Repeated rows score alike. Empty tables give no
    rows. Other columns are ignored. The tables of counts and of codes are read when the result is.
    """
    if model:
        net, within, codes = model.net, model.within, coded(docs, model.top, model.within)
    else:
        top, within, counts = counted(docs)
        codes = coded(docs, top, within)
        net = trained(codes, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, c, sizes in class_slabs(batches, 4):
            at, near = windows(c)
            chances = np.bincount(np.repeat(np.arange(len(sizes)), sizes), log_chances(net, near, c[at]), len(sizes))
            total = pa.array(chances + part.column(3).to_numpy(), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], total], ["row", "doc_id", "n_tokens", "total"])

    rows = codes.select("row", "doc_id", "n_tokens", "share", "classes").mapInArrow(run, "row long, doc_id long, n_tokens long, total double")
    asked = codes.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("h"), F.col("w.times").alias("m"))
    log_count = F.log(F.coalesce("n", F.lit(0)) + 1.0)
    rest = asked.join(within.counts, "h", "left").groupBy("row").agg(F.sum(F.col("m") * log_count).alias("rest"))
    total = F.col("total") + F.coalesce("rest", F.lit(0.0))
    return rows.join(rest, "row", "left").select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
