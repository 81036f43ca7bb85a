"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters read overlapping chunks of CHUNK bytes, every STEP bytes, over the whole document. Their responses are
max-pooled over segments; two layers over the pooled responses and the segment's length give every segment a logit, and the
document's probability is the logistic function of the mean logit of its segments. Scoring runs in tasks over Arrow batches, with weights of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 4
CHUNK = 2 * STEP
SEGMENT = 1024  #: bytes by segment; a multiple of STEP
PAD = 256  #: the symbol after the end of a text
SLAB = 1 << 18  #: bytes scored at once, at about 120 bytes of memory each; a multiple of SEGMENT
PARTS = 8  #: segments of a long text that enter the training


@dataclass(frozen=True)
class Net:
    embed: np.ndarray  # (257, E)
    left: np.ndarray  # (STEP * E, F): filter over the chunk's first half
    right: np.ndarray  # (STEP * E, F): filter over its second half
    bias: np.ndarray  # (F,)
    hidden: np.ndarray  # (F + 1, H): over pooled responses and the segment's length
    hidden_bias: np.ndarray  # (H,)
    out: np.ndarray  # (H,)
    out_bias: float


def untrained(seed: int = 7, e: int = 8, f: int = 24, h: int = 16) -> Net:
    r = np.random.default_rng(seed)
    w = lambda *shape: (r.standard_normal(shape) * (0.5 / np.sqrt(STEP * e))).astype(np.float32)
    embed = r.standard_normal((257, e)).astype(np.float32)
    hidden = (r.standard_normal((f + 1, h)) * np.sqrt(2 / (f + 1))).astype(np.float32)
    return Net(embed, w(STEP * e, f), w(STEP * e, f), np.zeros(f, np.float32), hidden, np.zeros(h, np.float32), np.zeros(h, np.float32), 0.0)


def pooled(top: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Inputs of the hidden layer: pooled responses and the segment's length, as its logarithm."""
    return np.hstack([np.maximum(top, 0), np.log2(steps + 1).astype(np.float32)[:, None] / 8])


def responses(net: Net, symbols: np.ndarray) -> np.ndarray:
    """Filter responses over all overlapping chunks of symbols, whose length is a multiple of STEP."""
    x = net.embed[symbols].reshape(len(symbols) // STEP, -1)
    last = net.embed[np.full(STEP, PAD)].reshape(1, -1)
    after = np.vstack([x[1:], last])
    return x @ net.left + after @ net.right + net.bias


def segments_of(text: bytes) -> tuple[np.ndarray, int]:
    """The text's symbols, padded to whole steps, and the number of its segments; an empty text is one step of padding."""
    n = max(1, -(-len(text) // STEP)) * STEP
    symbols = np.full(n, PAD, np.int16)
    symbols[: len(text)] = np.frombuffer(text, np.uint8)
    return symbols, -(-n // SEGMENT)


def logits(net: Net, pieces: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the segment logits of every piece of a text, and the number of its segments. A piece comes with the bytes that
    follow it, which its last chunk reaches into. A step of them, or of padding, lies between pieces; the chunk that begins
    there counts for none."""
    parts, starts, owner, steps, at = [], [], [], [], 0
    for i, (piece, following) in enumerate(pieces):
        symbols, n = segments_of(piece)
        parts += [symbols, segments_of(following[:STEP])[0]]
        starts.append(np.append(at // STEP + np.arange(n) * (SEGMENT // STEP), (at + len(symbols)) // STEP))
        owner.append(np.append(np.full(n, i), -1))
        steps.append(np.append(np.minimum(SEGMENT, len(symbols) - np.arange(n) * SEGMENT) // STEP, 1))
        at += len(symbols) + STEP
    top = np.maximum.reduceat(responses(net, np.concatenate(parts)), np.concatenate(starts), axis=0)
    own = np.concatenate(owner)
    x = pooled(top, np.concatenate(steps))[own >= 0]
    own = own[own >= 0]
    each = np.maximum(x @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias
    return np.bincount(own, each, len(pieces)), np.bincount(own, minlength=len(pieces))


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    """Of slabs of bounded size, into which texts longer than one are cut where segments end."""
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    now, owner, size = [], [], 0

    def score() -> None:
        sums, n = logits(net, now)
        np.add.at(total, owner, sums)
        np.add.at(number, owner, n)

    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text)), SLAB):
            piece = text[a : a + SLAB]
            if now and size + len(piece) > SLAB:
                score()
                now, owner, size = [], [], 0
            now.append((piece, text[a + SLAB : a + SLAB + STEP]))
            owner.append(i)
            size += len(piece) + CHUNK
    if now:
        score()
    z = total / np.maximum(number, 1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on segments of the texts, each with its document's label; both classes weigh the same; the weights are
    the mean of those in the last quarter of the epochs. Rows' order decides nothing
    but the order of the batches, so equal rows in equal order give equal weights."""
    net, r = untrained(seed), np.random.default_rng(seed)
    if not texts:
        return net
    crops, y, steps = [], [], []
    for text, label in zip(texts, labels, strict=True):
        symbols, n = segments_of(text)
        for k in range(n):
            crop = np.full(SEGMENT + STEP, PAD, np.int16)
            part = symbols[k * SEGMENT : (k + 1) * SEGMENT]
            crop[: len(part)] = part
            crops.append(crop)
            y.append(label)
            steps.append(len(part) // STEP)
        # a short piece too, for documents are short as well
        piece = symbols[(at := int(r.integers(0, len(symbols)))) : at + int(r.integers(24, 240))]
        crop = np.full(SEGMENT + STEP, PAD, np.int16)
        crop[: len(piece)] = piece
        crops.append(crop)
        y.append(label)
        steps.append(-(-len(piece) // STEP))
    steps = np.array(steps)
    x, y = np.stack(crops), np.array(y, np.float64)
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    p = {"embed": net.embed.copy(), "left": net.left.copy(), "right": net.right.copy(), "bias": net.bias.copy(), "hidden": net.hidden.copy(), "hidden_bias": net.hidden_bias.copy(), "out": (r.standard_normal(len(net.out)) * 0.1).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    e, f = p["embed"].shape[1], len(p["bias"])
    total, taken = {k: np.zeros(a.shape, np.float64) for k, a in p.items()}, 0
    for epoch in range(epochs):
        for at in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
            now = Net(*(p[k] for k in ("embed", "left", "right", "bias", "hidden", "hidden_bias", "out")), 0.0)
            crop, n = x[at], len(at)
            z = responses(now, crop.reshape(-1)).reshape(n, -1, f)[:, :-1]  # the last step is padding
            best = z.argmax(axis=1)  # (n, f)
            top = np.take_along_axis(z, best[:, None], 1)[:, 0]
            joined = pooled(top, steps[at])
            act = np.maximum(joined @ p["hidden"] + p["hidden_bias"], 0)
            logit = act @ p["out"] + p["out_bias"]
            err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[at]) * weight[at] / n).astype(np.float32)
            g_act = (err[:, None] * p["out"]) * (act > 0)
            g_top = (g_act @ p["hidden"].T)[:, :f] * (top > 0)
            # only the winning chunks have gradients
            where = best[:, :, None] * STEP + np.arange(CHUNK)  # (n, f, CHUNK)
            sym = np.take_along_axis(crop, where.reshape(n, -1), 1).reshape(n, f, CHUNK)
            seen = p["embed"][sym].reshape(n, f, CHUNK * e)
            g_w = np.einsum("nf,nfk->kf", g_top, seen)
            g_x = (g_top[:, :, None] * np.vstack([p["left"], p["right"]]).T[None]).reshape(-1, e)
            g_embed = np.stack([np.bincount(sym.ravel(), g_x[:, k], 257) for k in range(e)], 1).astype(np.float32)
            g = {"embed": g_embed, "left": g_w[: STEP * e], "right": g_w[STEP * e :], "bias": g_top.sum(0), "hidden": joined.T @ g_act, "hidden_bias": g_act.sum(0), "out": act.T @ err, "out_bias": np.array([err.sum()], np.float32)}
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            if epoch >= epochs - max(1, epochs // 4):
                taken += 1
                for k in p:
                    total[k] += p[k]
    p = {k: (a / taken).astype(np.float32) for k, a in total.items()}
    return Net(*(p[k] for k in ("embed", "left", "right", "bias", "hidden", "hidden_bias", "out")), float(p["out_bias"][0]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, parts: int = PARTS) -> Net:
    """Trains on at most ``sample`` labelled rows, a third of class 0 (the rarer one, which would have too few rows else), those
    with the smallest hash of their ids, outside the held-out fold. Of a text over ``parts`` segments, that many segments
    spread evenly over all of it are read. Both are bounds on what the driver reads; scoring has no such bound. Labels other
    than 0 and 1 and rows without id are ignored; without any usable label the network is untrained and scores 0.5."""
    own = labels.select(F.col("doc_id").alias("id_"), F.col("quality").cast("int").alias("y_")).where("id_ is not null and y_ in (0, 1)").where(~held_out(F.col("id_")))
    picks = [own.where(F.col("y_") == y).orderBy(F.xxhash64("id_"), "id_").limit(n) for y, n in ((0, sample // 3), (1, sample - sample // 3))]
    picked = {int(r.id_): int(r.y_) for r in picks[0].unionByName(picks[1]).collect()}
    room = F.length("text") - SEGMENT
    spread = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring("text", (F.floor(room * i / max(1, parts - 1)) + 1).cast("int"), F.lit(SEGMENT)))
    windows = F.when(F.length("text") > parts * SEGMENT, spread).otherwise(F.array(F.coalesce("text", F.lit(""))))
    ids = docs.sparkSession.createDataFrame([(k,) for k in picked], "id_ long")  # of at most ``sample`` rows
    got = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id_")).select("doc_id", F.explode(windows).alias("w")).collect()
    got = sorted({(int(r.doc_id), r.w) for r in got})
    return train([w.encode() for _, w in got], np.array([picked[i] for i, _ in got]))


def scores(docs: DataFrame, net: Net, name: str = "score") -> DataFrame:
    """docs with a column of probabilities that label 1 holds, over each whole text; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(net, [(t or "").encode("utf-8", "replace") for t in texts]))

    return docs.withColumn(name, score(F.col("text")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) and labels (doc_id, quality) -> doc_id, held_out, score, predicted: one row per row of docs.

    Only texts enter a score. Rows with null doc_id are scored and not held out. Empty tables give no rows.
    """
    out = scores(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score under 0.5, in docs' own columns, whatever their names."""
    net = fit(docs, labels)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q__row"), "text")
    return scores(held, net, "q__score").where("q__score >= 0.5").select("q__row.*")
