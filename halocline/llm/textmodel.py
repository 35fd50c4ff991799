"""Logistic regression over hashed n-grams of a text, with calibrated probabilities.

Training takes a bounded sample of labelled rows (`sample` rows, those with the least md5 of their id).  Their features
stay on the executors, in the shared folder; each step of the fit brings back a few vectors of gradient sums.
Scoring runs in Arrow batches on the executors over all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import written

BITS = 15
SIZE = 1 << BITS
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_TOP = np.uint64(64 - BITS)
FAMILIES = 4
DENSE = 8
#: Feature values are shares of the text's n-grams; this scale makes usual weights of order one.
SCALE = 30.0
#: Words of a block within which distinct ones are counted, so that a text's length doesn't matter.
STRETCH = 200
#: Blocks that the sample is dealt to by id; gradients that come back in a step, and their parts' unit: a gradient stays below 32.
BLOCKS, GRADIENTS, UNIT = 24, 6, 1 << 26


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def distinct_share(wh: np.ndarray) -> float:
    """Share of distinct words within consecutive stretches of STRETCH words, over the whole text; weighted by words, 1 if there are none."""
    n = len(wh)
    if not n:
        return 1.0
    stretch = np.arange(n) // STRETCH
    order = np.lexsort((wh, stretch))
    w, b = wh[order], stretch[order]
    return (1 + np.count_nonzero((w[1:] != w[:-1]) | (b[1:] != b[:-1]))) / n


def families(text: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers of the word uni- and bigrams and the character tri- and 4-grams; shares that n-grams can't tell."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    wh = word_hashes(words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        tri = c[:-2] * _A + c[1:-1] * _B + c[2:] * _C
        four = tri[:-1] + c[3:] * _D
        two = wh[:-1] * _B + wh[1:] * _C
        out = [(spread(x + np.uint64(k)) >> _TOP).astype(np.int64) + k * SIZE for k, x in enumerate((wh, two, tri, four))]
    n, chars = max(1, len(words)), max(1, len(c))
    common = distinct_share(wh)
    lines = [x for x in text.split("\n") if x]
    dense = np.array([
        12 * np.count_nonzero(wh[1:] == wh[:-1]) / n,
        12 * (1 - common),
        4 * np.count_nonzero((c >= 65) & (c <= 90)) / chars,
        4 * np.count_nonzero((c > 32) & (c < 48) | (c > 57) & (c < 65) | (c > 90) & (c < 97) | (c > 122) & (c < 127)) / chars,
        4 * np.count_nonzero((c >= 48) & (c <= 57)) / chars,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n) / 10,
        chars / n / 10,
    ])
    return out, dense


def logits(texts: pd.Series, weights: np.ndarray) -> np.ndarray:
    """Uncalibrated log-odds; null counts as the empty text."""
    out = np.empty(len(texts))
    dense_w, bias = weights[FAMILIES * SIZE : FAMILIES * SIZE + DENSE], weights[-1]
    for i, text in enumerate(texts):
        fams, dense = families(text or "")
        out[i] = bias + dense @ dense_w + SCALE * sum(weights[x].mean() for x in fams if len(x))
    return out


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float
    prior: float

    def plain(self) -> tuple[np.ndarray, float, float]:
        """What tasks need: weights, slope and offset."""
        return self.weights, self.slope, self.offset


def probability(raw: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30)))


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    fams, dense = families(text or "")
    idx, val = [], []
    for x in fams:
        if len(x):
            u, n = np.unique(x, return_counts=True)
            idx.append(u)
            val.append(SCALE * n / len(x))
    base = FAMILIES * SIZE
    idx.append(np.arange(base, base + DENSE + 1))
    val.append(np.append(dense, 1.0))
    return np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)


def _features(batches):
    for pdf in batches:
        for k in range(0, len(pdf), 50):
            part = pdf.iloc[k : k + 50]
            rows = [_sparse(t) for t in part["text"]]
            held = [_third(x) == 0 for x in part["id"]]
            yield pd.DataFrame({"id": part["id"], "label": part["label"], "held": held, "idx": [r[0].tobytes() for r in rows], "val": [r[1].tobytes() for r in rows]})


def _third(x) -> int:
    """The part of the sample an id falls to: 0 calibrates, 1 and 2 fit."""
    return xxhash.xxh3_64_intdigest(str(x).encode()) % 3


def _packed(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of a block of documents: labels, lengths, bucket numbers and values one after another, in order of the ids."""
    pdf = pdf.sort_values("id", kind="stable")
    lens = np.array([len(x) // 4 for x in pdf["idx"]], np.int64)
    return pd.DataFrame({
        "held": [bool(key[0])], "block": [int(key[1])], "labels": [pdf["label"].to_numpy(np.float64).tobytes()], "lens": [lens.tobytes()],
        "idx": [b"".join(pdf["idx"])], "val": [b"".join(pdf["val"])],
    })


def _margins(row, w: np.ndarray):
    """Labels, lengths, buckets, values and raw scores of a block's documents."""
    y, lens = np.frombuffer(row.labels), np.frombuffer(row.lens, np.int64)
    idx, val = np.frombuffer(row.idx, np.int32), np.frombuffer(row.val, np.float32)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    return y, lens, idx, val, np.add.reduceat(val * w[idx], starts)


def labelled(labels: DataFrame, label: str, id_col: str, sample: int) -> DataFrame:
    """(id, label) of at most `sample` ids, by least md5; an id labelled twice takes its least label, null labels none."""
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    return one.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, id_col: str = "doc_id", l2: float = 1e-3, rounds: int = 60) -> Model:
    """Fit on two thirds of the sample and calibrate (Platt) on the rest; without both labels, a constant that keeps.

    Of an id with several texts the least stands for it, whatever the order of rows; it's chosen before features are made.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col("text"))
    one = own.join(F.broadcast(labelled(labels, label, id_col, sample)), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = one.mapInPandas(_features, "id long, label int, held boolean, idx binary, val binary")
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")
    packed = rows.groupBy("held", block.alias("block")).applyInPandas(_packed, "held boolean, block int, labels binary, lens binary, idx binary, val binary")
    blocks = written(packed, "sample")
    known = [(r["held"], np.frombuffer(r["labels"])) for r in blocks.select("held", "labels").collect()]  # labels of the sample, a number each
    size = FAMILIES * SIZE + DENSE + 1
    y = np.concatenate([x for _, x in known]) if known else np.empty(0)
    if len(y) < 20 or y.min() == y.max():
        return Model(np.zeros(size), 0.0, 3.0, 1.0)
    fit = np.concatenate([np.empty(0), *[x for held, x in known if not held]])
    w = _fit(blocks.where("not held"), float(fit.sum()), float((1 - fit).sum()), size, l2, rounds)
    raw, got = _scores(blocks.where("held"), w)
    slope, offset = _platt(raw, got)
    return Model(w, slope, offset, float(y.mean()))


def _fit(blocks: DataFrame, good: float, bad: float, size: int, l2: float, rounds: int) -> np.ndarray:
    """Full-batch Adam with a fixed number of steps.

    A document's part of a gradient is rounded to 1 / UNIT, so sums are sums of whole numbers: reruns agree however blocks lie
    in tasks, and a step brings back no more than GRADIENTS vectors of 32-bit numbers.
    """
    sc = blocks.sparkSession.sparkContext
    blocks = blocks.coalesce(GRADIENTS)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, rounds + 1):
        now = sc.broadcast(w.astype(np.float32))

        def slopes(batches, now=now):
            weights, g = now.value.astype(np.float64), np.zeros(size)
            for pdf in batches:
                for row in pdf.itertuples():
                    y, lens, idx, val, raw = _margins(row, weights)
                    each = np.where(y > 0, 0.5 / max(1.0, good), 0.5 / max(1.0, bad))
                    p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                    g += np.bincount(idx, weights=np.rint(UNIT * val * np.repeat(each * (p - y), lens)), minlength=size)
            yield pd.DataFrame({"g": [g.astype(np.int32).tobytes()]})

        g = l2 * w
        for row in blocks.mapInPandas(slopes, "g binary").collect():
            g += np.frombuffer(row["g"], np.int32) / UNIT
        now.destroy()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return w


def _scores(blocks: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and labels of the blocks' documents."""
    now = blocks.sparkSession.sparkContext.broadcast(w)

    def score(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                y, *_, raw = _margins(row, now.value)
                yield pd.DataFrame({"block": [row.block], "raw": [raw.tobytes()], "y": [y.tobytes()]})

    rows = sorted(blocks.mapInPandas(score, "block int, raw binary, y binary").collect(), key=lambda r: r["block"])
    return tuple(np.concatenate([np.empty(0), *[np.frombuffer(r[c]) for r in rows]]) for c in ("raw", "y"))


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for a sigmoid of the raw score, on smoothed targets."""
    if len(raw) < 10 or y.min() == y.max():
        return 1.0, 0.0
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([raw, np.ones(len(raw))])
    b = np.array([1.0, 0.0])

    def loss(b):
        z = np.clip(x @ b, -30, 30)
        return float((np.log1p(np.exp(-z)) + (1 - t) * z).sum() + 0.05 * (b[0] - 1) ** 2)

    now = loss(b)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0.1, 1e-6])
        step = np.linalg.solve(h, x.T @ (p - t) + np.array([0.1 * (b[0] - 1), 0.0]))
        scale = 1.0
        while scale > 1e-4 and loss(b - scale * step) > now:
            scale /= 2
        b = b - scale * step
        new = loss(b)
        if now - new < 1e-9:
            break
        now = new
    return float(max(b[0], 1e-3)), float(b[1])
