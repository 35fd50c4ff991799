"""Operator 13 against plain code that tries every stretch."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import queries, wordruns

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every (start, length, period): longest stretches of each period, of which only the smallest period of a stretch counts."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(6, 4 * q) and k > i:
                out.setdefault((i, k + q - i), q)
            i = max(k, i) + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def rewritten(doc_id, text):
    words = SPACE.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain(doc_id, text):
    words = rewritten(doc_id, text)
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_plain_code(spark):
    sf_small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, sf_small).collect())
    want = sorted(plain(r["doc_id"], r["text"]) for r in docs)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert got == want
    assert sum(r[1] for r in want) > 10


def test_every_sequence_over_small_alphabets():
    rng = random.Random(5)
    split = []
    for k in range(1500):
        words = [rng.choice([b"a", b"b", b"c"][: 1 + k % 3]) for _ in range(rng.randrange(0, 60))]
        if k % 2:  # nested: a run within the period of another
            part = words[: rng.randrange(1, 12)] or [b"a"]
            words = (part * rng.randrange(1, 8))[: rng.randrange(1, 90)] + words
        split.append(words)
    assert wordruns.word_runs(split) == [plain_runs(w) for w in split]


@pytest.mark.parametrize("words", [[b"x"] * 30_000, [b"a", b"b"] * 10_000 + [b"a"], [str(k % 4999).encode() for k in range(20_003)], [str(k).encode() for k in range(20_000)]])
def test_long_texts(words):
    n = len(words)
    q = next((q for q in (1, 2, 4999) if words[q:] == words[:-q]), None)
    assert wordruns.word_runs([[b"y"], words, []]) == [[], [(0, n, q)] if q else [], []]


def test_agreement_equals_comparison():
    rng = np.random.default_rng(3)
    for size in (2, 3, 40):
        seq = np.concatenate([[0], rng.integers(2, 2 + size, 3000), [1]])
        seq[700:1400] = seq[1700:2400] = np.tile(seq[20:27], 100)
        g = wordruns.Grammar(seq, 4)
        assert len(g.levels) > 5 and len(g.levels[-1].sym) < 60
        i = rng.integers(1, 2999, 4000)
        j = np.minimum(i + rng.integers(1, 1500, 4000), 3000)
        i[:200], j[:200] = np.arange(701, 901), np.arange(1701, 1901)
        for way, step in ((True, 1), (False, -1)):
            want = []
            for a, b in zip(i.tolist(), j.tolist()):
                k = 0
                while seq[a + k * step] == seq[b + k * step]:
                    k += 1
                want.append(k)
            assert g.agree(i, j, way).tolist() == want


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "a a a a a a", "x"), (4, "a a a a a", "x"), (4, "a a a a a", "x"), (5, "a a a a\x0ba\x0ca\x1ca", "x"), (2**60 + 1, "b " + "q w e " * 4 + "q", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = wordruns.periodic_runs(docs).collect()
    by = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out)
    assert by == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (0, 6, [(0, 6, 1)], "a"), (4, 5, [], "a a a a a"), (4, 5, [], "a a a a a"),
        (5, 4, [], "a a a a a a\x1ca"), (2**60 + 1, 14, [(1, 13, 3)], "b q w e"),
    ])
    assert wordruns.digests(wordruns.periodic_runs(wordruns.echoed(docs.where("false")))).count() == 0
    nulls = wordruns.digests(wordruns.periodic_runs(docs.where("text is null"))).first()
    assert nulls["start"] is None and nulls["runs_sha256"] == hashlib.sha256(b"").hexdigest() == nulls["collapsed_sha256"]
    assert wordruns.echoed(docs).where(F.col("doc_id").isNull()).first()["text"] == "a a a a a a"
