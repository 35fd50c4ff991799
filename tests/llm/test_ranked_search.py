"""Operator 11 against plain code that scores every document, and against its SQL."""

import math
import random
import re

import compare
import numpy as np
import pytest

from halocline.llm import lexical, queries, sql

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    split = [(d, fold(t)) for d, t in docs]
    split = [(d, w) for d, w in split if w]
    n, total = len(split), sum(len(w) for _, w in split)
    out = []
    for item, text in items:
        rows = []
        query = fold(text)
        df = {t: sum(t in w for _, w in split) for t in set(query)}
        for d, w in split:
            m = 25 + 75 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in query if df[t])
            if score > 0:
                rows.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=lambda r: (r[0], r[1]))


def test_query_equals_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.op11_ranked_search(spark, sf)) == sorted(plain(docs, items))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert not compare.compare(spark, compare.connect(sf), queries.op11_ranked_search, sql.ORACLE_SQL["op11_ranked_search"], sf)


def test_ties_nulls_and_clashing_columns(spark):
    docs = [(7, "red fox", 1), (3, "Red-fox", 1), (None, "red fox", 1), (3, "red fox", 1), (2**60 + 1, "red fox", 1), (9, None, 1), (10, " .,; ", 1), (11, "blue", 1), (12, "été ÉTÉ x1y", 1), (13, "fox " * 5000, 1)]
    items = [(1, "RED red fox", "a"), (1, "RED red fox", "b"), (2, "été", "a"), (3, "absent", "a"), (4, None, "a"), (5, "?!", "a"), (None, "red", "a")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(items, "item_id long, text string, term string")
    want = sorted(plain([x[:2] for x in docs], [(1, "RED red fox"), (2, "été")]))
    assert got(lexical.search(d, b)) == want
    assert [r[2] for r in want if r[0] == 1] == [3, 3, 7, 2**60 + 1, None, 13]
    assert got(lexical.search(d, b, k=2)) == sorted(plain([x[:2] for x in docs], [(1, "RED red fox"), (2, "été")], 2))
    assert lexical.search(d.where("false"), b).count() == lexical.search(d, b.where("false")).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 90}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 80)))) for k in range(700)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 12)))) for k in range(25)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain(docs, items))
    assert got(lexical.search(d, b)) == want
    monkeypatch.setattr(lexical, "TERMS", 20)
    monkeypatch.setattr(lexical, "POSTINGS", 300)
    assert got(lexical.search(d, b)) == want


@pytest.mark.parametrize("seed", range(6))
def test_reading_stops_early_and_keeps_ties(seed):
    rng = np.random.default_rng(seed)
    docs, terms = 4000, 6
    has = rng.random((docs, terms)) < [0.5, 0.3, 0.2, 0.1, 0.05, 0.01]
    impact = rng.integers(1, 30 if seed % 2 else 10**6, (docs, terms)) * has
    doc, term = np.nonzero(impact)
    index = lexical.Index(doc, term, impact[doc, term], terms)
    numbers, weights = np.arange(terms), np.array([0, 3, 5, 9, 14, 40]) + (seed > 2)
    found, scores, looked = lexical.best_positions(index, numbers, weights, 10)
    whole = impact @ weights
    assert (whole[found] == scores).all() and looked == len(set(found.tolist())) == len(found)
    kth = np.sort(whole)[-10]
    assert set(np.flatnonzero((whole >= kth) & (whole > 0)).tolist()) <= set(found.tolist())
    assert looked < 0.7 * (whole > 0).sum()
    nothing, _, looked = lexical.best_positions(index, numbers, weights, 10, floor=int(whole.max()) * 9)
    assert looked == 0 and not len(nothing)
