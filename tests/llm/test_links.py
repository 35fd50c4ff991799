"""Near-duplicate links against brute force: all pairs, ids that repeat, documents without one."""

import random
import re

import pandas as pd
import pytest

from halocline.llm import minhash

SF = "/root/testdata/sf0.01"


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def plain(rows, k, percent):
    """Component per row: links between distinct sets that share a shingle, then the least id of what hangs together."""
    each = sets_of([t for _, t in rows], k)
    where, parent = {}, list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(each):
        near = {}
        for g in s:
            for j in where.get(g, ()):
                near[j] = near.get(j, 0) + 1
            where.setdefault(g, []).append(i)
        for j, n in near.items():
            if 100 * n >= percent * (len(s) + len(each[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return [(d, len(each[i]), ids.get(root(i)) if each[i] else d) for i, (d, _) in enumerate(rows)]


def result(spark, rows, k, percent):
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


@pytest.mark.parametrize("k,percent", [(5, 80), (3, 85)])
def test_all_links_of_a_corpus(spark, k, percent):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rnd = random.Random(k)
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    for n, (_, t) in enumerate(rows[:150]):
        w = (t or "").split(" ")
        for _ in range(max(1, len(w) // rnd.choice((25, 40, 80)))):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((10**6 + n, " ".join(w)))
    want = sorted(plain(rows, k, percent), key=str)
    got = result(spark, rows, k, percent)
    right = sum(a == b for a, b in zip(got, want)) / len(want)
    print(f"{k} words, {percent} %: recall {right:.4f} of {len(want)} documents, {sum(d != c for d, _, c in want)} of them linked")
    assert got == want


def test_repeated_and_null_ids(spark):
    text = lambda c, at=None: " ".join(f"{c}{i}" if i != at else "changed" for i in range(100))
    rows = [(5, text("a")), (5, text("b")), (7, text("a", 50)), (8, text("b", 50)), (None, text("a", 20)), (None, text("c")), (None, text("c", 50)), (None, text("c")), (9, text("d")), (None, text("d")), (3, None), (None, "")]
    want = sorted(plain(rows, 5, 80), key=str)
    assert result(spark, rows, 5, 80) == want
    assert (7, 96, 5) in want and (8, 96, 5) in want and (None, 96, 5) in want and (None, 96, None) in want and (None, 96, 9) in want


def test_long_texts_in_slices(monkeypatch):
    text = " ".join(f"w{i % 5000}x{i % 7}" for i in range(40_000)) + "\nend"
    whole, keys = minhash.shingle_set(text, 5), minhash.sketched(minhash.shingle_set(text, 5))
    monkeypatch.setattr(minhash, "SLICE", 1000)
    monkeypatch.setattr(minhash, "CHUNK", 777)
    assert (minhash.shingle_set(text, 5) == whole).all()
    assert (minhash.sketched(whole)[0] == keys[0]).all() and minhash.sketched(whole)[1] == keys[1]
