"""Corpus queries against their SQL, or against plain code where SQL can't say them."""

import collections
import hashlib
import random
import re
import struct
import zlib

import compare
import pandas as pd
import pytest
import xxhash

from halocline.llm import linededup, queries, secrets, shards

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    said = compare.compare(spark, compare.connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert not said or said.startswith("~"), said


def test_quality_rules(spark, docs):
    got = queries.op2_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        w = WORD.findall(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_models_tell_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    for f in (queries.op2_quality_rules, queries.op7_quality_classifier):
        both = labels.merge(f(spark, sf).toPandas(), on="doc_id")
        if "base_failed" in both:
            both = both[~both.base_failed]
        held = [i for i, d in enumerate(both.doc_id) if xxhash.xxh3_64_intdigest(str(d).encode()) % 3 == 0]
        part = both.iloc[held]
        assert part[part.quality == 1].kept.mean() > 0.98
        assert part[part.quality == 0].kept.mean() < 0.25


def test_shards(spark, docs):
    got = queries.op5_shards(spark, SF).toPandas()
    size = {i: len(t.encode()) + 1 for i, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got["size"])) == size
    assert all(zlib.crc32(t.encode()) == c for t, c in zip(docs.text, got.set_index("doc_id").loc[docs.doc_id].text_crc32))
    groups = collections.defaultdict(int)
    for i, t in zip(docs.doc_id, docs.text):
        groups[hashlib.md5(t.encode()).hexdigest()] += size[i]
    sizes = [groups[k] for k in sorted(groups)]

    def need(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= 8 else (mid + 1, high)
    by = got.groupby("shard")["size"].sum()
    assert by.max() == low and set(by.index) <= set(range(8))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    where = collections.defaultdict(set)
    for i, s in zip(got.doc_id, got.shard):
        where[docs.set_index("doc_id").text[i]].add(s)
    assert all(len(v) == 1 for v in where.values())


def hashed(value, seed=42):
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))))[0]


def plain_line_dedup(docs, gram=linededup.GRAM, window=linededup.WINDOW):
    rows, marks = {}, []
    for i, t in docs:
        lines = [(p, x) for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        c0, own = 0, []
        for p, x in lines:
            bare = x.strip(" \t\n\x0b\x0c\r")
            n = bare.count(" ") + bare.count("\t") + 1
            own.append((p, hashed(x), n, c0))
            c0 += n
        key = (i, hashed(t))
        rows[key] = own
        grams = []
        for k, (_, _, _, start) in enumerate(own):
            span = [r for r in own[k:] if r[3] <= start + gram - 1]
            h = 42
            for r in span:
                h = hashed(r[1], h)
            grams.append(h if span[-1][3] + span[-1][2] >= start + gram else None)
        for k, (_, _, _, start) in enumerate(own):
            if c0 - start >= window:
                marks.append((*min((grams[j], j + 1) for j in range(k, len(own)) if own[j][3] <= start + window - gram and grams[j] is not None), key))
    first, own_marks = {}, collections.defaultdict(list)
    for g, n, key in set(marks):
        first[g] = min(first.get(g, (key, n)), (key, n))
        own_marks[key].append((n, g))
    gone = collections.defaultdict(set)

    def extend(key, n, a, m):
        x, y = rows[key], rows[a]
        for k in range(n - 1, -1, -1):
            if k - n + m < 0 or x[k][1] != y[k - n + m][1]:
                break
            gone[key].add(x[k][0])
        for k in range(n - 1, len(x)):
            if not 0 <= k - n + m < len(y) or x[k][1] != y[k - n + m][1]:
                break
            gone[key].add(x[k][0])

    for key, found in own_marks.items():
        found.sort()
        side = {n: [(found[k + d][1], found[k + d][0] - n) if 0 <= k + d < len(found) else None for d in (-1, 1)] for k, (n, _) in enumerate(found)}
        before = {}
        for n, g in found:
            last = before.get(g)
            before[g] = n
            if last is not None:
                extend(key, n, key, last)
            if (last is None or side[last] != side[n]) and (key, n) != first[g]:
                extend(key, n, *first[g])
    return gone


def must_go(docs, window=linededup.WINDOW):
    """(document, line numbers) of every line in a run of `window` words or more that stands earlier; knows nothing of fingerprints."""
    first, spans = {}, []
    for i, t in docs:
        lines = [(p, x, x.strip(" \t\n\x0b\x0c\r")) for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        sizes = [b.count(" ") + b.count("\t") + 1 for _, _, b in lines]
        key = (i, hashed(t))
        for a in range(len(lines)):
            for step in (1, -1):  # the shortest run from the line on, and up to it
                b, n = a, sizes[a]
                while n < window and 0 <= b + step < len(lines):
                    b += step
                    n += sizes[b]
                if n >= window:
                    lo, hi = min(a, b), max(a, b)
                    text = tuple(x for _, x, _ in lines[lo : hi + 1])
                    first[text] = min(first.get(text, (key, lo)), (key, lo))
                    spans.append((text, key, lo, [p for p, _, _ in lines[lo : hi + 1]]))
    out = collections.defaultdict(set)
    for text, key, lo, at in spans:
        if first[text] != (key, lo):
            out[key] |= set(at)
    return out


def test_runs_that_an_earlier_document_holds_whole_go(spark):
    rnd = random.Random(9)
    line = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(10))
    rows = []
    for k in range(60):
        shared, one, two = [line() for _ in range(10)], [line(), line()], [line(), line()]
        rows += [(3 * k, "\n".join(shared + one)), (3 * k + 1, "\n".join(shared + two)), (3 * k + 2, "\n".join(shared + two))]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert all(got.loc[3 * k].n_removed == 0 and got.loc[3 * k + 1].text.count("\n") <= 1 and got.loc[3 * k + 2].text == "" for k in range(60))


def test_versions_of_a_text_lose_what_stands_earlier(spark):
    rnd = random.Random(10)
    pool = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([1, 4, 9, 30, 60]))) for _ in range(60)]
    rows = []
    for k in range(150):
        a = rnd.randrange(0, 50)
        part = pool[a : a + rnd.randrange(3, 20)]
        for _ in range(rnd.randrange(0, 3)):
            part.insert(rnd.randrange(0, len(part) + 1), rnd.choice([f"own {k} {rnd.random()}", rnd.choice(pool), ""]))
        rows.append((k, "\n".join(part)))
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas().set_index("doc_id")
    want, seen = must_go(rows), plain_line_dedup(rows)
    for i, t in rows:
        key = (i, hashed(t))
        lost = want[key] | seen[key]
        assert got.loc[i].text == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in lost), i
    assert sum(len(want[k] - seen[k]) for k in want) > 20


def test_line_dedup(spark, docs):
    got = queries.op8_line_dedup(spark, SF).toPandas().set_index("doc_id")
    gone = plain_line_dedup(list(zip(docs.doc_id, docs.text)))
    for key, at in must_go(list(zip(docs.doc_id, docs.text))).items():
        gone[key] |= at
    total = 0
    for i, t in zip(docs.doc_id, docs.text):
        lost = gone[(i, hashed(t))]
        total += len(lost)
        assert got.loc[i].text == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in lost)
        assert (got.loc[i].n_removed, got.loc[i].n_lines) == (len(lost), t.count("\n") + 1)
    assert total


@pytest.mark.parametrize("period", [1, 7])
def test_repeating_lines_cost_in_proportion(spark, period, monkeypatch):
    texts = ["\n".join(f"line {i % period} of a list" for i in range(n)) for n in (300, 600)]
    made = []
    real = linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, label: (made.append((label, out := real(df, label))), out)[1])
    counts = []
    for t in texts:
        made.clear()
        got = linededup.deduplicated(spark.createDataFrame([(1, t), (2, "own start\n" + t)], "doc_id long, text string")).toPandas().set_index("doc_id")
        gone = plain_line_dedup([(1, t), (2, "own start\n" + t)])
        for i, whole in ((1, t), (2, "own start\n" + t)):
            lost = gone[(i, hashed(whole))]
            assert got.loc[i].text == "\n".join(x for p, x in enumerate(whole.split("\n")) if p not in lost)
        assert got.loc[2].text == "own start" and got.loc[1].n_removed > len(t.split("\n")) - 40
        counts.append(sum(df.count() for label, df in made if label == "matches"))
    assert counts[1] < 2.3 * counts[0]


def test_secret_scan(spark, docs):
    got = queries.op10_secret_scan(spark, SF).toPandas().set_index("doc_id")
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in zip(docs.doc_id, docs.text):
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        r = got.loc[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert set(filter(None, text.split(","))) <= set(filter(None, r.spans.split(",")))


def test_battery_tells_random_from_patterned():
    import random

    rnd = random.Random(5)
    abc = secrets.ALPHABETS["base62"]
    fair = [secrets.battery("".join(rnd.choice(abc) for _ in range(40)), abc) for _ in range(300)]
    assert sum(p < 0.01 for p in fair) < 20
    assert secrets.battery("abcabcabc1" * 4, abc) < 1e-6 and secrets.battery("aaaa1111" * 5, abc) < 1e-6


def test_search_for_capacity(spark):
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((5, 9, 2, 7, 7, 7, 1))], "doc_id long, text string")
    out = shards.sharded(rows, shards=3).toPandas()
    assert out.shard.max() <= 2 and len(out) == 7
    # groups of 6, 10, 3, 24 (three equal texts) and 2 bytes: no shard of three can stay below 24
    assert out.groupby("shard")["size"].sum().max() == 24
