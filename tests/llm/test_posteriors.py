"""The classifier's shrinkage against plain arithmetic over all documents."""

import collections

import numpy as np
from pyspark.sql import functions as F

from halocline.llm import classifier


def plain(rows):
    """host, path -> (host rate, path rate): each level drawn to the one above by a strength from the spread of its rates."""

    def strength(sites, up):
        many = [(n, g / n, up(k)) for k, (n, g) in sites.items() if n > 1]
        weight, v = sum(n for n, _, _ in many), sum(u * (1 - u) * n for n, _, u in many)
        if not weight or not v:
            return 10.0
        between = max(0.0, sum(n * (r - u) ** 2 for n, r, u in many) - sum(u * (1 - u) for _, _, u in many)) / weight
        return min(1000.0, max(2.0, v / weight / between - 1)) if between > 0 else 1000.0

    hosts, paths = collections.defaultdict(lambda: (0, 0.0)), collections.defaultdict(lambda: (0, 0.0))
    for h, p, x in rows:
        hosts[h] = (hosts[h][0] + 1, hosts[h][1] + x)
        paths[h, p] = (paths[h, p][0] + 1, paths[h, p][1] + x)
    top = (sum(x for *_, x in rows) + 1) / (len(rows) + 2)
    k1 = strength(hosts, lambda _: top)
    rate = {h: (g + k1 * top) / (n + k1) for h, (n, g) in hosts.items()}
    k2 = strength(paths, lambda k: rate[k[0]])
    return {k: (rate[k[0]], (g + k2 * rate[k[0]]) / (n + k2)) for k, (n, g) in paths.items()}, top


def test_posteriors_of_hosts_and_paths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for h in (None, "a", "b", "c", "d"):
        for p in (None, "x", "y", "z"):
            mean = rng.uniform(0.1, 0.9)
            rows += [(h, p, float(np.clip(rng.normal(mean, 0.2), 0.01, 0.99))) for _ in range(int(rng.integers(1, 60)))]
    want, top = plain(rows)
    got, base = classifier.posteriors(spark.createDataFrame(rows, "__host string, __path string, __p double"))
    assert abs(base - top) < 1e-12
    found = {(r["__host"], r["__path"]): (r["host_rate"], r["path_rate"]) for r in got.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], atol=1e-9) for k in want)


def test_sparse_sites_follow_their_host_and_full_ones_themselves(spark):
    rows = [("good", "many", 0.95)] * 300 + [("good", "few", 0.05)] + [("bad", "many", 0.05)] * 300 + [("bad", "few", 0.95)] + [("mid", f"p{i}", 0.5 + 0.4 * (-1) ** i) for i in range(40)]
    got, _ = classifier.posteriors(spark.createDataFrame(rows, "__host string, __path string, __p double"))
    rate = {(r["__host"], r["__path"]): r["path_rate"] for r in got.collect()}
    assert rate["good", "many"] > 0.9 and rate["bad", "many"] < 0.1
    assert rate["good", "few"] > 0.5 > rate["bad", "few"], "one document doesn't overrule its host"


def test_verdict_follows_from_evidence_and_site(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = classifier.classify(docs, labels, F.col("source"), F.col("lang")).join(docs.select("doc_id", F.col("source").alias("h"), F.col("lang").alias("p")), "doc_id").toPandas()
    want, top = plain(list(zip(out.h, out.p, out.p_text)))
    logit = lambda x: np.log(x / (1 - x))
    rate = np.array([want[k][1] for k in zip(out.h, out.p)])
    z = logit(out.p_text.clip(1e-9, 1 - 1e-9)) + classifier.TEMPER * (logit(rate) - logit(top))
    assert np.allclose(out.p_good, 1 / (1 + np.exp(-z)), atol=1e-9) and (out.kept == (out.p_good >= classifier.KEEP_AT)).all()


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    from halocline.llm import textmodel

    texts = [(k, " ".join(f"w{(k * 7 + i * (1 + k % 2)) % 50}" for i in range(60)), k % 2) for k in range(60)]
    rows = [(k, t) for k, t, _ in texts] + [(7, f"other text {n} of the same id") for n in range(300)]
    labels = spark.createDataFrame([(k, y) for k, _, y in texts], "doc_id long, quality int")
    fits = [textmodel.train(spark.createDataFrame(order, "doc_id long, text string").repartition(n), labels, rounds=6) for order, n in ((rows, 3), (rows[::-1], 5))]
    assert np.array_equal(fits[0].weights, fits[1].weights) and fits[0].plain()[1:] == fits[1].plain()[1:]
    assert np.abs(fits[0].weights).max() > 0
