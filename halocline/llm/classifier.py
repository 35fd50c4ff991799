"""Quality classifier (operator 7): document evidence shrunk towards its site, hierarchical empirical Bayes.

Each document has log-odds from the calibrated n-gram model.  Sites form two levels, host and path within host.  A
level's rate of good documents has a Beta prior centred on the level above, whose strength is estimated from how
far the rates of sites of that level spread (method of moments); so sparse sites stay near the global rate.  A
document's posterior odds are its own odds times the ratio of its path's odds to the global odds, tempered.

Defined results: a null text is scored as an empty one; null host or path is a site of its own; an empty table
gives no rows; repeated rows count and are returned as often as they occur; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import same, written
from .textmodel import logits, probability, train

KEEP_AT = 0.5
#: Share of the site's log-odds shift that reaches a document; below 1, since its own text is the stronger evidence.
TEMPER = 0.5
#: Tables of paths up to so many rows are sent to all executors; larger ones are joined by their key.
BROADCAST_ROWS = 100_000


def evidence(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """docs with the column __p, the calibrated probability of good quality from the text alone."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample=sample).plain())
    names = docs.columns
    at = names.index("text")

    def score(batches):
        import pyarrow as pa

        weights, slope, offset = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                p = probability(logits(part.column(at).to_pylist(), weights), slope, offset)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.asarray(p), pa.float64())], names=[*names, "__p"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, __p double")


def strength(sites: DataFrame, rate: Column, up: Column) -> float:
    """Prior strength of a level, by moments: spread of rates beyond what chance gives, within [2, 1000]."""
    weight = F.col("n")
    row = sites.where("n > 1").agg(
        F.sum(weight * (rate - up) ** 2).alias("s"), F.sum(up * (1 - up)).alias("noise"), F.sum(weight).alias("n"), F.sum(up * (1 - up) * weight).alias("v")
    ).first()
    if not row["n"] or not row["v"]:
        return 10.0
    between = max(0.0, row["s"] - row["noise"]) / row["n"]
    v = row["v"] / row["n"]
    return float(min(1000.0, max(2.0, v / between - 1))) if between > 0 else 1000.0


def posteriors(scored: DataFrame, host: str = "__host", path: str = "__path") -> tuple[DataFrame, float]:
    """(host, path, n, site) per path, site being its shrunk rate of good documents; and the global rate."""
    paths = written(scored.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum("__p").alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    top = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k1 = strength(hosts, F.col("good") / F.col("n"), F.lit(top))
    hosts = hosts.select(host, ((F.col("good") + k1 * top) / (F.col("n") + k1)).alias("__hp"))
    both = same(paths, hosts, [host])
    k2 = strength(both, F.col("good") / F.col("n"), F.col("__hp"))
    return both.select(host, path, "n", F.col("__hp").alias("host_rate"), ((F.col("good") + k2 * F.col("__hp")) / (F.col("n") + k2)).alias("path_rate")), top


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = 4000, keep_at: float = KEEP_AT, whole: bool = False) -> DataFrame:
    """doc_id, p_text, host_rate, path_rate, p_good, kept per document; or, whole, docs as they are with __kept."""
    rows = evidence(docs if whole else docs.select("doc_id", "text", host.alias("__host"), path.alias("__path")), labels, sample)
    rows = rows.withColumns({"__host": host, "__path": path}) if whole else rows.drop("text")
    rows = written(rows, "scored")
    sites, top = posteriors(rows)
    if sites.count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    joined = same(rows, sites.select("__host", "__path", F.col("host_rate").alias("__host_rate"), F.col("path_rate").alias("__path_rate")), ["__host", "__path"])
    logit = lambda c: F.log(c / (1 - c))
    squeezed = F.least(F.greatest(F.col("__p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    z = logit(squeezed) + TEMPER * (logit(F.col("__path_rate")) - float(np.log(top / (1 - top))))
    good = 1 / (1 + F.exp(-z))
    if whole:
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], (good >= keep_at).alias("__kept"))
    return joined.select("doc_id", F.col("__p").alias("p_text"), F.col("__host_rate").alias("host_rate"), F.col("__path_rate").alias("path_rate"), good.alias("p_good"), (good >= keep_at).alias("kept"))
