"""Result and refusal ledger: every row of a job's input is returned or counted under a named reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F


def first_reason(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that holds; null for a row that passes all."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def split(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the reason column, and the refused ones with it."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def ledger(df: DataFrame, reasons: list[str], reason: str = "reason", accepted: str = "accepted") -> DataFrame:
    """(reason, n) with every declared reason listed, also those that never occurred; accepted rows under their own name."""
    counts = df.groupBy(F.coalesce(F.col(reason), F.lit(accepted)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(r,) for r in [accepted, *reasons]], "reason string")
    return names.join(F.broadcast(counts), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stored(df: DataFrame, path: str, reasons: list[str], reason: str = "reason", accepted: str = "accepted", by: tuple[str, ...] = ()) -> DataFrame:
    """Write the accepted rows of df (without the reason) to path, and return the ledger, counted as they're written: one pass, one job.

    A reason that isn't declared is refused, since its rows would be neither written nor counted.
    """
    seen = Observation()
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    names = [accepted, *reasons]
    tests = [F.col(reason).isNull(), *[F.col(reason) == r for r in reasons]]
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[count(t).alias(f"n{k}") for k, t in enumerate(tests)])
    watched.where(F.col(reason).isNull()).drop(reason).write.partitionBy(*by).parquet(path)
    got = seen.get
    if got["rows"] != sum(got[f"n{k}"] for k in range(len(names))):
        raise ValueError(f"{got['rows']} rows, of which {sum(got[f'n{k}'] for k in range(len(names)))} have a declared reason or none")
    return df.sparkSession.createDataFrame([(name, got[f"n{k}"]) for k, name in enumerate(names)], "reason string, n long")
