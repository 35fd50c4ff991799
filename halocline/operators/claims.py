"""Is every number in a text backed by its evidence?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUMERAL = r"\d[\d,]*(?:\.\d+)?"


def numerals(text: Column) -> Column:
    """Numerals of a text in order, without thousands separators and a trailing comma."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMERAL})")), lambda n: F.translate(n, ",", ""))


def rendered(value: Column) -> Column:
    """The spellings of a number that a text may use: 0 to 4 decimals."""
    return F.array(*[F.format_string(f"%.{d}f", value) for d in range(5)])


def unbacked(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims(id, text) with unbacked: its distinct numerals that no evidence(id, text) of the id holds, sorted.

    Evidence is folded to distinct numerals per id before it meets the claim.
    """
    own = evidence.select("id", F.explode(numerals(F.col("text"))).alias("n")).distinct().groupBy("id").agg(F.collect_set("n").alias("known"))
    both = claims.join(own, "id", "left")
    missing = F.array_except(numerals(F.col("text")), F.coalesce("known", F.array().cast("array<string>")))
    return both.select("id", F.array_join(F.array_sort(missing), ",").alias("unbacked"), F.size(missing).alias("n_unbacked"))


def unbacked_substring(claims: DataFrame) -> DataFrame:
    """claims(id, text, hay): the lenient test, a numeral is backed if it occurs anywhere in hay."""
    missing = F.filter(F.array_distinct(numerals(F.col("text"))), lambda n: ~F.contains(F.translate(F.coalesce("hay", F.lit("")), ",", ""), n))
    return claims.select("id", F.array_join(F.array_sort(missing), ",").alias("unbacked"), F.size(missing).alias("n_unbacked"))
