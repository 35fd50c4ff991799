"""Benchmark decontamination (operator 3): prefix-filtered containment join of item windows with documents.

A window is ten consecutive words of an item (the whole item if shorter).  Its shingles, five words each (the whole
window if shorter), are ordered by rarity over all documents.  Full containment needs every shingle, so the
necessary prefix is the rarest one: a document holding it at word p is a candidate for a window starting at p minus the
shingle's offset.  Bounds on length and position come first, then the window's words are compared one by one.

Texts are read once, whatever the benchmark's size: a bit table of fixed size, filled with the benchmark's shingles, goes to
the executors, and what leaves a task are the stretches of a text around shingles found in it.  All that follows are
joins of these stretches with the benchmark's shingles and windows; a side is broadcast below BROADCAST_ROWS only.

Defined results: null or wordless documents have no words and no hits; null or wordless items have no windows, items
without id neither; repeated item ids count once; repeated documents are judged one by one, with or without an id; with an
empty benchmark nothing is hit; texts of any length are read whole; other columns are ignored by contamination() and carried by
clean().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import written
from .textmodel import spread, word_hashes

WINDOW, SHINGLE = 10, 5
#: Words of the bit table that tells shingles of the benchmark from others: 16 MB; more shingles only let more stretches pass.
TABLE_WORDS = 1 << 21
#: Shingles of a stretch at most; longer ones go out in pieces that overlap by a window.
PIECE = 32
#: Tables up to so many rows are sent to all executors; larger ones are joined by their key.
BROADCAST_ROWS = 100_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def shingle_keys(hashes: np.ndarray, k: int) -> np.ndarray:
    """Key of the k words from each place on."""
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _MUL[0] + hashes[j : j + n] * _MUL[j]
        return spread(out)


def _windows(batches):
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item_id"], pdf["text"]):
            w = words_of(text)
            found = {tuple(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))} if w else ()
            for words in found:
                keys = shingle_keys(word_hashes(list(words)), min(SHINGLE, len(words))).view(np.int64)
                rows.append((item, [x.decode("utf-8", "replace") for x in words], [{"key": int(x), "off": i} for i, x in enumerate(keys)]))
        yield pd.DataFrame(rows, columns=["item_id", "window", "shingles"])


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, window (its words), shingles: array of (key, off); one row per window of an item."""
    rows = benchmark.select("item_id", "text").where("item_id is not null").mapInPandas(_windows, "item_id long, window array<string>, shingles array<struct<key:long,off:int>>")
    return written(rows.dropDuplicates(["item_id", "window"]), "windows")


def bit_table(keys: DataFrame) -> np.ndarray:
    """TABLE_WORDS words of 64 bits with a bit set for every key; set by aggregation, so that only the table itself is collected."""
    slot = F.pmod(F.col("key"), F.lit(TABLE_WORDS * 64))
    bits = keys.select((slot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {TABLE_WORDS * 64}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # TABLE_WORDS rows at most
    table = np.zeros(TABLE_WORDS, np.uint64)
    table[bits["w"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64).view(np.uint64)
    return table


STRETCH = "struct<at:int,words:array<string>,hits:array<struct<key:long,p:int>>>"


def stretches(words: list[bytes], table: np.ndarray, sizes: list[int]) -> list[dict]:
    """The parts of a text that can hold a window: first word, words, and its shingles (key, place) that the table knows."""
    if not words:
        return []
    h = word_hashes(words)
    place, key = [], []
    for k in sizes:
        if len(h) < k:
            continue
        x = shingle_keys(h, k)
        slot = x.view(np.int64) % (TABLE_WORDS * 64)
        hit = np.flatnonzero((table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
        place.append(hit)
        key.append(x[hit].view(np.int64))
    if not place or not sum(map(len, place)):
        return []
    place, key = np.concatenate(place), np.concatenate(key)
    order = np.argsort(place, kind="stable")
    place, key = place[order], key[order]
    # a window that holds the shingle at p starts no earlier than p - 5 and ends no later than p + 10
    gaps = np.flatnonzero(np.diff(place) > 2 * WINDOW) + 1
    cut = np.unique(np.concatenate([gaps, np.arange(PIECE, len(place), PIECE)]))
    out = []
    for p, k in zip(np.split(place, cut), np.split(key, cut)):
        at = max(0, int(p[0]) - (WINDOW - SHINGLE))
        part = words[at : int(p[-1]) + WINDOW]
        out.append({"at": at, "words": [w.decode("utf-8", "replace") for w in part], "hits": [{"key": int(x), "p": int(y) - at} for x, y in zip(k, p)]})
    return out


def scanned(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """row (a number of the document's own), doc_id, n_words, text_key, found: its stretches."""
    # one row, as the sizes are 1 to SHINGLE
    sizes = sorted(shingles.agg(F.collect_set("size")).first()[0])
    shared = docs.sparkSession.sparkContext.broadcast((bit_table(shingles), sizes))

    def scan(batches):
        table, sizes = shared.value
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                split = [words_of(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "n_words": [len(w) for w in split], "found": [stretches(w, table, sizes) for w in split]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    out = rows.mapInPandas(scan, f"doc_id long, text_key binary, n_words long, found array<{STRETCH}>")
    out = written(out.withColumn("row", F.monotonically_increasing_id()), "scanned")
    shared.destroy()
    return out


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows (BROADCAST_ROWS)."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned documents, occurrences (row, window, start, size), windows of the benchmark)."""
    wins = windows(benchmark)
    shingles = wins.select(F.explode("shingles").alias("s"), F.least(F.size("window"), F.lit(SHINGLE)).alias("size")).select("s.key", "size").distinct()
    docs = scanned(docs, shingles)
    found = docs.select("row", F.explode("found").alias("f"))
    # rarity over all documents; a window with a shingle that none holds can't occur
    often = found.select(F.explode("f.hits").alias("h")).groupBy("h.key").agg(F.count(F.lit(1)).alias("n"))
    own = wins.select("window", "shingles").dropDuplicates(["window"]).select("window", F.explode("shingles").alias("s")).select("window", "s.key", "s.off")
    known = own.join(sized(written(often, "rarity")), "key", "left")
    rarest = known.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("r")).where("r.n > 0")
    prefix = sized(written(rarest.select("window", F.size("window").alias("size"), F.col("r.key").alias("key"), F.col("r.off").alias("off")), "prefixes"))
    hits = found.select("row", "f.at", "f.words", F.explode("f.hits").alias("h")).select("row", "at", "words", "h.key", "h.p")
    near = hits.join(prefix, "key").withColumn("from", F.col("p") - F.col("off")).where((F.col("from") >= 0) & (F.col("from") + F.col("size") <= F.size("words")))
    same = near.where(F.slice("words", F.col("from") + 1, F.col("size")) == F.col("window"))
    return docs, written(same.select("row", "window", (F.col("at") + F.col("from")).alias("start"), "size").distinct(), "occurrences"), wins


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found, wins = occurrences(docs, benchmark)
    # words in the union of the occurrences: each adds what lies behind all that began before it
    order = W.partitionBy("row").orderBy("start", "size").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    spans = found.select("row", "start", "size").distinct().withColumn("upto", F.coalesce(F.max(end).over(order), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(end - F.greatest("start", "upto"), F.lit(0))).alias("n_hit"))
    items = found.select("row", "window").distinct().join(wins.select("window", "item_id"), "window").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("row").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"), F.count(F.lit(1)).alias("n_items"))
    out = rows.select("row", "doc_id", "n_words").join(hit.join(items, "row"), "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, as they are: those whose text is that of a contaminated one go."""
    rows, found, _ = occurrences(docs, benchmark)
    bad = rows.join(found.select("row").distinct(), "row", "left_semi").select(F.col("text_key").alias("__bad")).distinct()
    bad = written(bad, "contaminated")
    return docs.join(sized(bad, 1_000_000), F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("__bad"), "left_anti")
