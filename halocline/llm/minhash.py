"""MinHash near-duplicates (operator 4) with SuperMinHash signatures, banding, exact verification and union-find.

1. One pass over the texts gives each document its shingle set's hash, size, band keys and a short sketch.
2. Documents with the same set are folded into the one with the least id, so copies cost nothing further.
3. Every band key with several sets names its least id as pivot; (member, pivot) pairs, linear in the members, are
   thinned by size and sketch and verified on the full sets; verified pairs are joined by union-find.
4. Keys that still hold several components are searched in full, in blocks of a bounded number of sets: pairs of
   different components that neither sketch nor bitmap excludes are verified.  First one pair per component met, then all
   that are left.

The sketch only excludes pairs that agree in fewer than floor_of places: a pair at the threshold does so ten times more
rarely at least than it shares no band.  A set's bitmap has
one bit set per hash; bits in which two bitmaps differ never outnumber the shingles in which the sets differ, so what
it excludes is proven to be no link, and few pairs below the threshold are left.  With BANDS bands of ROWS rows a pair
at the threshold is lost, by bands or sketch, with the probability that missed() bounds.

Sets, not ids, are the nodes: each distinct set has a number of its own, so an id that several texts share loses no link.

Defined results: documents without words, or null, have an empty set, link with nothing and stay; every row is a document
of its own, with the component of its set, also where ids repeat.  A null id is none: component_id is the least id of the
group, null where no document has one, and kept where it equals the id, nulls included.  An empty table gives no rows;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, unwritten, written
from .textmodel import spread, word_hashes

BANDS, ROWS = 24, 4
SKETCH = BANDS * ROWS
#: Bytes of a text that are split to words at a time, and items of a set that are ranked at a time: they bound a task's memory.
SLICE, CHUNK = 1 << 22, 1 << 17
#: Sets compared in one task at a time when a key is searched in full.
BLOCK = 1024
#: Words of the filter that keeps texts without candidates from being shuffled: 8 MB, whatever the data.
FILTER_WORDS = 1 << 20
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def unbanded(percent: int) -> float:
    """Probability that a pair at the threshold shares no band."""
    return (1 - (percent / 100) ** ROWS) ** BANDS


def below(places: int, percent: int) -> float:
    """Probability that a pair at the threshold agrees in fewer places (binomial; SuperMinHash varies no more)."""
    p = percent / 100
    return sum(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(places))


def floor_of(percent: int) -> float:
    """Share of places below which a sketch excludes a pair."""
    return max(k for k in range(SKETCH) if below(k, percent) <= unbanded(percent) / 10) / SKETCH


def missed(percent: int) -> float:
    """Bound of the probability that a pair at the threshold isn't verified."""
    return unbanded(percent) + below(round(floor_of(percent) * SKETCH), percent)


def hashed_words(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lowered; a slice of the text at a time becomes a list of words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    parts, at = [np.empty(0, np.uint64)], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(word_hashes(raw[at:end].split()))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; a shorter text is one shingle, an empty one none."""
    h = hashed_words(text)
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < k:
            x = np.uint64(len(h))
            for w in h:
                x = spread(np.array([x * _K[0] + w]))[0]
            return np.array([x])
        n = len(h) - k + 1
        x = np.zeros(n, np.uint64)
        for i in range(k):
            x = x * _K[0] + h[i : i + n] * _K[i % 5]
        return np.unique(spread(x))


def superminhash(items: np.ndarray, m: int = SKETCH) -> np.ndarray:
    """SuperMinHash: each item holds the ranks 0..m-1 in random order over the m places; place keeps its least rank.

    Step j gives every item its j-th place of a lazily shuffled permutation and the value j + r, r uniform in [0, 1).
    Later steps can't lower a place that already holds less than j, so it stops once all places do.
    """
    out = np.full(m, np.inf)
    for at in range(0, len(items), CHUNK):
        part = items[at : at + CHUNK]
        order = np.tile(np.arange(m, dtype=np.uint8), (len(part), 1))
        rows = np.arange(len(part))
        with np.errstate(over="ignore"):
            for j in range(m):
                if out.max() < j:
                    break
                r = spread(part + _K[j % 5] * np.uint64(2 * j + 1))
                k = j + ((r & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int64)
                place = order[rows, k]
                order[rows, k] = order[:, j]
                np.minimum.at(out, place, j + (r >> np.uint64(32)).astype(np.float64) / 4294967296.0)
    return out


def sketched(items: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and the sketch (one byte a place) of a set."""
    sig = superminhash(items)
    with np.errstate(over="ignore"):
        h = spread((sig * 4294967296.0).astype(np.uint64))
        grid = h.reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64) * _K[2]
        for i in range(ROWS):
            key = spread(key * _K[0] + grid[:, i])
    return key.view(np.int64), (h >> np.uint64(56)).astype(np.uint8).tobytes()


def bitmap(items: np.ndarray) -> bytes:
    """Bit (hash mod size) of every item; about eight bits an item, a power of two."""
    size = 1 << max(6, (8 * len(items) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(items & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def differ_by(a: bytes, b: bytes) -> int:
    """A lower bound of the number of items in which two sets differ; the larger bitmap is folded to the smaller's size."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def possible(bound: int, na: int, nb: int, percent: int) -> bool:
    """Whether sets of these sizes that differ in `bound` items or more can reach the threshold."""
    return bound * (100 + percent) <= (na + nb) * (100 - percent)


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _features(k: int):
    def run(batches):
        for pdf in batches:
            rows, done = [], {}
            for text in pdf["text"]:
                got = done.get(text)
                if got is None:
                    s = shingle_set(text, k)
                    keys, sketch = sketched(s) if len(s) else (np.empty(0, np.int64), b"")
                    got = done[text] = (len(s), digest(s), keys, sketch, bitmap(s))
                rows.append(got)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(("n", "same", "keys", "sketch", "bits"))}})

    return run


def _alike(floor: float, percent: int):
    """Keeps candidate pairs whose sketches agree in at least floor of the places and whose bitmaps allow a link."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["sa"]), np.uint8).reshape(-1, SKETCH)
                b = np.frombuffer(b"".join(pdf["sb"]), np.uint8).reshape(-1, SKETCH)
                pdf = pdf[(a == b).mean(axis=1) >= floor]
                pdf = pdf[np.array([possible(differ_by(x, y), na, nb, percent) for x, y, na, nb in zip(pdf["ba"], pdf["bb"], pdf["na"], pdf["nb"])], dtype=bool)]
            yield pdf[["a", "b"]]

    return run


def _search(floor: float, percent: int, one_each: bool):
    """Pairs of different components within the groups of a sorted partition; a group is one block or two of a key."""

    def pairs(g: pd.DataFrame):
        first = g["side"].to_numpy() != 1
        second = g["side"].to_numpy() != 0
        sk = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, SKETCH)
        ids, comp, n, bits = g["doc"].to_numpy(), g["comp"].to_numpy(), g["n"].to_numpy(), g["bits"].to_numpy()
        right = np.flatnonzero(second)
        met = set()
        for i in np.flatnonzero(first):
            other = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if len(other):
                share = (sk[other] == sk[i]).mean(axis=1)
                for j in other[np.argsort(-share, kind="stable")][: np.count_nonzero(share >= floor)]:
                    c = (min(comp[i], comp[j]), max(comp[i], comp[j]))
                    if (not one_each or c not in met) and possible(differ_by(bits[i], bits[j]), n[i], n[j], percent):
                        met.add(c)
                        yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            group = pdf["group"].to_numpy()
            if not len(group):
                continue
            edge = np.flatnonzero(group[1:] != group[:-1]) + 1
            last = edge[-1] if len(edge) else 0
            held = pdf.iloc[last:]
            out = [p for part in np.split(np.arange(last), edge[:-1]) if len(part) for p in pairs(pdf.iloc[part])] if last else []
            yield pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")
        if held is not None and len(held):
            yield pd.DataFrame(sorted(set(pairs(held))), columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of `words`-word shingles.
    """
    docs = docs.select("doc_id", "text")
    feats = docs.mapInPandas(_features(words), "doc_id long, n long, same binary, keys array<long>, sketch binary, bits binary")
    feats = written(feats.withColumn("row", F.monotonically_increasing_id()), "features")
    rows = written(feats.select("row", "doc_id", "n", "same"), "rows")
    # a set's number is that of the first row which has it and its least id
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = written(rows.where("n > 0").groupBy("same").agg(F.min(first).alias("f")).select("same", F.col("f.doc_id").alias("rep"), F.col("f.row").alias("node")), "sets")
    shown = feats.select("row", "n", "keys", "sketch", "bits").join(sets.select("node"), F.col("row") == F.col("node"))
    shown = written(shown.select("node", "n", "keys", "sketch", "bits"), "shown")
    unwritten(feats)
    floor = floor_of(percent)

    each = shown.select("node", F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot < most")
    members = written(each.join(often.select("key", "pivot"), "key"), "members")
    sketches = shown.select("node", "n", "sketch", "bits")

    def thinned(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("bits").alias("ba"))
        b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("bits").alias("bb"))
        both = pairs.join(b, "b").join(a, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.select("a", "b", "sa", "sb", "ba", "bb", "na", "nb").mapInPandas(_alike(floor, percent), "a long, b long")

    pairs = written(thinned(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()), "pairs")
    links = verified(docs, sets, pairs, words, percent)
    unwritten(pairs)
    joined = components(links)
    for one_each in (True, False):
        labelled = members.select("key", "node").join(joined, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        split = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 < c1")
        held = labelled.join(split.select("key", "size"), "key").join(sketches, "node")
        pairs = written(searched(held, floor, percent, one_each).distinct(), "pairs")
        found = verified(docs, sets, pairs, words, percent)
        both = links.unionByName(found)
        links = written(both, "links")
        unwritten(pairs, both, joined)
        joined = components(links)
    linked = sets.join(joined, "node", "left").select("same", "rep", F.coalesce("component", "node").alias("comp"))
    linked = written(linked, "linked")
    unwritten(joined, links, members, shown, sets)
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"))
    group = written(linked.join(least, "comp").select("same", "least"), "groups")
    unwritten(linked)
    out = rows.join(group, "same", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def searched(rows: DataFrame, floor: float, percent: int, one_each: bool) -> DataFrame:
    """rows(key, node, comp, n, sketch, bits, size): candidate pairs (a, b) of every key, compared block by block."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("own") == F.col("i"), 0).otherwise(1)
    group = F.xxhash64("key", "i", "j")
    dealt = dealt.select(group.alias("group"), F.col("node").alias("doc"), "comp", "n", "sketch", "bits", side.alias("side"))
    return dealt.repartition("group").sortWithinPartitions("group", "doc").mapInPandas(_search(floor, percent, one_each), "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes(node, same, rep) whose full sets meet the threshold.

    Sets are made again from the texts of the nodes' ids only: a bit table of fixed size tells which, and what an id that
    several texts share makes too many goes by the set's hash.
    """
    by_id = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(-(2**63)))), F.lit(FILTER_WORDS * 64)).cast("long")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    needed = written(needed.select("node", "same", by_id(F.col("rep")).alias("s")), "needed")
    bits = needed.selectExpr("cast(s div 64 as int) w", "shiftleft(1L, cast(s % 64 as int)) b").groupBy("w").agg(F.bit_or("b").alias("b"))
    got = bits.toPandas()  # FILTER_WORDS rows at most
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def sets(batches):
        for pdf in batches:
            at = pdf["slot"].to_numpy(np.int64)
            rows = pdf["text"].to_numpy()
            hit = np.flatnonzero((table.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            for k in range(0, len(hit), 500):
                made = [shingle_set(rows[i], words) for i in hit[k : k + 500]]
                yield pd.DataFrame({"same": [digest(x) for x in made], "items": [x.view(np.int64) for x in made]})

    all_sets = docs.select("text", by_id(F.col("doc_id").cast("long")).alias("slot")).mapInPandas(sets, "same binary, items array<long>")
    wanted = written(needed.select("node", "same").join(all_sets, "same").dropDuplicates(["node"]).select("node", "items"), "sets")
    both = pairs.join(wanted.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b").join(wanted.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
    shared = F.size(F.array_intersect("ia", "ib"))
    out = written(both.withColumn("s", shared).where(100 * F.col("s") >= percent * (F.size("ia") + F.size("ib") - F.col("s"))).select("a", "b"), "links")
    table.destroy()
    unwritten(needed, wanted)
    return out
