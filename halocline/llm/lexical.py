"""Ranked lexical search (operator 11): the highest-scoring documents of each item, by the Best Position Algorithm.

Texts are read once a block of items: a task passes on, for each document, its length and how often it holds the
terms that occur in items.  Lengths and document frequencies are counted over all documents.  Then each batch of documents is an index
of its own: a list per term, in order of impact.  Lists of an item are read in steps; every document seen is
looked up in all lists, which gives its whole score and its positions.  The best position of a list is the last
before which all are seen; no unseen document has more than the sum of the impacts behind the best positions.  Reading stops when that is
strictly below the k-th score, so that ties are all read.  A task carries an item's best scores from batch to batch; what leaves it
are k rows an item, of which a window takes the first k.

Defined results: null texts have no terms; items without id or terms have no rows; an item's id counts its distinct texts together, repeated rows
once; repeated documents are ranked one by one, those without an id behind their ties; texts of any length are read whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import unwritten, written
from .decontam import words_of

TOP = 10
#: Terms, and terms of items with repeats, that go to the executors at once; more items come in blocks, each with a read of the texts.
TERMS, ENTRIES = 250_000, 2_000_000
#: Words tokenised and postings indexed at once, documents of each list read in the first step.
CHUNK, POSTINGS, STEP = 250_000, 500_000, 8


def _item_terms(batches):
    for pdf in batches:
        rows = [(item, t.decode("utf-8", "replace"), n) for item, text in zip(pdf["item"], pdf["text"]) for t, n in Counter(words_of(text)).items()]
        yield pd.DataFrame(rows, columns=["item", "term", "n"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of an item and how often they stand in its distinct texts."""
    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item"), "text").distinct()
    rows = own.mapInPandas(_item_terms, "item long, term string, n long")
    return written(rows.groupBy(F.col("item").alias("item_id"), "term").agg(F.sum("n").alias("n")), "item-terms")


def blocks(terms: DataFrame) -> list[DataFrame]:
    """The items in blocks of bounded size, by a hash of their id."""
    size = terms.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("entries")).first()
    n = max(1, math.ceil(size["terms"] / TERMS), math.ceil(size["entries"] / ENTRIES))
    return [terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [terms]


def _counted(texts: list, number: dict[bytes, int]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Of each text the number of terms, and the known ones: their numbers, ascending, and how often they occur."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    known = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
    term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(split)), sizes)[term >= 0]
    pair, often = np.unique(row * len(number) + term[term >= 0], return_counts=True)
    cut = np.searchsorted(pair, np.arange(1, len(split)) * len(number))
    return sizes.tolist(), np.split((pair % max(1, len(number))).astype(np.int32), cut), np.split(often.astype(np.int32), cut)


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per document with a term: doc_id (0 if it has none), no_id, n (all its terms), terms (numbers of the known ones), often."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): k for k, t in enumerate(terms)})

    def scan(batches):
        for pdf in batches:
            texts, at = pdf["text"].tolist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 6 * CHUNK):
                    size += len(texts[to] or "")
                    to += 1
                n, known, often = _counted(texts[at:to], shared.value)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:to].array, "no_id": pdf["no_id"].iloc[at:to].array, "n": n, "terms": known, "often": often})
                at = to

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    out = rows.mapInPandas(scan, "doc_id long, no_id boolean, n long, terms array<int>, often array<int>")
    out = written(out.where("n > 0"), "counted")
    shared.destroy()
    return out


class Index:
    """Impact lists of a batch of documents.

    doc, term, impact: postings by document, then term; order: postings by term, then falling impact; a term's list is
    order[start[term] : start[term + 1]]; rank: a posting's position in its list.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> None:
        self.doc, self.term, self.impact, self.terms = doc, term, impact, terms
        self.key = doc.astype(np.int64) * terms + term
        self.order = np.lexsort((-impact, term))
        self.start = np.searchsorted(term[self.order], np.arange(terms + 1))
        self.rank = np.empty(len(doc), np.int64)
        self.rank[self.order] = np.arange(len(doc)) - self.start[term[self.order]]
        self.docs = int(doc[-1]) + 1 if len(doc) else 0

    def posting(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Direct access: the posting of each document and term, -1 where the document lacks the term."""
        key = docs[:, None] * self.terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, key.ravel()), len(self.key) - 1).reshape(key.shape)
        return np.where(self.key[at] == key, at, -1)


def best_positions(index: Index, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 0):
    """Documents and scores that may be among the k best of an item, all above the floor included, and how many documents were looked up.

    terms: the item's terms, ascending; weights: of each, times its repeats.  Documents of score 0 are left out.  At `floor` and
    above, k documents are known elsewhere: reading may stop strictly below it.
    """
    begin, size = index.start[terms], index.start[terms + 1] - index.start[terms]
    has = (size > 0) & (weights > 0)
    terms, weights, begin, size = terms[has], weights[has], begin[has], size[has]
    offset = np.cumsum(size) - size
    seen_at, seen = np.zeros(int(size.sum()) + 1, bool), np.zeros(index.docs, bool)
    best = np.zeros(len(terms), np.int64)
    docs, scores, read, step = [], [], 0, STEP
    kth, top = floor, np.empty(0, np.int64)
    while len(terms):
        # behind the best positions
        more = best < size
        bound = int((weights[more] * index.impact[index.order[begin[more] + best[more]]]).sum())
        if not bound or bound < kth:
            break
        place = read + np.arange(step)
        inside = place[None, :] < size[:, None]
        met = np.unique(index.doc[index.order[(begin[:, None] + place[None, :])[inside]]])
        met = met[~seen[met]]
        read, step = read + step, 2 * step
        if len(met):
            seen[met] = True
            post = index.posting(met, terms)
            there = post >= 0
            seen_at[(offset[None, :] + index.rank[post])[there]] = True
            score = (np.where(there, index.impact[post], 0) * weights[None, :]).sum(axis=1)
            docs.append(met)
            scores.append(score)
            top = np.sort(np.concatenate([top, score]))[-k:]
            if len(top) == k:
                kth = max(floor, int(top[0]))
        for j in range(len(terms)):
            part = seen_at[offset[j] + best[j] : offset[j] + size[j]]
            gap = int(part.argmin()) if len(part) else 0
            best[j] += len(part) if len(part) and part[gap] else gap
    looked = int(seen.sum())
    return (np.concatenate(docs), np.concatenate(scores), looked) if docs else (np.empty(0, np.int64), np.empty(0, np.int64), looked)


def first(rows: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
    """The k first of (score, no_id, doc_id): highest score, those with an id, least id."""
    return sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k]


def _ranked(shared, k: int):
    def rank(batches):
        items, n, words, terms = shared.value
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for pdf in batches:
            sizes = np.array([len(x) for x in pdf["terms"]], np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // POSTINGS)) + 1
            for part in np.split(np.arange(len(pdf)), cut):
                own = pdf.iloc[part]
                if not sizes[part].sum():
                    continue
                often = np.concatenate(own["often"].to_list()).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), sizes[part])
                m = 100 - 75 + 75 * own["n"].to_numpy(np.int64) * n // words
                impact = 1_000_000_000 * often // (1000 * often + 8 * m[doc])
                index = Index(doc, np.concatenate(own["terms"].to_list()).astype(np.int64), impact, terms)
                ids, none = own["doc_id"].to_numpy(np.int64), own["no_id"].to_numpy(bool)
                for item, numbers, weights in items:
                    had = best.get(item, [])
                    floor = had[-1][0] if len(had) == k else 0
                    found, scores, _ = best_positions(index, numbers, weights, k, floor)
                    good = (scores > 0) & (scores >= floor)
                    if good.any():
                        best[item] = first(had + list(zip(scores[good].tolist(), none[found[good]].tolist(), ids[found[good]].tolist())), k)
        for item, rows in best.items():
            yield pd.DataFrame([(item, d, x, s) for s, x, d in rows], columns=["item_id", "doc_id", "no_id", "score"])

    return rank


def _searched(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, no_id, score: of each task of documents the k best of every item of a block."""
    sc = docs.sparkSession.sparkContext
    entries = terms.toPandas()  # ENTRIES at most
    names = sorted(entries["term"].unique())
    number = {t: j for j, t in enumerate(names)}
    rows = counted(docs, names)
    size = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(len(names), np.int64)
    for r in held.toPandas().itertuples():  # a row a term: TERMS at most
        df[r.term] = r.df
    n, words = size["docs"], max(1, size["words"])
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = []
    for item, own in entries.groupby("item_id"):
        numbers = np.array([number[t] for t in own["term"]], np.int64)
        order = np.argsort(numbers)
        items.append((int(item), numbers[order], (weight[numbers] * own["n"].to_numpy(np.int64))[order]))
    shared = sc.broadcast((items, n, words, len(names)))
    out = written(rows.mapInPandas(_ranked(shared, k), "item_id long, doc_id long, no_id boolean, score long"), "ranked")
    unwritten(rows)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0."""
    terms = item_terms(items)
    found = None
    for block in blocks(terms):
        part = _searched(docs, block, k)
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "no_id", "doc_id")
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("item_id", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score")
