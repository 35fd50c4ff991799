"""Periodic runs of words (operator 13): recompression grammar and its longest common extensions.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, REPEATS * q) words long, that no
neighbouring word extends keeping period q.

Words of a chunk of texts become one sequence of numbers, with a number of its own before, between and after texts.
Recompression turns it into a run-length grammar: block compression names stretches of one symbol, pair compression names
pairs of a left and a right symbol, in turn, until the sequence is short.  Equal stretches get equal names wherever they
stand, but for their edges, so how far two places agree is found by rising through the levels while names agree and
descending at the first that differ, for many pairs of places at once.

A run of period q holds four neighbouring places of the grid of multiples of q, with equal words.  Places where
that is so are the candidates (a harmonic sum of places in all); the grammar extends each to both sides exactly.

Defined results: null and wordless texts have no words and no runs; texts of any length are read whole; repeated rows and
rows without an id are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE
from .textmodel import spread

LEAST, REPEATS = 6, 4
#: Words that are compressed together; a longer text is a chunk of its own.
CHUNK = 250_000
#: Pairs of places extended at once.
PAIRS = 200_000
RUN = "struct<start:long,length:long,period:long>"


@dataclass
class Level:
    """A sequence of the grammar: symbols, equal symbols from each place on and up to it, and places in the next level.

    first / last: number of the next level's symbol that begins / ends here, else -1; low / high: first and last place
    that each of the next level's symbols covers.
    """

    sym: np.ndarray
    ahead: np.ndarray | None = None
    behind: np.ndarray | None = None
    first: np.ndarray | None = None
    last: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def joined(self, head: np.ndarray) -> None:
        """Set the places in the next level, whose symbols begin where head is true."""
        n = len(self.sym)
        self.low = np.flatnonzero(head).astype(np.int32)
        self.high = np.append(self.low[1:], n).astype(np.int32) - 1
        self.first, self.last = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.first[self.low] = self.last[self.high] = np.arange(len(self.low), dtype=np.int32)


def named(sym: np.ndarray, where: np.ndarray, keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """sym with new names from `fresh` up at the places `where`, equal for equal keys; and the next free name."""
    found, name = np.unique(keys, return_inverse=True)
    out = sym.astype(np.int32)
    out[where] = fresh + name
    return out, fresh + len(found)


class Grammar:
    """Run-length grammar of a sequence whose first and last symbols occur once."""

    def __init__(self, sequence: np.ndarray, enough: int) -> None:
        """enough: symbols at which the top level may stop."""
        fresh, missed, turn = int(sequence.max()) + 1, 0, 0
        self.levels = [Level(sequence.astype(np.int32))]
        while len(sym := self.levels[-1].sym) > enough and missed < 8:
            top = self.levels[-1]
            turn += 1
            if turn % 2:
                head = np.append(True, sym[1:] != sym[:-1])
                if head.all():
                    continue
                top.joined(head)
                block = np.cumsum(head) - 1
                top.ahead = (top.high[block] - np.arange(len(sym)) + 1).astype(np.int32)
                top.behind = (np.arange(len(sym)) - top.low[block] + 1).astype(np.int32)
                size = top.high - top.low + 1
                long = np.flatnonzero(size > 1)
                new, fresh = named(sym[top.low], long, sym[top.low][long].astype(np.int64) * (int(size.max()) + 1) + size[long], fresh)
            else:
                right = (spread(sym.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
                pair = ~right[:-1] & right[1:]
                if not pair.any():
                    missed += 1
                    continue
                missed = 0
                top.joined(np.append(True, ~pair))
                long = np.flatnonzero(top.high > top.low)
                new, fresh = named(sym[top.low], long, sym[top.low][long].astype(np.int64) * fresh + sym[top.high][long], fresh)
            self.levels.append(Level(new))

    def agree(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many words agree from places i and j on (or up to them, leftwards)."""
        if len(i) > PAIRS:
            return np.concatenate([self.agree(i[k : k + PAIRS], j[k : k + PAIRS], forward) for k in range(0, len(i), PAIRS)])
        x, y, top = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        rising = np.arange(len(i))
        for depth, level in enumerate(self.levels):
            parent = level.first if forward else level.last
            risen = []
            while len(rising):
                same = level.sym[x[rising]] == level.sym[y[rising]]
                top[rising[~same]] = depth
                rising = rising[same]
                if parent is not None:
                    up = (parent[x[rising]] >= 0) & (parent[y[rising]] >= 0)
                    risen.append(rising[up])
                    rising = rising[~up]
                self._move(level, x, y, rising, forward)
            if not risen:
                break
            rising = np.concatenate(risen)
            x[rising], y[rising] = parent[x[rising]], parent[y[rising]]
        for depth in range(len(self.levels) - 2, -1, -1):
            level = self.levels[depth]
            child = level.low if forward else level.high
            falling = np.flatnonzero(top > depth)
            x[falling], y[falling] = child[x[falling]], child[y[falling]]
            while len(falling):
                falling = falling[level.sym[x[falling]] == level.sym[y[falling]]]
                self._move(level, x, y, falling, forward)
        return x - i if forward else i - x

    @staticmethod
    def _move(level: Level, x: np.ndarray, y: np.ndarray, who: np.ndarray, forward: bool) -> None:
        """Pass the symbols that agree: one, or as many as both stretches of it have left."""
        left = level.ahead if forward else level.behind
        by = 1 if left is None else np.minimum(left[x[who]], left[y[who]])
        x[who] += by if forward else -by
        y[who] += by if forward else -by


def found_runs(seq: np.ndarray, longest: int, texts: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of a sequence of `texts` texts, the longest with so many words."""
    grammar = None
    upto, by = np.zeros(len(seq), np.int64), np.ones(len(seq), np.int64)  # of the run that reaches furthest from a place
    out: dict[tuple[int, int], int] = {}
    low = 1
    while low <= longest // REPEATS:
        # periods up to twice the least: none divides another, so runs found before tell all that may be skipped
        heads, rest = [], []
        for q in range(low, min(2 * low, longest // REPEATS + 1)):
            grid = seq[::q]
            same = grid[1:] == grid[:-1]
            hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
            if len(hit):
                head = np.append(True, np.diff(hit) > 1)
                heads.append((hit[head] * q, np.full(head.sum(), q)))
                rest.append((hit[~head] * q, np.full((~head).sum(), q)))
        low *= 2
        for part in (heads, rest):
            if not part:
                continue
            at, q = (np.concatenate(x) for x in zip(*part))
            new = ~((upto[at] > at + 3 * q) & (q % by[at] == 0))
            at, q = at[new], q[new]
            if not len(at):
                continue
            grammar = grammar or Grammar(seq, 2 * texts + 2)
            end = at + q + grammar.agree(at, at + q)
            start = at - grammar.agree(at - 1, at + q - 1, forward=False)
            enough = end - start >= np.maximum(LEAST, REPEATS * q)
            for s, e, p in sorted(set(zip(start[enough].tolist(), end[enough].tolist(), q[enough].tolist())), key=lambda r: r[2]):
                if out.setdefault((s, e), p) == p:
                    further = s + np.flatnonzero(upto[s:e] < e)
                    upto[further], by[further] = e, p
    return sorted((s, e, p) for (s, e), p in out.items())


def _chunks(texts: list) -> list[list[list[bytes]]]:
    """The texts' words, in chunks of about CHUNK words."""
    part, size = [], 0
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if part and size + len(words) > CHUNK:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def word_runs(split: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text's words its runs (start, length, period), by start, then period."""
    sizes = np.array([len(w) for w in split])
    flat = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes + 1) - sizes
    seq = np.zeros(len(flat) + len(split) + 1, np.int64)
    edge = np.append(begin - 1, len(seq) - 1)
    words = np.ones(len(seq), bool)
    words[edge] = False
    seq[words], seq[edge] = flat + len(edge), np.arange(len(edge))
    out: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for s, e, p in found_runs(seq, int(sizes.max(initial=0)), len(split)):
        k = int(np.searchsorted(begin, s, "right")) - 1
        out[k].append((s - int(begin[k]), e - s, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and those of each run's first period, less what another run drops; joined by a blank."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(keep)]
    return b" ".join(words)


def _scan(batches):
    for pdf in batches:
        k = 0
        for split in _chunks(pdf["text"].tolist()):
            found = word_runs(split)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].iloc[k : k + len(split)].array, "n_words": [len(w) for w in split],
                "runs": [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found],
                "collapsed": [collapsed(w, runs).decode("utf-8", "replace") for w, runs in zip(split, found)],
            })
            k += len(split)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (text without the repeats of its runs)."""
    # as text, since a column of whole numbers with nulls would turn to doubles on its way
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_scan, f"doc_id string, n_words long, runs array<{RUN}>, collapsed string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def echoed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the end of every tenth text, by crc32 of the id, repeated from a place on with a period of its own."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", g.alias("__g"), F.when(h % 10 == 0, words).alias("__w")).withColumn("__n", F.size("__w").cast("long"))
    start = F.col("__g") % F.col("__n")
    period = 1 + F.floor((F.col("__n") - start) / (3 + F.col("__g") % 8))
    place = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, start)).withColumn("__p", F.when(F.col("__n") > 0, period))
    new = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: F.element_at("__w", (place(i) + 1).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("__a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (ties: least start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int"))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    top = found.select("*", F.when(F.size("runs") > 0, longest[0]).alias("top"))
    lines = F.aggregate("runs", F.lit(""), lambda all_, r: F.concat(all_, line(r), F.lit("\n")))
    exponent: Column = F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        exponent.alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )
