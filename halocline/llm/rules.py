"""Quality rules (operator 2): base counts of a text and a calibrated hashed n-gram verdict.

Defined results: a null text counts as empty (all counts 0, base_failed); an empty table gives no rows; a repeated
row gives a repeated result; other columns of the input are ignored.  Whole texts are read, however long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import SPACE
from .textmodel import logits, probability, train

#: Fixed thresholds of the verdict: the least calibrated probability of good quality that is kept.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        v = len(number)
        # a pair of word numbers is renumbered before the third joins it, so no product can overflow
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        windows = pair[:-1].astype(np.int64) * v + ids[2:]
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        often = count[inverse] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= often
        repeated = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 4000, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: base counts, base_failed, calibrated p_good, kept.

    sample bounds the labelled rows that the model is fitted on; every document is scored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample=sample).plain())

    def score(batches):
        weights, slope, offset = model.value
        for pdf in batches:
            rows = np.array([base_counts(t or "") for t in pdf["text"]], dtype=np.int64).reshape(-1, 5)
            failed = (rows[:, 0] < MIN_WORDS) | (100 * rows[:, 4] > MAX_REPEAT_PERCENT * rows[:, 0])
            p = probability(logits(pdf["text"], weights), slope, offset) if len(pdf) else np.empty(0)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_words": rows[:, 0], "word_chars": rows[:, 1], "n_symbols": rows[:, 2], "n_dup_lines": rows[:, 3],
                "n_repeat_words": rows[:, 4], "base_failed": failed, "p_good": p, "kept": ~failed & (p >= keep_at),
            })

    return docs.select("doc_id", "text").mapInPandas(score, SCHEMA)
