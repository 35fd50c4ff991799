"""Secret scans (operator 10): fixed patterns, and tokens that pass a battery of randomness tests.

A token is a run of 20 or more characters of the base-64 alphabets that meets no fixed pattern's span; '=' ends it, so in
`name=KEY` the key is a token of its own, without padding.  Its encoding is
inferred as the smallest alphabet that holds it.  Five tests give p-values under randomness: chi-squared uniformity over
the alphabet, runs about the middle of the alphabet, serial correlation, shares of lower case, upper case, digits and
signs, and surplus of vowels.  Fisher's sum combines them to one figure, large for a random token.

What is reported are random tokens, so the hypothesis to reject is that a token is an ordinary name, path or number.  Every
stretch of a text gives one such name, made of its own words, and the figures of all of them are the null distribution of
their encoding and length class: a token's p-value is the share of ordinary names that look as random as it does.
Benjamini and Hochberg's rule at Q within each class then bounds the expected share of ordinary tokens among the spans of kind
'random'.

The classes' thresholds come from counts of figures in bins: a bounded table, whatever the corpus.

Defined results: null text is empty, with no spans; a corpus without words has no null distribution and no random spans; an empty table gives no rows; repeated rows are scanned one by one; texts
are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Alphabets by name, smallest first (fixed values).
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
    "base64any": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
LENGTHS = (20, 24, 32, 48)
Q = 0.05
#: Figures are counted in so many bins, equal in their fourth root, so that small ones are told apart.
BINS = 400
#: Characters of a stretch of text that gives one ordinary name; weight of all encodings' names of a length in a class's.
STRETCH, POOLED = 400, 5
NAME_PART = re.compile(r"[A-Za-z]{2,}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<s:int,k:int,e:int>>, found array<struct<s:int,e:int,c:string,p:int>>, names array<struct<c:string,p:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = []
    folded = text.lower()
    if any(w in folded for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: Of each byte the alphabets that hold it, a bit each, and its kind: lower case, upper case, digit, sign; the alphabets' shares of kinds.
_HELD = np.zeros(256, np.int64)
for _k, _abc in enumerate(ALPHABETS.values()):
    _HELD[list(_abc.encode())] |= 1 << _k
_KIND = np.full(256, 3)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
    _KIND[list(_chars.encode())] = _k
_VOWEL = np.isin(np.arange(256), list(b"aeiouAEIOU"))


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in x.tolist()])


def _chi2_tail(x: np.ndarray, df: float) -> np.ndarray:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    z = ((np.maximum(x, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * _erfc(z / math.sqrt(2))


def combined(raw: np.ndarray, n: np.ndarray, alphabet: str) -> np.ndarray:
    """Combined p-values of tokens, one after another in raw and n bytes long, under uniform random choice from the alphabet.

    The last two of the five tests, of the shares of kinds of characters and of more vowels among letters than chance gives, are those by
    which words, paths, names and numbers stand out.
    """
    size, abc = len(alphabet), np.frombuffer(alphabet.encode(), np.uint8)
    at = np.zeros(256, np.int64)
    at[abc] = np.arange(size)
    x, token, start = at[raw], np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    total = lambda v: np.add.reduceat(v, start)
    within = token[1:] == token[:-1]
    counts = np.bincount(token * size + x, minlength=len(n) * size).reshape(-1, size)
    ps = [_chi2_tail((counts * counts).sum(axis=1) * size / n - n, size - 1)]
    high = x >= size / 2
    a = total(high.astype(np.int64))
    b = n - a
    runs = 1 + np.bincount(token[1:][within & (high[1:] != high[:-1])], minlength=len(n))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        off = np.where(var > 0, np.abs(runs - mean) / np.sqrt(2 * np.maximum(var, 1e-300)), 0.0)
        ps.append(np.where((a > 0) & (b > 0), _erfc(off), 2.0 ** (1.0 - n)))
        dev = x - (total(x) / n)[token]
        var = total(dev * dev)
        both = np.bincount(token[1:][within], weights=(dev[1:] * dev[:-1])[within], minlength=len(n))
        r = np.where(var > 0, both / var, 1.0)
    ps.append(_erfc(np.abs(r * np.sqrt(n)) / math.sqrt(2)))
    kinds = np.bincount(token * 4 + _KIND[raw], minlength=4 * len(n)).reshape(-1, 4)
    of = np.bincount(_KIND[abc], minlength=4)
    want = n[:, None] * of[None, :] / size
    ps.append(_chi2_tail((((kinds - want) ** 2)[:, of > 0] / want[:, of > 0]).sum(axis=1), int((of > 0).sum()) - 1))
    letters, share = kinds[:, 0] + kinds[:, 1], _VOWEL[abc].sum() / (of[0] + of[1])
    off = (total(_VOWEL[raw].astype(np.int64)) - letters * share) / np.sqrt(np.maximum(letters, 1) * share * (1 - share))
    ps.append(np.where(letters > 0, 0.5 * _erfc(off / math.sqrt(2)), 1.0))
    # chi-squared, two degrees of freedom a test; without letters there are four
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in ps)
    terms = [half**k / math.factorial(k) for k in range(5)]
    return np.minimum(1.0, np.exp(-half) * (terms[0] + terms[1] + terms[2] + terms[3] + np.where(letters > 0, terms[4], 0.0)))


def battery(token: str, alphabet: str) -> float:
    """Combined p-value of one token."""
    return float(combined(np.frombuffer(token.encode(), np.uint8), np.array([len(token)]), alphabet)[0])


def encoding(token: str) -> str | None:
    have = set(token)
    return next((name for name, abc in ALPHABETS.items() if have <= set(abc)), None)


def figures(found: list[str]) -> list[tuple[str, int] | None]:
    """Class (encoding and length) of each token and the bin of its combined p-value; None for those too short or of no alphabet."""
    out: list[tuple[str, int] | None] = [None] * len(found)
    tried = [k for k, t in enumerate(found) if len(t) >= LENGTHS[0] and t.isascii()]
    if not tried:
        return out
    raw, n = np.frombuffer("".join(found[k] for k in tried).encode(), np.uint8), np.array([len(found[k]) for k in tried])
    held = np.bitwise_and.reduceat(_HELD[raw], np.cumsum(n) - n)
    token = np.repeat(np.arange(len(n)), n)
    for k, (name, abc) in enumerate(ALPHABETS.items()):
        mine = (held >> k & 1 == 1) & (held & ((1 << k) - 1) == 0)
        if mine.any():
            p = combined(raw[mine[token]], n[mine], abc)
            length = np.array(LENGTHS)[np.searchsorted(LENGTHS, n[mine], "right") - 1]
            for j, w, size in zip(np.flatnonzero(mine).tolist(), np.minimum(BINS - 1, (p**0.25 * BINS).astype(int)).tolist(), length.tolist()):
                out[tried[j]] = (f"{name}:{size}", w)
    return out


def token_spans(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Where tokens stand that meet no base span."""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        if not any(s < end and start < e for s, _, e in base[max(0, at - len(KINDS)) : at + 1]):
            out.append((start, end))
    return out


def tokens(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, str, int]]:
    """(start, end, class, bin) of the tokens that meet no base span."""
    spans = token_spans(text, base)
    return [(*at, *got) for at, got in zip(spans, figures([text[s:e] for s, e in spans])) if got]


def ordinary(words: list[str], seed: int) -> str:
    """A name, path or number as people write them, of the given words, its style and length chosen by seed."""
    style, length = seed % 9, 20 + (seed >> 8) % 24 * (1 + (seed >> 16) % 3)
    if style == 8:
        return str(seed * 0x9E3779B97F4A7C15 % 10**18 * 10**30 + (seed * 0xC2B2AE3D27D4EB4F) ** 2 % 10**30)[: min(length, 40)]
    parts, size = [], 0
    for k, w in enumerate(words):
        digits = str((seed >> k % 40) % 10 ** (1 + k % 3))
        w = (w.capitalize(), w.capitalize() + digits * (k % 2), w.lower() + "_", w.lower() + "-", w.lower() + "/", w.lower() + digits * (style == 5 and k % 2), w.upper() + digits * (seed >> 30 & 1), w.capitalize() + "-" + digits + "/")[style]
        parts.append(w)
        size += len(w)
        if size >= length:
            break
    return "".join(parts)[:length].rstrip("-_/")


def names(text: str) -> list[str]:
    """The ordinary names that the text's stretches give, one each."""
    out = []
    for k in range(max(1, len(text) // STRETCH)):
        part = text[k * STRETCH : (k + 1) * STRETCH]
        out.append(ordinary(NAME_PART.findall(part), xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"))))
    return out


def _scan(batches):
    for pdf in batches:
        for at in range(0, len(pdf), 200):  # tokens and names of so many texts are tested at once
            yield _scanned(pdf.iloc[at : at + 200])


def _scanned(pdf: pd.DataFrame) -> pd.DataFrame:
    empty = hashlib.sha256(b"").hexdigest()
    rows, spans, found, made, every = [], [], [], [], []
    for text in pdf["text"]:
        text = text or ""
        base = base_spans(text)
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        sha = hashlib.sha256(joined(base).encode()).hexdigest() if base else empty
        rows.append((*n, sha, [{"s": s, "k": k, "e": e} for s, k, e in base]))
        spans.append(token_spans(text, base))
        own = names(text)
        found.append(len(every))
        every += [text[s:e] for s, e in spans[-1]]
        made.append((len(every), len(every) + len(own)))
        every += own
    got = figures(every)
    out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base"])
    out["found"] = [[{"s": s, "e": e, "c": f[0], "p": f[1]} for (s, e), f in zip(own, got[k : k + len(own)]) if f] for own, k in zip(spans, found)]
    out["names"] = [[{"c": f[0], "p": f[1]} for f in got[a:b] if f] for a, b in made]
    out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
    return out


def binned(rows: DataFrame, of: str) -> dict[str, np.ndarray]:
    """Counts per class and bin."""
    counts = rows.select(F.explode(of).alias("f")).groupBy("f.c", "f.p").agg(F.count(F.lit(1)).alias("n")).collect()  # at most classes x BINS rows
    out: dict[str, np.ndarray] = {}
    for r in counts:
        out.setdefault(r["c"], np.zeros(BINS, np.int64))[r["p"]] += r["n"]
    return out


def thresholds(rows: DataFrame, q: float = Q) -> dict[str, int]:
    """Per class the first bin whose tokens are reported (none: BINS), by Benjamini and Hochberg.

    A class's null distribution is that of its own ordinary names, with those of its length class in all encodings
    counting as POOLED names more; where there are neither, nothing is reported.
    """
    found, null = binned(rows, "found"), binned(rows, "names")
    upto = lambda x: np.cumsum(x[::-1])[::-1]
    pooled: dict[str, np.ndarray] = {}
    for name, x in null.items():
        length = name.split(":")[1]
        pooled[length] = pooled.get(length, 0) + x
    out = {}
    for name, x in found.items():
        every = pooled.get(name.split(":")[1])
        out[name] = BINS
        if every is not None:
            own = null.get(name, np.zeros(BINS, np.int64))
            p = (1 + upto(own) + POOLED * upto(every) / every.sum()) / (1 + own.sum() + POOLED)
            passed = np.flatnonzero((upto(x) > 0) & (p * x.sum() <= q * upto(x)))
            if len(passed):
                out[name] = int(passed[0])
    return out


def scanned(docs: DataFrame, q: float = Q) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = written(docs.select("doc_id", "text").mapInPandas(_scan, SCHEMA), "scans")
    limit = F.create_map(*[F.lit(x) for pair in ({"": BINS} | thresholds(rows, q)).items() for x in pair])
    kept = F.filter("found", lambda f: f["p"] >= F.coalesce(F.try_element_at(limit, f["c"]), F.lit(BINS)))
    added = F.transform(kept, lambda f: F.struct(f["s"].alias("s"), F.lit(3).alias("k"), f["e"].alias("e")))
    every = F.array_sort(F.concat(F.col("base"), added))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(kept).cast("long").alias("n_random"))
