"""Tokens of any inferable encoding are tested; of the reported ones few are ordinary, of the keys few are missed."""

import random
import re

import pandas as pd

from halocline.llm import secrets

SF = "/root/testdata/sf0.1"


def test_keys_with_few_digits_are_tested():
    rnd = random.Random(3)
    base62 = secrets.ALPHABETS["base62"]
    keys = ["".join(rnd.choice(base62) for _ in range(20)) for _ in range(2000)]
    few = [k for k in keys if sum(c.isdigit() for c in k) < 2]
    assert len(few) > 100 and all(secrets.tokens(k) for k in few)
    assert sum(secrets.battery(k, base62) < 0.001 for k in keys) < 0.01 * len(keys)
    upper = ["".join(rnd.choice(secrets.ALPHABETS["base32"][:26]) for _ in range(32)) for _ in range(50)]
    assert all(secrets.tokens(k) for k in upper)
    assert secrets.tokens("aB+3/k-9_Qx7Lm2Zp8Rt5Wv") and secrets.tokens("0123456789abcdef0123")


def test_words_paths_and_numbers_stand_out():
    for word in ("state-of-the-art-solutions", "internal/documents/archive", "configuration_file_names", "12345678901234567890123", "InternationalStandardOrganization"):
        name = secrets.encoding(word)
        assert secrets.battery(word, secrets.ALPHABETS[name]) < 0.01, word


def test_tokens_that_meet_base_spans_are_left_out():
    text = "password = abcDEF123456ghiJKL789 and 0123456789abcdef01234567 qQ7w9Ee2rT4yU8iO1pA3sD"
    assert [t[:2] for t in secrets.tokens(text, secrets.base_spans(text))] == [(text.index("qQ7"), len(text))]


CODE = """get set user table name join parse http response json object render template page return profile settings backup max connection pool size
 per host main java example service docs release notes beta build linux candidate internal server error allowed packet abstract singleton proxy factory bean
 convert xml validate schema assets image icons arrow left module utils index config cache token stream buffer queue worker default handler request""".split()


def identifier(rnd):
    """A name as programs have them, of other words than the corpus has."""
    some = [rnd.choice(CODE) for _ in range(rnd.randrange(4, 8))]
    digits = rnd.choice(["", "", "2", "404", "2024"])
    style = rnd.randrange(4)
    if style == 0:
        return some[0] + "".join(w.capitalize() for w in some[1:]) + digits
    if style == 1:
        return "".join(w.capitalize() + (digits if k == 1 else "") for k, w in enumerate(some))
    return ("_", "/")[style - 2].join([*some, digits] if digits else some)


def test_ordinary_tokens_alone_are_not_reported(spark):
    rnd = random.Random(7)
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.dropna().tolist()[:3000]
    rows = [(i, re.sub("[0-9a-f]{24,}", "", t) + " " + identifier(rnd)) for i, t in enumerate(texts)]
    out = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).agg({"n_random": "sum"}).first()[0]
    assert out <= 30, out


def test_few_ordinary_tokens_reported_few_keys_missed(spark):
    rnd = random.Random(11)
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.dropna().tolist()
    words = [w for t in texts[::70] for w in re.findall("[A-Za-z]{2,}", t)]

    def plain():
        if rnd.random() < 0.5:
            return identifier(rnd)
        at = rnd.randrange(len(words) - 12)
        some, sep = words[at : at + rnd.randrange(3, 9)], rnd.choice(["", "_", "-", "/"])
        return sep.join(w.capitalize() if not sep else w.lower() for w in some) + rnd.choice(["", "2", "2024"])

    def key():
        abc = secrets.ALPHABETS[rnd.choice(["base62", "base64", "base64url", "base32", "lower36"])]
        return "".join(rnd.choice(abc) for _ in range(rnd.choice([24, 32, 40, 64])))

    rows, truth = [], {}
    for i, t in enumerate(texts):
        truth[i], out = [], t.replace("\n", " ")
        for make, share in ((plain, 0.3), (key, 0.1)):
            if rnd.random() < share:
                token, before = make(), " " + rnd.choice(["", "", "", "sig=", "client_id=", "https://h.org/p?a=1&sig="])
                truth[i].append((len(out) + len(before), len(out) + len(before) + len(token), make is key))
                out += before + token
        rows.append((i, out))
    got = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    caught = missed = false = 0
    for r in got:
        spans = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("random")]
        hit = lambda a, b: any(s < b and a < e for s, e in spans)  # noqa: B023, E731
        base = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x and not x.startswith("random")]
        keys = [(a, b) for a, b, real in truth[r["doc_id"]] if real and not any(s < b and a < e for s, e in base)]
        caught += sum(hit(a, b) for a, b in keys)
        missed += sum(not hit(a, b) for a, b in keys)
        false += sum(not any(s < b and a < e for a, b in keys) for s, e in spans)
    assert caught > 500 and caught >= 0.9 * (caught + missed) and caught >= 0.9 * (caught + false), (caught, missed, false)


def test_a_key_behind_an_equals_sign_is_a_token():
    rnd = random.Random(5)
    key = "".join(rnd.choice(secrets.ALPHABETS["base62"]) for _ in range(32))
    for before, after in (("sig=", ""), ("client_id=", "=="), ("https://h.org/p?a=1&sig=", "&b=2"), ("a=", "="), ("", "")):
        got = secrets.tokens(before + key + after)
        assert [(s, e) for s, e, *_ in got if e - s == 32] == [(len(before), len(before) + 32)], before
        assert [g[2:] for g in got if g[1] - g[0] == 32] == [g[2:] for g in secrets.tokens(key)]
    assert [t[:2] for t in secrets.tokens(f"x={key}&y={key}")] == [(2, 34), (37, 69)]


def test_figures_of_many_tokens_are_those_of_each():
    rnd = random.Random(6)
    some = ["".join(rnd.choice(abc) for _ in range(rnd.randrange(20, 70))) for abc in secrets.ALPHABETS.values() for _ in range(20)] + ["short", "", "A" * 30, "12345678901234567890", "\u00e9" * 25, "x.y" * 10]
    rnd.shuffle(some)
    assert secrets.figures(some) == [secrets.figures([t])[0] for t in some]
    for t, got in zip(some, secrets.figures(some)):
        assert (got is None) == (len(t) < 20 or secrets.encoding(t) is None)
        assert got is None or got[0].split(":")[0] == secrets.encoding(t)
