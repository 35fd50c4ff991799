"""DuckDB SQL for the operators that SQL can express.

The quality rules, the classifier and the pipeline rest on trained models, sharding on a search over capacities, line
de-duplication and secret scans on hashes and tests that DuckDB lacks: those are held against plain code in the tests.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .urls import LABELLED, LEAST, MANY, NEAR, PRIOR, RARE, REJECT_AT, RULES, SLACK

#: Levels of the path-template tree that the SQL spells out; the tables' paths end before.
SQL_LEVELS = 4
FOLD = f"translate(text, '{UPPER}', '{LOWER}')"

PREFERENCE = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t FROM r GROUP BY conv_id),
k AS (SELECT *, md5(t[1].role || chr(0) || t[1].text) AS opening FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY coalesce(substr(md5(CAST(conv_id AS VARCHAR)), 1, 3), 'nul'), conv_id) - 1 AS nth FROM k),
j AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.t AS a, b.t AS b FROM p a LEFT JOIN p b ON a.opening = b.opening AND b.nth = a.nth + 1 WHERE a.nth % 2 = 0),
n AS (SELECT *, CASE WHEN b IS NULL THEN len(a) - coalesce(nullif(list_position(list_reverse([x.role for x in a]), 'assistant'), 0), 1)
             ELSE coalesce(list_min([i - 1 for i in range(1, least(len(a), len(b)) + 1) if a[i] <> b[i]]), least(len(a), len(b))) END AS n FROM j),
m AS (SELECT *, a[n + 1:] AS ra, b[n + 1:] AS rb FROM n)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt_turns, """ + ", ".join(
    f"{guard}coalesce(array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) for x in {part}], ''), ''){end} AS {name}"
    for name, part, guard, end in (("prompt", "a[1:n]", "", ""), ("chosen", "ra", "", ""), ("rejected", "rb", "CASE WHEN b IS NOT NULL THEN ", " END"))
) + ", " + ", ".join(
    f"""{guard}coalesce(array_to_string(list_transform(list_filter(range(1, len({part}) + 1), lambda i: {part}[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum([len(x.role) + len(x.text) + 13 for x in {part}[1:i - 1]]), 0) + len({part}[i].role) + 5 AS BIGINT) || ':' ||
    CAST(coalesce(list_sum([len(x.role) + len(x.text) + 13 for x in {part}[1:i - 1]]), 0) + len({part}[i].role) + 5 + len({part}[i].text) AS BIGINT)), ','), ''){end} AS {name}"""
    for name, part, guard, end in (("chosen_spans", "ra", "", ""), ("rejected_spans", "rb", "CASE WHEN b IS NOT NULL THEN ", " END"))
) + " FROM m"

WORDS = r"regexp_extract_all(" + FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""
WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND array_to_string(w[i:i + pos.n - 1], ' ') = g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

MIXTURE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
r AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, sum(source_size) OVER () AS total FROM o),
l AS (SELECT *, CAST(total - coalesce(sum(source_size * 3) OVER f, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level, row_number() OVER (ORDER BY source_size * 3 / w, source ASC NULLS LAST) AS nth
      FROM r WINDOW f AS (ORDER BY source_size * 3 / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), coalesce((SELECT level FROM l WHERE level <= source_size * 3 / w ORDER BY nth LIMIT 1), 0) * w) AS target FROM l),
k AS (SELECT s.*, t.source_size, t.target, row_number() OVER (PARTITION BY s.source ORDER BY size, substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), doc_id) - 1 AS r,
             ('0x' || substr(md5('17:' || coalesce('s' || s.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor((r + 1) * e + u) - floor(r * e + u) AS BIGINT) AS copies, CAST(floor((r + 1) * e + u) - floor(r * e + u) AS BIGINT) * size AS taken FROM k
"""


SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS}, []) AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
"""


def _url_filter() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1]), r[1]), reverse=False)
    fits = [(what, rule, *rule.partition("/")[::2]) for what, rule in order]
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{pick(w, r)}'" for w, r, h, p in fits) + " END"
    out = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, {case(lambda w, r: r)} AS rule, {case(lambda w, r: w)} AS ruled, [regexp_replace(x, '[0-9]+', '#', 'g') for x in string_split(path, '/') if x <> ''] AS sh FROM u),
rows_ AS (SELECT *, CAST(ruled = 'block' AS INTEGER) AS bad FROM r),
l0 AS (SELECT host, sh, count(*) AS n, count(bad) AS known, coalesce(sum(bad), 0) AS bad, '' AS t, len(sh) = 0 AS done FROM rows_ GROUP BY host, sh)"""
    for d in range(SQL_LEVELS):
        out += f""",
a{d} AS (SELECT *, sh[{d + 1}] AS seg, coalesce(sh[{d + 2}], '') AS nxt FROM l{d} WHERE NOT done),
s{d} AS (SELECT host, t, seg, nxt, sum(n) AS n, sum(known) AS known, sum(bad) AS bad, count(*) AS leaves FROM a{d} GROUP BY ALL),
c{d} AS (SELECT host, t, seg, sum(n) AS cn, sum(known) AS ck, sum(bad) AS cb, sum(leaves) AS leaves FROM s{d} GROUP BY ALL),
p{d} AS (SELECT *, sum(cn) OVER w AS pn, count(*) OVER w AS kids, sum(leaves) OVER w AS every FROM c{d} WINDOW w AS (PARTITION BY host, t)),
h{d} AS (SELECT *, sum(n) OVER (PARTITION BY host, t, nxt) AS m FROM s{d}),
g{d} AS (SELECT host, t, seg, sum(greatest(CAST(h.n AS DOUBLE) / cn - CAST(m AS DOUBLE) / pn, 0)) AS gap FROM h{d} h JOIN p{d} USING (host, t, seg) GROUP BY ALL),
n{d} AS (SELECT host, t, seg, every = 1 AS alone, CASE WHEN kids >= {MANY} AND cn < {RARE}::DOUBLE * pn THEN '*' WHEN kids > 1 AND cn >= {LEAST} AND gap <= {NEAR}::DOUBLE + {SLACK}::DOUBLE / sqrt(cn)
         THEN CASE WHEN ck = 0 THEN '+' WHEN 2 * cb >= ck THEN '+bad' ELSE '+good' END ELSE '=' || seg END AS name FROM p{d} JOIN g{d} USING (host, t, seg)),
l{d + 1} AS (SELECT host, sh, n, known, bad, t, done FROM l{d} WHERE done UNION ALL
  SELECT host, sh, n, known, bad, t || '/' || name || CASE WHEN alone THEN array_to_string(['/=' || x for x in sh[{d + 2}:]], '') ELSE '' END, alone OR len(sh) <= {d + 1} FROM a{d} JOIN n{d} USING (host, t, seg))"""
    last = f"l{SQL_LEVELS}"
    return out + f""",
top AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(known), 0), 0) AS top FROM {last}),
own AS (SELECT host, t, sum(known) AS k, sum(bad) AS b FROM {last} GROUP BY ALL),
hs AS (SELECT host, sum(k) AS hk, sum(b) AS hb FROM own GROUP BY 1),
sh AS (SELECT host, t, k, (b + {PRIOR}::DOUBLE * ((hb - b + {PRIOR}::DOUBLE * top) / (hk - k + {PRIOR}::DOUBLE))) / (k + {PRIOR}::DOUBLE) AS share FROM own JOIN hs USING (host), top),
rej AS (SELECT host, l.sh FROM {last} l JOIN sh s USING (host, t) WHERE s.k >= {LABELLED} AND share >= {REJECT_AT}::DOUBLE)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN rej.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM rows_ LEFT JOIN rej USING (host, sh)"""


ORACLE_SQL: dict[str, str] = {
    "op1_preference_format": PREFERENCE,
    "op3_decontaminate": DECONTAMINATE,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op6_mixture": MIXTURE,
    "op9_url_filter": _url_filter(),
    "op11_ranked_search": SEARCH,
}
