"""DuckDB SQL for the queries that SQL can express.

The texts are built from the operators' own patterns and rules, but follow other
ways: pairs of shingles and a recursive closure for the Jaccard join, positions
from split texts for scans.
"""

from __future__ import annotations

import re

from . import licenses, secrets

TOP_K = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 100 = 0) q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b)::BIGINT AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a JOIN documents d ON d.doc_id = r.a GROUP BY d.doc_id
""".replace("SELECT doc_id, coalesce", "SELECT d.doc_id, coalesce")


#: Every window by its digest; runs of repeated windows that touch become one span, and what lies between spans is kept. Passages: the same by words.
SUFFIX = rf"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(b[p + 1:p + 400]) AS h FROM (SELECT *, unnest(range(0, n - 399)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
i AS (SELECT *, sum(CASE WHEN last IS NULL OR p > last + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY doc_id, k),
l AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM s GROUP BY 1),
v AS (SELECT doc_id, list_transform(list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: coalesce(nullif(
  regexp_replace(regexp_replace(x, '^[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+$', ''), ''), x)) AS v FROM documents),
vw AS (SELECT doc_id, p, count(*) OVER (PARTITION BY md5(array_to_string(v[p + 1:p + 51], ' '))) AS c FROM (SELECT *, unnest(range(0, len(v) - 50)) AS p FROM v)),
vl AS (SELECT doc_id, count(*) FILTER (last IS NULL OR p > last + 50) AS passages
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM vw WHERE c > 1) GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN b ELSE list_reduce(list_transform(range(0, spans + 1),
    lambda j: b[coalesce(ends[j], 0) + 1:coalesce(starts[j + 1], n)]), lambda x, y: x || y) END) AS kept_sha256, coalesce(passages, 0)::BIGINT AS n_passages
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN vl ON vl.doc_id = d.doc_id
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan() -> str:
    """RE2 has no look-around, so keys are runs of their characters (and =) of just the right length."""
    parts = []
    for i, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        good = f"length(q[i]) >= {least}"
        if kind == "key":
            pattern, good = "[A-Za-z0-9+/=]+", f"length(m[i]) = {least} AND NOT contains(m[i], '=')"
        p = _text(pattern)
        parts.append(f"""SELECT doc_id, ord, kind, i, length(g[i]) AS gap, length(m[i]) AS size, {good} AS good FROM (
  SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {i} AS ord, '{kind}' AS kind, string_split_regex(t, {p}) AS g,
    regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS q FROM d WHERE regexp_matches(t, {p})))""")
    near = lambda what: "EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = w.doc_id AND o.kind IN ({}) AND o.start <= w.stop + {} AND o.stop >= w.start - {})".format(
        ", ".join(_text(k) for k, v in secrets.SUPPLIES.items() if v == what), secrets.SCOPE, secrets.SCOPE
    )
    strong = ", ".join(map(_text, secrets.STRONG))
    weak = " OR ".join(f"(kind = '{k}' AND {' AND '.join(map(near, needs))})" for k, needs in secrets.NEEDS.items())
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT doc_id, ord, kind, stop - size AS start, stop FROM (
  SELECT *, (sum(gap + size) OVER (PARTITION BY doc_id, ord ORDER BY i))::BIGINT AS stop FROM hits) WHERE good),
kept AS (SELECT * FROM spans w WHERE kind IN ({strong}) OR {weak}),
sums AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.STRONG)},
  {listed} FILTER (kind IN ({strong})) AS base, {listed} AS spans FROM kept GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""


def license_scan() -> str:
    """Words are joined by two spaces, so that neighbouring matches, which take a space on both sides, don't share one."""
    rows = []
    for r in licenses.rules():
        p = r.pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])").replace(" ?", "(?:  )?")
        p = p.replace("(?:  )?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
        whole = " " + p + " " if re.search(r"(?<!\\)\((?!\?)", p) else " (" + p + ") "
        rows.append(f"({_text(r.label)}, {r.priority}, {r.weight}, {_text(whole)})")
    base = " UNION ALL ".join(
        f"SELECT doc_id, {_text(label)} AS label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + {len(p.split())}], ' ') = {_text(p)})) AS place FROM w" for p, label in licenses.BASE.items()
    )
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS t FROM w),
rules(label, priority, weight, pattern) AS (VALUES {", ".join(rows)}),
base AS ({base}),
hits AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, label, priority, weight, pattern, string_split_regex(t, pattern) AS g, regexp_extract_all(t, pattern) AS m, regexp_extract_all(t, pattern, 1) AS own
  FROM t JOIN rules ON regexp_matches(t, pattern))),
found AS (SELECT doc_id, label, priority, weight, (sum(len(string_split(g[i], ' ')) - 1) OVER k + coalesce(sum(len(string_split(m[i], ' ')) - 1) OVER e, 0)) // 2
    + len(list_filter(string_split(m[i], ' '), lambda x: x <> '')) - len(list_filter(string_split(own[i], ' '), lambda x: x <> '')) AS start,
    len(list_filter(string_split(own[i], ' '), lambda x: x <> '')) AS size FROM hits
  WINDOW k AS (PARTITION BY doc_id, label, priority, pattern ORDER BY i), e AS (PARTITION BY doc_id, label, priority, pattern ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, size DESC, start, label) AS k FROM found),
kept AS (SELECT * FROM ranked a WHERE NOT EXISTS (
  SELECT 1 FROM ranked b WHERE b.doc_id = a.doc_id AND b.k < a.k AND b.start <= a.start AND a.start + a.size <= b.start + b.size)),
labels AS (SELECT doc_id, label, weight FROM kept UNION ALL SELECT DISTINCT doc_id, label, 0.5 FROM base),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(1 - product(1 - weight::DOUBLE), 9) AS score FROM labels GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0)::DOUBLE AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id
"""


#: CRC-32 of the column w of a table: a table of 256 steps, and one step for each byte.
_STEPS = "steps AS (SELECT list(list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"


def _crc(w: str) -> str:
    hexes = f"hex(encode({w}))"
    octets = f"list_transform(range(1, octet_length(encode({w})) + 1), lambda k: ('0x' || substr({hexes}, 2 * k - 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295)"


def _features(name: str, key: str) -> str:
    """Words of single texts, which are the features of width 1."""
    return rf"(SELECT {key} AS doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {name})"


RESAMPLE = f"""
WITH {_STEPS},
d AS {_features("documents", "doc_id")},
b AS {_features("benchmark", "item_id")},
words AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT DISTINCT unnest(w) AS w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)), steps),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM dw JOIN words USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) JOIN words USING (w) GROUP BY 1),
gain AS (SELECT k.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) k LEFT JOIN s ON s.bucket = k.bucket LEFT JOIN t ON t.bucket = k.bucket),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN words USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights ON weights.doc_id = d.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM placed) THEN rank END AS rank
FROM scored LEFT JOIN placed ON placed.doc_id = scored.doc_id
"""


VARIANTS = rf"""
WITH RECURSIVE {_STEPS},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY 1, 2),
keyed AS (SELECT run, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, steps),
altered AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM keyed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
one AS (SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, less.n, w.word, w.n FROM less JOIN words w ON less.d = w.word
  UNION SELECT w.word, w.n, less.word, less.n FROM less JOIN words w ON less.d = w.word),
best AS (SELECT a AS word, count(*) AS n_near, (list(b ORDER BY b_n DESC, b))[1] AS b, max(b_n) AS b_n FROM one GROUP BY 1),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * words.n THEN b END AS form, CASE WHEN b_n >= 2 * words.n THEN b_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
path(word, form, n) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT path.word, forms.form, path.n + 1 FROM path JOIN forms ON forms.word = path.form WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(form, n) AS root FROM path GROUP BY 1)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots ON roots.word = forms.word
"""
