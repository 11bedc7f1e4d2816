"""DuckDB SQL for the queries that SQL can express.

None for the learned scores (5), weighted hash draws (8), parser events (9) and token ids (13), nor for
windows of every length over every document (3); tests hold these against plain Python.
"""

from __future__ import annotations

import math

from postlake.llm.licenses import PHRASES, TEMPLATES, words_of
from postlake.llm.secrets import BASE_RULES, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secrets() -> str:
    def spans(place: int, rule) -> str:
        cutter = _text(f"(?s)(.*?)(?:({rule.java})|\\z)")
        part = lambda g: f"regexp_extract_all(coalesce(text, ''), {cutter}, {g})"
        return f"SELECT n, {place} AS place, {_text(rule.kind)} AS kind, {rule.least} AS least, {part(1)} AS gap, {part(2)} AS hit, {part(2 + rule.group)} AS val FROM d"

    base = ", ".join(_text(r.kind) for r in BASE_RULES)
    cases = "\nUNION ALL ".join(spans(n, r) for n, r in enumerate(RULES))
    spelled = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place)"
    counts = ", ".join(f"count(*) FILTER (kind = {_text(r.kind)}) AS n_{r.kind}" for r in BASE_RULES)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
parts AS ({cases}),
each AS (SELECT n, place, kind, least, unnest(gap) AS gap, unnest(hit) AS hit, unnest(val) AS val, generate_subscripts(gap, 1) AS i FROM parts),
placed AS (
  SELECT n, place, kind, least, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY n, place ORDER BY i) AS e FROM each),
kept AS (SELECT n, place, kind, e - length(hit) AS s, e FROM placed WHERE hit != '' AND length(val) >= least),
found AS (SELECT n, {counts}, coalesce({spelled.replace(" ORDER", " ORDER")} FILTER (kind IN ({base})), '') AS base, {spelled} AS spans FROM kept GROUP BY n)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (n)"""


def near_duplicates(width: int = 4, percent: int = 80) -> str:
    words = f"list_filter(string_split_regex({_LOWER.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda w: w != '')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {width - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS s
  FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT l.doc_id AS a, r.doc_id AS b, any_value(l.n) AS m, any_value(r.n) AS n, count(*) AS c
  FROM x l JOIN x r ON l.x = r.x AND l.doc_id != r.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p WHERE 100 * c >= {percent} * (m + n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM documents LEFT JOIN s USING (doc_id) JOIN least USING (doc_id)"""


def neighbours(k: int = 20, every: int = 20) -> str:
    return f"""
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % {every} = 0 AND q.vec_id != c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= {k}"""


def licenses(threshold: float = 0.9) -> str:
    split = lambda c: f"list_filter(string_split_regex({_LOWER.format(c)}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w != '')"
    sets = [sorted(set(words_of(t))) for _, t in TEMPLATES]
    rows = []
    for n, ((label, _), words) in enumerate(zip(TEMPLATES, sets, strict=True)):
        within = [k for k, o in enumerate(sets) if set(o) > set(words)]
        rows.append(f"({n}, {_text(label)}, [{', '.join(map(_text, words))}], {max(1, math.ceil(threshold * len(words) - 1e-9))}, {within}::INTEGER[])")
    starts = " UNION ALL ".join(
        f"SELECT n, {_text(label)} AS label, unnest(list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = {_text(x)}" for k, x in enumerate(phrase.split())) + ")) AS pos FROM d"
        for phrase, label in PHRASES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, {split("coalesce(text, '')")} AS w FROM documents),
places AS ({starts}),
base AS (SELECT n, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY n),
l AS (SELECT n, string_split(text, chr(10)) AS lines FROM d),
b AS (SELECT n, i, {split("lines[i] || ' ' || coalesce(lines[i + 1], '')")} AS w FROM (SELECT n, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
t (id, label, words, least, within) AS (VALUES {", ".join(rows)}),
m AS (SELECT n, i, id, label, within, len(list_intersect(w, words)) AS c, len(words) AS size FROM b JOIN t ON len(list_intersect(w, words)) >= least),
o AS (SELECT n, i, list(id) AS ids FROM m GROUP BY n, i),
f AS (
  SELECT n, list_distinct(list(label)) AS found, max(c / size) AS best
  FROM m JOIN o USING (n, i) WHERE NOT list_has_any(within, ids) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  array_to_string(coalesce(labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (n) LEFT JOIN f USING (n)"""


MIXING = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws('|', 'mix', doc_id::VARCHAR, coalesce(md5(text), ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS sz FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS wt FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * sz / wt, source NULLS LAST) AS rn FROM w),
r AS (
  SELECT *, (1.5 * sum(sz) OVER ())::DOUBLE - coalesce(sum(2.0::DOUBLE * sz) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(wt) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM o),
u AS (SELECT arg_min(rest / open, rn) AS unit FROM r WHERE rest / open <= 2.0 * sz / wt),
t AS (SELECT source AS of, sz, least(2.0::DOUBLE * sz, unit * wt) AS target FROM w, u),
p AS (
  SELECT doc_id, size, sz, target, CASE WHEN sz > 0 THEN floor(floor(target) / sz) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.of)
SELECT doc_id, size, sz AS source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * sz - before)))::BIGINT AS taken FROM p"""

ARCHIVES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest,
    CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM q"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte from its table."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    tail = lambda shift: f"128 + ((unicode(c) >> {shift}) & 63)"
    utf8 = (
        f"CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), {tail(0)}] "
        f"WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), {tail(6)}, {tail(0)}] "
        f"ELSE [240 + (unicode(c) >> 18), {tail(12)}, {tail(6)}, {tail(0)}] END"
    )
    raw = f"flatten(list_transform(string_split({text}, ''), lambda c: {utf8}))"
    step = f"xor(h >> 8, list_extract({table}::BIGINT[], (xor(h, b) & 255) + 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {raw}::BIGINT[]), lambda h, b: {step}), 4294967295::BIGINT)"


SPELLING = f"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT doc, run, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT run, k, {_crc32("concat(doc, ':', run)")} AS h FROM o),
g AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM g WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
m AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS masked, left(word, i - 1) || substr(word, i + 1) AS shorter FROM i),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM m a JOIN m b ON a.masked = b.masked AND a.word != b.word
  UNION SELECT m.word, w.word, w.n FROM m JOIN w ON m.shorter = w.word
  UNION SELECT w.word, m.word, m.n FROM m JOIN w ON m.shorter = w.word),
b AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM c WHERE next IS NULL) USING (word)"""


def resampling() -> str:
    words = lambda t: f"unnest(regexp_extract_all({_LOWER.format(t)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
x AS (SELECT row, {words("text")} AS word FROM d),
y AS (SELECT {words("text")} AS word FROM benchmark),
v AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y)),
s AS (SELECT bucket, count(*) AS s FROM x JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM y JOIN v USING (word) GROUP BY bucket),
z AS (SELECT (SELECT count(*) FROM x) AS big_s, (SELECT count(*) FROM y) AS big_t),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (big_s + 10000))::DOUBLE / ((s + 1) * (big_t + 10000))::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), z),
a AS (
  SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM x JOIN v USING (word) JOIN g USING (bucket) GROUP BY row),
b AS (
  SELECT row, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || left(sha256(concat('2024:', doc_id)), 8))::BIGINT AS h
  FROM d LEFT JOIN a USING (row)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM b),
e AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS fit FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank
FROM c LEFT JOIN (SELECT row, rank::BIGINT AS rank FROM e WHERE rank <= 10 * fit // 100) USING (row)"""


ORACLES: dict[str, str] = {
    "op1_secrets": secrets(),
    "op2_near_duplicates": near_duplicates(),
    "op4_neighbours": neighbours(),
    "op6_licenses": licenses(),
    "op7_mixing": MIXING,
    "op10_warc": ARCHIVES,
    "op11_spelling_variants": SPELLING,
    "op12_resampling": resampling(),
}
