"""DuckDB SQL of the queries that SQL can express exactly."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {}

# An item of one to four words is one shingle of all its words (k is the shingle's length).
_BY_LENGTH = "list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))"
ORACLES["op3_containment"] = f"""
WITH iw AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark),
ik AS (SELECT item_id, w, CASE WHEN len(w) < 5 THEN len(w) ELSE 5 END AS k FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, unnest({_BY_LENGTH}) AS s FROM ik),
dw AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
dk AS (SELECT doc_id, w, l.k FROM dw, (SELECT DISTINCT k FROM ik) l),
d AS (SELECT doc_id, k, unnest({_BY_LENGTH}) AS s FROM dk),
z AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(DISTINCT s) AS n_common FROM d JOIN i USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_common, n_item, n_common::DOUBLE / n_item AS containment
FROM f JOIN z USING (item_id) WHERE n_common >= 0.8::DOUBLE * n_item - 1e-9
"""

ORACLES["op7_mix"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w FROM s),
o AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS free_w FROM r),
l AS (SELECT arg_min(total - capped, ratio) AS t, arg_min(free_w, ratio) AS fw FROM o WHERE (total - capped)::DOUBLE / free_w <= ratio),
g AS (SELECT source, source_size, least(w * (SELECT t::DOUBLE FROM l) / (SELECT fw::DOUBLE FROM l), 3.0::DOUBLE * source_size) AS target FROM r),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b AS (SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS epochs, floor(target)::BIGINT % greatest(source_size, 1) AS rest FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM b
"""

ORACLES["op8_url_cascade"] = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


def _license_sql() -> str:
    from netwarden.llm.licences import LONG, PHRASES, _key_places, _template_rows, anchors, need_of

    def listed(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    values = ", ".join("('{}', {}, {}::VARCHAR[], [{}]::VARCHAR[][], {}, {})".format(
        label, listed(ws), listed(keys), ", ".join(map(listed, beside)), str(len(ws) >= LONG).lower(), need_of(len(ws)))
        for (_, label, ws), (keys, beside) in zip(_template_rows(), _key_places()))
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        places.append(f"list_transform(list_filter(range(0, len(w)), lambda i: coalesce({same}, false)), lambda i: {{'place': i, 'label': '{label}'}})")
    # the words around a telling word beside one of its neighbours
    around = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{word}' AND ("
        f"list_contains({listed(pairs)}, concat_ws(' ', w[i - 1], w[i])) OR list_contains({listed(pairs)}, concat_ws(' ', w[i], w[i + 1])))), "
        f"lambda i: array_to_string(w[greatest(i - {reach}, 1):i + {reach}], ' '))) AS block FROM d"
        for word, reach, pairs in anchors())
    words = _WORDS.format(t="text")
    full = "coalesce(trim({}, ' ' || chr(9) || chr(13)) <> '', false)"
    return rf"""
WITH t(label, ws, keys, beside, long, need) AS (VALUES {values}),
d AS (SELECT doc_id, text, {words} AS w FROM documents),
b AS (SELECT row_number() OVER () AS n, doc_id, text, w, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS base FROM d),
ln AS (SELECT doc_id, text, string_split(lower(coalesce(text, '')), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, text, unnest(list_transform(range(1, len(l)), lambda i: CASE WHEN {full.format('l[i]')} AND {full.format('l[i + 1]')}
  THEN concat_ws(' ', l[i], l[i + 1], CASE WHEN {full.format('l[i + 2]')} THEN l[i + 2] END) END)) AS block FROM ln),
near AS ({around.replace('SELECT doc_id,', 'SELECT doc_id, text,')}),
l AS (SELECT doc_id, text, false AS long, false AS run, unnest(l) AS block FROM ln
  UNION ALL SELECT doc_id, text, false, true, block FROM r WHERE block IS NOT NULL
  UNION ALL SELECT doc_id, text, false, true, block FROM near
  UNION ALL SELECT doc_id, text, true, false, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\n[\x20\t\r]*\n')) FROM documents),
x AS (SELECT doc_id, text, long, list_distinct(regexp_split_to_array(block, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws,
  CASE WHEN run THEN ' ' || regexp_replace(block, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g') || ' ' END AS said FROM l),
m AS (SELECT doc_id, text, label, len(list_intersect(t.ws, x.ws)) / len(t.ws)::DOUBLE AS share FROM x JOIN t USING (long)
  WHERE len(list_intersect(t.ws, x.ws)) >= need AND list_has_all(x.ws, keys)
    AND (said IS NULL OR len(list_filter(beside, lambda ps: len(list_filter(ps, lambda p: contains(said, p))) > 0)) = len(beside))),
g AS (SELECT doc_id, text, list(DISTINCT label) AS more, max(share) AS best FROM m GROUP BY doc_id, text),
o AS (SELECT b.*, list_distinct(list_transform(base, lambda z: z.label)) AS bl, more, best
  FROM b LEFT JOIN g ON b.doc_id IS NOT DISTINCT FROM g.doc_id AND b.text IS NOT DISTINCT FROM g.text)
SELECT doc_id, len(w)::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(list_transform(base, lambda z: z.place))::BIGINT AS first_word,
  list_max(list_transform(base, lambda z: z.place))::BIGINT AS last_word, coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score FROM o
"""


ORACLES["op10_license_join"] = _license_sql()

ORACLES["op11_source_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY ALL),
p AS (SELECT m.lang, m.source, m.term, m.n, 1 + (CAST(1000000000 AS HUGEINT) * CAST(m.n + 5 AS HUGEINT)) // CAST(s.total + 5 * l.v AS HUGEINT) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * CAST(m.n_lang + 5 AS HUGEINT)) // CAST(l.total + 5 * l.v AS HUGEINT) AS q
      FROM m JOIN s USING (lang, source) JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 50
"""
