"""SQL that checks the queries which SQL can express."""

ORACLES: dict[str, str] = {}

_WORDS = r"""coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"""

ORACLES["op2_quality_rules"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w
  FROM documents),
windows AS (
  SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (
  SELECT row_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1),
covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) AS step(k) GROUP BY row_id),
lines AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
stats AS (
  SELECT d.row_id, doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM docs d LEFT JOIN covered c ON d.row_id = c.row_id LEFT JOIN lines l ON d.row_id = l.row_id),
base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * word_chars // greatest(n_words, 1) AS m1, 1000 * n_symbols // greatest(n_words, 1) AS m2,
    1000 * n_dup_lines // greatest(n_lines, 1) AS m3,
    1000 * n_repeat_words // greatest(n_words, 1) AS m4
  FROM stats),
long AS (
  SELECT lang, source, metric, v FROM base
  UNPIVOT (v FOR metric IN (m1, m2, m3, m4)) WHERE NOT base_failed),
edges AS (
  SELECT lang, source, metric, (v >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0)::BIGINT AS s FROM long) GROUP BY ALL),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY lang, source, metric) AS total
  FROM edges),
quartiles AS (
  SELECT lang, source, metric, min(bucket) FILTER (4 * upto >= total) AS q1,
    min(bucket) FILTER (4 * upto >= 3 * total) AS q3
  FROM placed GROUP BY ALL),
fences AS (
  SELECT lang, source,
    max(q1 - greatest(3 * (q3 - q1), 2000)) FILTER (metric = 'm1') AS low1,
    max(q3 + greatest(3 * (q3 - q1), 2000)) FILTER (metric = 'm1') AS high1,
    max(q3 + greatest(3 * (q3 - q1), 100)) FILTER (metric = 'm2') AS high2,
    max(q3 + greatest(3 * (q3 - q1), 500)) FILTER (metric = 'm3') AS high3,
    max(q3 + greatest(3 * (q3 - q1), 300)) FILTER (metric = 'm4') AS high4
  FROM quartiles GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(
    m1 BETWEEN low1 AND high1 AND m2 <= high2 AND m3 <= high3 AND m4 <= high4, false) AS kept
FROM base b LEFT JOIN fences f
  ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""

_FOLDED = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op9_decontamination"] = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, coalesce({_FOLDED}, []) AS w FROM benchmark
  WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS size,
          unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce({_FOLDED}, []) AS w FROM documents),
places AS (
  SELECT row_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows))),
found AS (SELECT row_id, p.size, i, item FROM places p JOIN windows v ON p.size = v.size AND p.gram = v.gram),
hit AS (
  SELECT row_id, count(DISTINCT place) AS n_hit
  FROM (SELECT row_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY row_id),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS line
  FROM (SELECT DISTINCT row_id, item FROM found) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(line, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.row_id = h.row_id LEFT JOIN named n ON d.row_id = n.row_id
"""

_FAILS = r"""len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e"""

ORACLES["op12_filter_audit"] = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, {_WORDS} AS w, coalesce(text, '') AS text FROM documents),
fails AS (SELECT doc_id, part, {_FAILS} FROM docs),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
long AS (
  SELECT f.part, f.doc_id, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END,
      CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END,
      CASE WHEN e THEN 'E' ELSE '' END) AS failing
  FROM fails f LEFT JOIN marks m ON f.doc_id = m.doc_id),
cells AS (
  SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM long GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, range(1, 6) AS r(step)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, failing, contains(failing, f) AS fails,
    length(translate(before, failing, '')) < length(before) AS gone
  FROM cells, steps),
summed AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
    coalesce(sum(n) FILTER (failing = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""


def _encoded(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return f"sha256({' || '.join(_encoded(f) for f in fields)})"


# CRC-32 of the decimal id, byte by byte, eight shifts a byte
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, x: list_reduce(
      list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, _:
      CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(
        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )} ELSE {_leaf('text')} END AS now
  FROM documents),
placed AS (
  SELECT *, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM docs),
tree AS (
  SELECT 0 AS lv, source, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lv + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lv, source, pos // 16, n),
subs AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lv, pos, n, subroot AS node FROM subs
  UNION ALL
  SELECT lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lv, pos // 16, n),
sides AS (
  SELECT row_id, 0 AS tier, lv, t.pos < p.pos // (16 ** lv)::BIGINT AS before, t.pos, t.node
  FROM placed p JOIN tree t ON p.source IS NOT DISTINCT FROM t.source AND t.n > 1
    AND t.pos // 16 = p.pos // (16 ** lv)::BIGINT // 16 AND t.pos <> p.pos // (16 ** lv)::BIGINT
  UNION ALL
  SELECT row_id, 1, lv, t.pos < s.pos // (16 ** lv)::BIGINT, t.pos, t.node
  FROM placed p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source JOIN top t ON t.n > 1
    AND t.pos // 16 = s.pos // (16 ** lv)::BIGINT // 16 AND t.pos <> s.pos // (16 ** lv)::BIGINT),
proofs AS (
  SELECT row_id, string_agg(node, '' ORDER BY tier, lv, pos) AS proof FROM sides GROUP BY row_id),
grades AS (
  SELECT p.row_id, 0 AS tier, lv FROM placed p
    JOIN (SELECT DISTINCT source, lv FROM tree WHERE n > 1) t ON p.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT p.row_id, 1, lv FROM placed p, (SELECT DISTINCT lv FROM top WHERE n > 1)),
pairs AS (
  SELECT g.row_id, row_number() OVER (PARTITION BY g.row_id ORDER BY g.tier, g.lv) AS nth,
    coalesce(string_agg(node, '' ORDER BY pos) FILTER (before), '') AS l,
    coalesce(string_agg(node, '' ORDER BY pos) FILTER (NOT before), '') AS r
  FROM grades g LEFT JOIN sides s ON g.row_id = s.row_id AND g.tier = s.tier AND g.lv = s.lv
  GROUP BY g.row_id, g.tier, g.lv),
folds AS (
  SELECT row_id, 0 AS nth, now AS h FROM docs
  UNION ALL
  SELECT f.row_id, f.nth + 1, sha256(l || h || r) FROM folds f JOIN pairs p ON f.row_id = p.row_id AND p.nth = f.nth + 1),
last AS (SELECT row_id, max_by(h, nth) AS folded_root FROM folds GROUP BY row_id)
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root,
  sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT node FROM top WHERE n = 1) AS verified
FROM placed p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source
  JOIN last USING (row_id) LEFT JOIN proofs USING (row_id)
"""
