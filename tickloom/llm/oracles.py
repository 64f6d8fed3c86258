"""DuckDB SQL with which the registered queries are compared."""

from __future__ import annotations

_DRAW = """-ln((CAST('0x' || substr(md5('{level}/' || {node} || '/' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"""


def _shard(regions: str, racks: str, shards: str, out: str) -> str:
    """CTEs that descend a tree given as three tables of literals."""
    steps = []
    source = "SELECT doc_id FROM ids"
    for level, rows, parent in (("region", regions, None), ("rack", racks, "region"), ("shard", shards, "rack")):
        draw = _DRAW.format(level=level, node="name", weight="weight")
        match = f"ON t.parent = p.{parent}" if parent else "ON true"
        steps.append(
            f"{out}_{level} AS (SELECT doc_id, arg_min(number, draw) AS {level} FROM ("
            f"SELECT p.doc_id, t.number, {draw} AS draw FROM ({source}) p JOIN (VALUES {rows}) t(parent, name, number, weight) {match}"
            f") GROUP BY doc_id)"
        )
        source = f"SELECT * FROM {out}_{level}"
    return ",\n".join(steps)


_REGIONS = "(0, '0', 0, 8.0), (0, '1', 1, 8.0), (0, '2', 2, 8.0)"
_RACKS = ", ".join(f"({r}, '{r}/{k}', {2 * r + k}, 4.0)" for r in range(3) for k in range(2))
_SHARDS = ", ".join(f"({s // 4}, '{s}', {s}, 1.0)" for s in range(24))

OP1 = f"""
WITH RECURSIVE
ids AS (SELECT DISTINCT doc_id FROM documents),
crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS n))),
bytes AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM documents),
rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
    CASE WHEN text IS NOT NULL THEN
      xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) END AS text_crc32
  FROM bytes, crc_table),
{_shard(_REGIONS, _RACKS, _SHARDS, "now")},
{_shard(_REGIONS + ", (0, '3', 3, 1.0)", _RACKS + ", (3, '3/0', 6, 1.0)", _SHARDS + ", (6, '24', 24, 1.0)", "more")},
blocked AS (
  SELECT *, CAST('0x' || substr(md5(doc_id || '/' || coalesce(CAST(text_crc32 AS VARCHAR), 'null')), 1, 8) AS BIGINT)
      % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / 65536.0) AS BIGINT)) AS block
  FROM rows)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law,
  CAST(n.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY n.shard ORDER BY block, doc_id, text_crc32 NULLS FIRST, size) - 1 AS slot,
  CAST(m.shard AS INTEGER) AS grown_shard
FROM blocked JOIN now_shard n USING (doc_id) JOIN more_shard m USING (doc_id)
"""

OP2 = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles,
  (SELECT count(*) FROM both_ways WHERE a = d.doc_id) AS n_links, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""

OP5 = r"""
WITH
items AS MATERIALIZED (
  SELECT item_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines,
    list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS parts FROM benchmark WHERE text IS NOT NULL),
halved AS (
  SELECT item_id,
    CASE WHEN len(lines) > 1 THEN array_to_string(lines[1:len(lines) - 1], chr(10))
      WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '. ') ELSE text END AS q,
    CASE WHEN len(lines) > 1 THEN lines[-1] WHEN len(parts) > 1 THEN parts[-1] ELSE '' END AS a FROM items),
split AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(lower(q), '[a-z0-9\x{80}-\x{10FFFF}]+') AS q,
    regexp_extract_all(lower(a), '[a-z0-9\x{80}-\x{10FFFF}]+') AS a FROM halved),
sized AS (SELECT *, len(q) + len(a) AS size FROM split WHERE len(q) + len(a) > 0),
counted AS (SELECT item_id, size, t, count(*) AS tf FROM (SELECT item_id, size, unnest(list_concat(q, a)) AS t FROM sized) GROUP BY ALL),
frequent AS (SELECT t, count(*) AS df FROM counted GROUP BY 1),
consts AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT sum(size) FROM sized) / (SELECT count(*) FROM items) AS mean,
  greatest(32, (SELECT max(size) FROM sized)) AS step),
raw AS (
  SELECT item_id, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS w
  FROM counted JOIN frequent USING (t), consts),
impacts AS MATERIALIZED (SELECT item_id, t, w / sum(w) OVER (PARTITION BY item_id) AS w FROM raw),
docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, unnest(words) AS t, unnest(range(len(words))) // (SELECT step FROM consts) AS half FROM docs),
known AS MATERIALIZED (SELECT DISTINCT doc_id, t, half FROM placed WHERE t IN (SELECT t FROM frequent)),
seen AS (SELECT doc_id, t, half AS p FROM known UNION SELECT doc_id, t, half - 1 FROM known WHERE half > 0),
scored AS (SELECT doc_id, p, item_id, sum(w) AS score FROM seen JOIN impacts USING (t) GROUP BY ALL HAVING sum(w) >= 0.5 - 1e-12),
passages AS (
  SELECT s.*, q, a, p * step AS lo, least((p + 2) * step, len(words)) AS hi, words[p * step + 1:least((p + 2) * step, len(words))] AS own
  FROM scored s JOIN docs USING (doc_id) JOIN split USING (item_id), consts),
grams AS (
  SELECT *, least(3, greatest(len(q), 1)) AS k,
    list_distinct(list_transform(range(1, len(q) - least(3, greatest(len(q), 1)) + 2), lambda i: array_to_string(q[i:i + least(3, len(q)) - 1], ' '))) AS asked,
    ' ' || array_to_string(own, ' ') || ' ' AS line, list_distinct(a) AS said FROM passages),
shares AS (
  SELECT doc_id, item_id, score, lo, hi,
    CASE WHEN len(q) > 0 THEN len(list_filter(asked, lambda g: contains(line, ' ' || g || ' '))) / len(asked) ELSE 1.0 END AS question_overlap,
    CASE WHEN len(a) > 0 THEN len(list_filter(said, lambda g: list_contains(own, g))) / len(said) ELSE 1.0 END AS answer_overlap FROM grams)
SELECT doc_id, item_id, round(m.score, 6) AS score, m.question_overlap, m.answer_overlap, CAST(m.lo AS BIGINT) AS first_word,
  CAST(m.hi - 1 AS BIGINT) AS last_word
FROM (SELECT doc_id, item_id, max({'s': round(score, 9), 'question_overlap': question_overlap, 'answer_overlap': answer_overlap, 'lo': lo, 'hi': hi, 'score': score}) AS m
  FROM shares WHERE question_overlap >= 0.5 AND answer_overlap >= 0.5 GROUP BY 1, 2)
"""

OP10 = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT *, len(w) AS n FROM split),
grams AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS p FROM words WHERE n >= 3)),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice WHERE c > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
figures AS (
  SELECT doc_id, n AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > 3 * n_words OR 2 * n_upper > n_letters OR word_chars < 2 * n_words OR word_chars > 20 * n_words
      OR 10 * n_dup_lines > 3 * n_words OR 2 * n_letters < word_chars AS rejected
  FROM figures)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept
FROM judged
"""

def mix_sql(targets: dict[str, dict[str, float]], rate: float, sweeps: int, seed: str = "mix") -> str:
    wanted = ", ".join(f"('{m}', '{v}', {t})" for m, values in targets.items() for v, t in values.items())
    listed = {m: ", ".join(f"'{v}'" for v in values) for m, values in targets.items()}
    return rf"""
WITH RECURSIVE
figures AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
    length(regexp_replace(coalesce(text, ''), '[^|]', '', 'g')) AS bars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS upper,
    length(regexp_replace(coalesce(text, ''), '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS letters
  FROM documents),
marked AS (
  SELECT doc_id, CAST(n AS BIGINT) AS tokens,
    CASE WHEN source IN ({listed["source"]}) THEN source ELSE 'other' END AS source_group,
    CASE WHEN lang IN ({listed["lang"]}) THEN lang ELSE 'other' END AS lang_group,
    CASE WHEN 4 * bars > n THEN 'table' WHEN 2 * upper > letters THEN 'shout' WHEN 10 * symbols > 3 * n THEN 'symbols'
      WHEN n < 100 THEN 'note' WHEN n < 1000 THEN 'article' ELSE 'book' END AS topic
  FROM figures),
wanted(margin, value, share) AS (VALUES {wanted}),
cells AS (SELECT source_group, lang_group, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM marked GROUP BY ALL),
total AS (SELECT sum(tokens) AS tokens FROM cells),
margins AS (
  SELECT margin, value, sum(tokens) AS tokens FROM (
    SELECT 'source' AS margin, source_group AS value, tokens FROM cells
    UNION ALL SELECT 'lang', lang_group, tokens FROM cells
    UNION ALL SELECT 'topic', topic, tokens FROM cells) GROUP BY ALL),
goals AS (
  SELECT m.margin, m.value, CASE WHEN m.value = 'other' THEN m.tokens WHEN m.tokens > 0 THEN
      w.share / sum(CASE WHEN m.tokens > 0 THEN w.share END) OVER (PARTITION BY m.margin)
      * ((SELECT tokens FROM total) - coalesce(sum(CASE WHEN m.value = 'other' THEN m.tokens END) OVER (PARTITION BY m.margin), 0))
      ELSE 0 END AS goal
  FROM margins m LEFT JOIN wanted w ON w.margin = m.margin AND w.value = m.value),
raked AS (
  SELECT 0 AS k, c.*, CAST(1 AS DOUBLE) AS w, s.goal AS gs, l.goal AS gl, t.goal AS gt FROM cells c
  JOIN goals s ON s.margin = 'source' AND s.value = source_group
  JOIN goals l ON l.margin = 'lang' AND l.value = lang_group
  JOIN goals t ON t.margin = 'topic' AND t.value = topic
  UNION ALL
  SELECT k + 1, source_group, lang_group, topic, tokens,
    coalesce(w * CASE k % 3 WHEN 0 THEN gs WHEN 1 THEN gl ELSE gt END / nullif(CASE k % 3
      WHEN 0 THEN sum(tokens * w) OVER (PARTITION BY source_group)
      WHEN 1 THEN sum(tokens * w) OVER (PARTITION BY lang_group)
      ELSE sum(tokens * w) OVER (PARTITION BY topic) END, 0), 0), gs, gl, gt
  FROM raked WHERE k < {3 * sweeps}),
ranked AS (
  SELECT *, coalesce(sum(tokens) OVER (ORDER BY w DESC, source_group, lang_group, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(tokens * w) OVER (ORDER BY w DESC, source_group, lang_group, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM raked WHERE k = {3 * sweeps}),
scale AS (
  SELECT arg_min(({rate} * (SELECT tokens FROM total) - filled) / rest, filled) AS c FROM ranked
  WHERE rest > 0 AND ({rate} * (SELECT tokens FROM total) - filled) / rest * w <= 1),
solved AS (SELECT source_group, lang_group, topic, w, least(1, coalesce((SELECT c FROM scale) * w, 1)) AS p FROM ranked)
SELECT doc_id, source_group, lang_group, topic, m.tokens, round(w, 6) AS weight, round(p, 6) AS probability,
  (CAST('0x' || substr(md5('{seed}/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 < p AS sampled
FROM marked m JOIN solved USING (source_group, lang_group, topic)
"""


OP11 = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents),
numbers AS (
  SELECT *, len(lines) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(lines) + 1) AS a,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(lines) + 1) AS b,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS suffix_first FROM drawn),
parts AS (
  SELECT *, array_to_string(lines[1:least(a, b)], '') AS p, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(lines[greatest(a, b) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form FROM numbers)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

OP12 = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY ALL HAVING count(DISTINCT id) >= 10),
per_lang AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY 1),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t USING (lang, source) LEFT JOIN per_lang l ON l.lang = g.lang),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (g.total + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
above AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


SQL = {
    "op1_hash_tree_shards": OP1,
    "op2_set_relation_join": OP2,
    "op5_benchmark_leaks": OP5,
    "op10_rule_cascade": OP10,
    "op11_wavelet_fill_middle": OP11,
    "op12_packed_source_audit": OP12,
    "op13_extendible_exact_dedup": OP13,
}
