"""DuckDB SQL for the corpus queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from .licenses import NOTICES, PHRASES

ORACLES: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ITEM_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES["op1_substring"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM s) WHERE r > 1),
p AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d),
m AS (SELECT p.doc_id, p.pos, p.word, later.s AS s FROM p LEFT JOIN later ON later.doc_id = p.doc_id AND later.s = p.pos),
c AS (SELECT doc_id, pos, word, coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY pos) > pos - 20, false) AS gone FROM m),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

ORACLES["op2_embedding"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""

ORACLES["op3_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 END + length(text)
  + len(regexp_extract_all(text, '\\|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|\[ANS\]|<s>|</s>|\[ROLE |\[/ROLE\]')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, regexp_full_match(string_agg(left(role, 1), '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM x GROUP BY conv_id
"""

ORACLES["op4_mixing"] = f"""
WITH z AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM n),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][rank % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / weight, rank) AS step FROM w),
lv AS (SELECT arg_min(level, step) AS common FROM f WHERE level <= cap / weight),
a AS (SELECT source, source_size, rank, least(cap, coalesce(common * weight, cap)) AS target FROM f, lv),
b AS (SELECT *, CAST(round(sum(target) OVER ()) AS BIGINT) AS seats, count(*) OVER () AS n, CAST(floor(target) AS BIGINT) AS share FROM a),
c AS (SELECT *, CASE WHEN target > 0 THEN greatest(0, share - n // 2 - 2) ELSE 0 END AS low, CASE WHEN target > 0 THEN share + n // 2 + 2 ELSE 0 END AS high FROM b),
o AS (SELECT *, seats - sum(low) OVER () AS open FROM c),
q AS (SELECT rank, target, open, unnest(range(low, high)) AS k FROM o WHERE high > low),
won AS (SELECT rank, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place FROM q) WHERE place <= open GROUP BY rank),
qu AS (SELECT source, source_size, target, CAST(low + coalesce(won, 0) AS BIGINT) AS blocks FROM o LEFT JOIN won USING (rank)),
e AS (SELECT z.*, qu.source_size, qu.target, qu.blocks, md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))) AS h FROM z JOIN qu ON z.source IS NOT DISTINCT FROM qu.source),
sh AS (SELECT *, CAST('0x' || left(h, 8) AS BIGINT) % CAST(greatest(1, ceil(source_size / 8000)) AS BIGINT) AS shard FROM e),
tp AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard) AS BIGINT) AS length, CAST(coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sh),
wa AS (SELECT *, CASE WHEN length > 0 THEN CAST(least(floor(blocks * length / source_size + 0.5), 2 * length) AS BIGINT) ELSE 0 END AS want FROM tp),
ro AS (SELECT *, CASE WHEN length > 0 THEN want // length ELSE 0 END AS rounds FROM wa)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(size, want - rounds * length - before)) AS BIGINT) AS taken FROM ro
"""

ORACLES["op9_suffix"] = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 2)) AS i FROM d),
s AS (SELECT doc_id, i, n, substr(h, 2 * i + 1, 2) AS x, CASE WHEN i + 200 <= n THEN md5(substr(h, 2 * i + 1, 400)) END AS win FROM b),
r AS (SELECT doc_id, i, x, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS rep FROM s),
c AS (SELECT doc_id, i, x, coalesce(max(CASE WHEN rep THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 200, false) AS gone FROM r),
e AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS r, count(*) FILTER (gone AND NOT before) AS spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

ORACLES["op10_decontam"] = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, n, w[s + 1:s + n] AS win FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, w[s + 1:s + n] AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dw.n, item FROM dw JOIN iw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_PIECES = rf"string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')"

ORACLES["op11_phrases"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest({_PIECES}) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, w[s:s + m - 1] AS w FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, w, array_to_string(w, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, m, w HAVING count(*) >= 30),
c AS (SELECT a.lang, a.phrase, a.f AS a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * a.f // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) a JOIN f l ON l.lang = a.lang AND l.w = a.w[1:k] JOIN f r ON r.lang = a.lang AND r.w = a.w[k + 1:]),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM c) WHERE place = 1),
h AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM f WHERE m > 2)) GROUP BY 1, 2),
k AS (SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}', {exact})" for i, (label, text, exact) in enumerate([*((v, k, True) for k, v in PHRASES.items()), *((a, b, False) for a, b in NOTICES)]))

ORACLES["op13_licenses"] = rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
t AS (SELECT id, label, exact, w AS tw, least(3, len(w)) AS k FROM (SELECT id, label, exact, {_ITEM_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(id, label, text, exact))),
g AS (SELECT id, label, exact, k, len(tw) AS size, off, tw[off + 1:off + k] AS gram FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS off FROM t)),
p AS (SELECT doc_id, k, pos, w[pos + 1:pos + k] AS gram FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, id, label, exact, size, k, off, pos - off AS diag FROM p JOIN g USING (k, gram)),
c AS (SELECT DISTINCT doc_id, id, diag, unnest(range(off, off + k)) AS word FROM h),
e AS (SELECT doc_id, id, diag, count(*) AS covered FROM c GROUP BY ALL),
s AS (SELECT doc_id, id, label, exact, size, k, diag, count(*) AS n, diag + min(off) AS start, diag + max(off) + k AS stop FROM h GROUP BY doc_id, id, label, exact, size, k, diag),
b AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, id ORDER BY diag) AS band FROM (SELECT s.*, covered, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, id ORDER BY diag) <= 3 THEN 0 ELSE 1 END AS jump FROM s JOIN e USING (doc_id, id, diag))),
u AS (SELECT doc_id, id, band, count(DISTINCT word) AS together FROM b JOIN c USING (doc_id, id, diag) GROUP BY ALL),
m AS (SELECT doc_id, id, label, exact, size, band, max(covered) AS alone, max(stop) - min(start) AS span FROM b GROUP BY doc_id, id, label, exact, size, band),
v AS (SELECT doc_id, label, exact, CAST(CASE WHEN span <= size * 1.5 THEN together ELSE alone END AS DOUBLE) / size AS score FROM m JOIN u USING (doc_id, id, band)),
x AS (SELECT doc_id, label, 1.0::DOUBLE AS score, CAST(diag AS BIGINT) AS place FROM s WHERE exact AND n = size - k + 1 UNION ALL SELECT doc_id, CASE WHEN NOT exact AND score >= 0.8 THEN label END, score, NULL FROM v),
f AS (SELECT doc_id, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, max(score) AS score,
  string_agg(DISTINCT CASE WHEN place IS NOT NULL THEN label END, ',' ORDER BY CASE WHEN place IS NOT NULL THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN f USING (doc_id)
"""

ORACLES["op12_repair"] = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
m AS (SELECT k.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM m WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
  CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')) v(q, to_q, cost, s)),
e AS (SELECT conv_id, i, q, to_q, cost + CASE WHEN s <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, s
  FROM f, (VALUES (0, 0, 2, 'D', ''), (1, 1, 2, 'D', ''), (2, 2, 2, 'D', ''), (3, 3, 2, 'D', ''), (0, 2, 1, 'R', ''), (1, 2, 1, 'R', ''), (2, 3, 1, 'R', ''), (3, 2, 1, 'R', ''),
    (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a')) v(q, to_q, cost, s, fits)
  WHERE s <> 'K' AND (s = 'D' OR fault NOT IN ('blank', 'duplicate')) OR s = 'K' AND fits = c AND fault NOT IN ('blank', 'duplicate')),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS s FROM f
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.s FROM (SELECT e.conv_id, e.i, e.to_q AS q, min({'cost': CAST(w.cost + g.cost + e.cost AS BIGINT), 's': w.s || g.s || e.s}) AS best
    FROM w JOIN g ON g.q = w.q JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = g.to_q GROUP BY e.conv_id, e.i, e.to_q)),
z AS (SELECT conv_id, min({'cost': CAST(w.cost + g.cost AS BIGINT), 's': w.s || g.s}) AS best FROM w JOIN g ON g.q = w.q AND g.to_q IN (0, 3) JOIN (SELECT conv_id AS v, max(i) AS i FROM f GROUP BY 1) l ON l.v IS NOT DISTINCT FROM w.conv_id AND l.i = w.i GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(best.s, '')) AS s, unnest(range(1, length(best.s) + 1)) AS place FROM z WHERE best.s <> ''),
r AS (SELECT *, sum(CASE WHEN s <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place) AS i FROM l),
j AS (SELECT r.*, f.role, CASE WHEN s = 'I' THEN '' ELSE f.text END AS text, CASE WHEN s = 'D' OR s = 'K' AND f.c = 's' THEN 0 ELSE 1 END AS one FROM r LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i),
n AS (SELECT *, sum(one) OVER (PARTITION BY conv_id ORDER BY place) AS th FROM j),
t AS (SELECT conv_id, string_agg(CASE WHEN s = 'K' THEN role WHEN th % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS repaired FROM n WHERE s <> 'D' GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (p IS NOT NULL AND (p || c) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.s, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
