"""DuckDB SQL for queries whose results SQL can express."""

_WORDS = r"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
listed AS (SELECT rid, doc_id, t, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM docs),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM listed)"""

QUALITY = (
    "WITH"
    + _WORDS.format(text="t")
    + r""",
windows AS (
  SELECT rid, i, n, w, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS k, w = lag(w) OVER o AS again
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT *, i <= n - 4 AND count(*) FILTER (i <= n - 4) OVER (PARTITION BY rid, k) > 1 AS hit FROM windows),
covered AS (SELECT *, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM twice),
sums AS (SELECT rid, count(*) FILTER (inside) AS n_repeat_words, sum(len(w))::BIGINT AS word_chars, count(*) FILTER (again) AS n_next_same FROM covered GROUP BY rid),
measured AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, coalesce(n_next_same, 0) AS n_next_same
  FROM listed LEFT JOIN sums USING (rid)),
ledger AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_upper > 4 * word_chars)::BIGINT
         + 16 * (100 * n_next_same > 20 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT + 64 * (n_dup_lines > 2 AND 50 * n_dup_lines > n_words)::BIGINT AS fail_bits
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 31 = 0 AS kept, fail_bits FROM ledger"""
)

SUBSTRING = (
    "WITH"
    + _WORDS.format(text="t")
    + """,
windows AS (SELECT rid, i, n, w, md5(string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS k FROM words),
twice AS (SELECT rid, i, w, i <= n - 34 AND count(*) FILTER (i <= n - 34) OVER (PARTITION BY k) > 1 AS hit FROM windows),
covered AS (SELECT *, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM twice),
sums AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM listed LEFT JOIN sums USING (rid)"""
)

NEAR = (
    "WITH RECURSIVE"
    + _WORDS.format(text="translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
windows AS (SELECT rid, i, n, string_agg(w, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words),
shingles AS (SELECT DISTINCT rid, md5(s) AS s FROM windows WHERE i <= greatest(n - 4, 1)),
sizes AS (SELECT rid, count(*) AS n_shingles FROM shingles GROUP BY rid),
meets AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM meets JOIN sizes x ON a = x.rid JOIN sizes y ON b = y.rid WHERE 100 * n >= 85 * (x.n_shingles + y.n_shingles - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rid AS a, rid AS b FROM docs UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
groups AS (SELECT reach.a AS rid, min(d.doc_id) AS component_id FROM reach JOIN docs d ON reach.b = d.rid GROUP BY reach.a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs LEFT JOIN sizes USING (rid) JOIN groups USING (rid)"""
)

QUOTES = r"""
WITH RECURSIVE messages AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
raw AS (SELECT rid, conv_id, turn, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM messages),
marked AS (SELECT *, len(regexp_replace(regexp_extract(x, '^[ \t]*(>[> \t]*)', 1), '[ \t]', '', 'g')) AS level FROM raw),
bodies AS (SELECT *, CASE WHEN level > 0 THEN regexp_replace(x, '^[ \t]*>[> \t]*', '') ELSE x END AS body FROM marked),
normal AS (SELECT *, trim(regexp_replace(lower(body), '[\x00-\x20]+', ' ', 'g')) AS norm FROM bodies),
lines AS (
  SELECT *, lead(level) OVER o AS next_level, norm <> '' AND NOT coalesce(lag(level) OVER o = level AND lag(norm) OVER o <> '', false) AS fresh
  FROM normal WINDOW o AS (PARTITION BY rid ORDER BY i)),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS p FROM lines),
passages AS (SELECT rid, conv_id, turn, level, p, string_agg(norm, ' ' ORDER BY i) AS passage FROM numbered WHERE norm <> '' GROUP BY ALL),
units AS (
  SELECT rid, conv_id, turn, level, passage, unnest(list_append(list_filter(list_transform(regexp_extract_all(passage, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> ''), passage)) AS u FROM passages
  UNION ALL SELECT rid, conv_id, turn, level, NULL, norm FROM normal WHERE norm <> ''),
kept AS (SELECT rid, trim(string_agg(body, chr(10) ORDER BY i)) AS body FROM lines WHERE level = 0 AND NOT (regexp_matches(x, '(?i)^\s*(on\b.*\bwrote|.*\b(wrote|writes|said)):\s*$') AND coalesce(next_level > 0, false)) GROUP BY rid),
depths AS (SELECT rid, max(level) AS depth FROM lines GROUP BY rid),
counted AS (SELECT rid, count(*) AS n_quoted FROM passages WHERE level > 0 GROUP BY rid),
asked AS (SELECT DISTINCT conv_id, turn, level, passage, u FROM units WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
origins AS (SELECT conv_id, u, min(turn) AS origin FROM units WHERE level = 0 GROUP BY ALL),
found AS (SELECT * FROM asked JOIN origins USING (conv_id, u) WHERE origin < turn),
votes AS (SELECT conv_id, turn, level, origin, count(*) AS n FROM found GROUP BY ALL),
linked AS (SELECT conv_id, turn, count(DISTINCT passage) AS n_linked FROM found GROUP BY ALL),
answers AS (SELECT conv_id, turn, arg_min(origin, [level, -n, -origin]) AS reply_to FROM votes GROUP BY ALL),
roots AS (
  SELECT conv_id, turn, reply_to AS up FROM answers
  UNION ALL SELECT roots.conv_id, roots.turn, answers.reply_to FROM roots JOIN answers ON roots.conv_id = answers.conv_id AND roots.up = answers.turn),
threads AS (SELECT conv_id, turn, min(up) AS thread FROM roots GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, reply_to, coalesce(thread, m.turn) AS thread, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, depth, CASE WHEN m.text IS NOT NULL THEN coalesce(kept.body, '') END AS text
FROM messages m JOIN depths USING (rid) LEFT JOIN counted USING (rid) LEFT JOIN kept USING (rid)
LEFT JOIN answers ON m.conv_id = answers.conv_id AND m.turn = answers.turn LEFT JOIN linked ON m.conv_id = linked.conv_id AND m.turn = linked.turn
LEFT JOIN threads ON m.conv_id = threads.conv_id AND m.turn = threads.turn"""


def urls() -> str:
    """The URL filter: rules, then the models level by level, scores, and the calibrated cut."""
    from . import urlfilter as u

    longest = sorted(u.RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN"
    rule, ruled = (f"CASE {' '.join(f"{fits(r)} '{what(r)}'" for r in longest)} END" for what in (lambda r: r.text, lambda r: r.verdict))
    levels = []
    for order in range(1, u.ORDER + 1):
        p = ", ".join(f"CASE WHEN n_{k} >= {u.EVIDENCE} THEN ({k} + kinds_{k} * q.p_{k}) / (n_{k} + kinds_{k}) ELSE q.p_{k} END AS p_{k}" for k in ("allow", "block"))
        met = ", ".join(f"sum({k}) OVER c AS n_{k}, count(*) FILTER ({k} > 0) OVER c AS kinds_{k}" for k in ("allow", "block"))
        levels.append(f"""
sums{order} AS (SELECT substr(gram, {u.ORDER - order + 1}) AS gram, sum(allow)::DOUBLE AS allow, sum(block)::DOUBLE AS block FROM counts GROUP BY ALL),
met{order} AS (SELECT *, {met} FROM sums{order} WINDOW c AS (PARTITION BY substr(gram, 1, {order}))),
known{order} AS (SELECT m.gram, {p} FROM met{order} m JOIN known{order - 1} q ON substr(m.gram, 2) = q.gram),""")
    return rf"""
WITH parts AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, ('0x' || substr(md5(url), 1, 8))::BIGINT % {u.HELD} = 0 AS held FROM parts),
base AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM split),
grams AS (
  SELECT rid, CASE WHEN NOT held THEN ruled END AS taught, substr(padded, i, {u.ORDER + 1}) AS gram
  FROM (SELECT *, repeat(chr({ord(u.START)}), {u.ORDER}) || lower(url) AS padded, unnest(generate_series(1, length(url))) AS i FROM base)),
counts AS (SELECT gram, count(*) FILTER (taught = 'allow') AS allow, count(*) FILTER (taught = 'block') AS block FROM grams GROUP BY gram),
letters AS (SELECT substr(gram, {u.ORDER + 1}) AS gram, sum(allow)::DOUBLE AS allow, sum(block)::DOUBLE AS block FROM counts GROUP BY ALL),
known0 AS (SELECT gram, (allow + 1) / (sum(allow) OVER () + count(*) OVER ()) AS p_allow, (block + 1) / (sum(block) OVER () + count(*) OVER ()) AS p_block FROM letters),{''.join(levels)}
scores AS (SELECT rid, avg(ln(p_allow) - ln(p_block)) AS score FROM grams JOIN known{u.ORDER} USING (gram) GROUP BY rid),
scored AS (SELECT base.*, round(coalesce(score, 0), 9) AS score FROM base LEFT JOIN scores USING (rid)),
tested AS (SELECT ruled, score FROM scored WHERE held AND ruled IS NOT NULL),
span AS (SELECT min(score) AS low, (max(score) - min(score)) / {u.STEPS} AS width FROM tested),
steps AS (SELECT least(floor((score - low) / width), {u.STEPS - 1})::INTEGER AS step, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block FROM tested, span GROUP BY ALL),
below AS (
  SELECT step, coalesce(sum(block) OVER b, 0) / greatest(sum(block) OVER (), 1) + (sum(allow) OVER () - coalesce(sum(allow) OVER b, 0)) / greatest(sum(allow) OVER (), 1) AS good,
         coalesce(lag(step) OVER (ORDER BY step), step - 1) AS before
  FROM steps WINDOW b AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (SELECT round(good, 12) AS good, (step + before + 1) / 2 * width + low AS cut FROM below, span),
best AS (SELECT cut FROM cuts ORDER BY good DESC, abs(cut), cut DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM scored, best"""
