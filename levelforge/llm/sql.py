"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op7_warc_writer"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to
FROM f
"""

#: Measures, base rules and line frequency of the quality rules over ``documents``; ``{source}`` is the table.
QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM {source}),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS s FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS j FROM twice) GROUP BY rid),
m AS (
  SELECT w.*, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
),
l AS (SELECT rid, source, text, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, source, text, unnest(lines) AS x FROM m)),
seen AS (SELECT source, array_to_string(lw, ' ') AS line, count(DISTINCT text) AS n FROM l GROUP BY ALL HAVING count(DISTINCT text) >= 10),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
freq AS (SELECT seen.source, line FROM seen JOIN hosts ON seen.source IS NOT DISTINCT FROM hosts.source WHERE 100 * n > 5 * docs OR n >= 1000),
gone AS (SELECT rid, sum(len(lw)) AS n FROM l JOIN freq ON l.source IS NOT DISTINCT FROM freq.source AND array_to_string(lw, ' ') = line GROUP BY rid),
v AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words FROM m LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR 100 * (n_words - removed_words) < 30 * n_words)) AS kept
FROM v
"""
ORACLES["op10_quality_rules"] = QUALITY.format(source="documents")

ORACLES["op5_sharding"] = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), e AS (SELECT *, h >> (60 - depth) AS prefix FROM d, (SELECT unnest(generate_series(0, 60)) AS depth)),
s AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, min(h) AS a, max(h) AS b FROM e GROUP BY depth, prefix),
f AS (SELECT e.rid, min(e.depth) AS depth FROM e JOIN s USING (depth, prefix) WHERE shard_bytes <= 1048576 OR a = b GROUP BY e.rid)
SELECT e.doc_id, e.n_bytes, CAST(e.depth AS INTEGER) AS depth, e.prefix, CAST(0 AS BIGINT) AS page, CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM e JOIN f USING (rid, depth) JOIN s USING (depth, prefix)
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_LOWER = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_EDGE = r"[!-#$-/:-@\[-`{-~]"

#: Templates of documents and items, their windows, and what matches. Placeholders are control characters, which no word holds at its edges here.
ORACLES["op9_benchmark_decontamination"] = rf"""
WITH src AS (SELECT row_number() OVER () AS rid, * FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark) WHERE text IS NOT NULL),
l AS (SELECT rid, kind, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM (SELECT *, string_split(text, chr(10)) AS lines FROM src)),
w AS (SELECT rid, kind, id, ln, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l)),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY ln, k) AS i FROM w),
b AS (SELECT *, i = 1 OR ln <> lag(ln) OVER p OR right(lag(w) OVER p, 1) IN ('.', '!', '?', ':') AS begins FROM o WINDOW p AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT *, sum(begins::INT) OVER (PARTITION BY rid ORDER BY i) AS begun, regexp_replace(regexp_replace(w, '^{_EDGE}{{0,8}}', ''), '{_EDGE}{{0,8}}$', '') AS bare FROM b),
t AS (SELECT rid, kind, id, begun, bare, translate(bare, '{_UPPER}', '{_LOWER}') AS v, regexp_full_match(bare, '[0-9.,%+/:-]*[0-9][0-9.,%+/:-]*') AS number, row_number() OVER (PARTITION BY rid ORDER BY i) AS j FROM s WHERE bare <> ''),
u AS (SELECT *, coalesce(begun <> lag(begun) OVER q, TRUE) AS opens, coalesce(lag(number) OVER q, FALSE) AS after FROM t WINDOW q AS (PARTITION BY rid ORDER BY j)),
x AS (SELECT *, CASE WHEN number THEN chr(1) WHEN after AND NOT opens AND v IN ({{units}}) THEN chr(2) WHEN NOT opens AND contains('{_UPPER}', left(bare, 1)) THEN chr(3) ELSE v END AS t FROM u),
a AS (SELECT rid, kind, id, list(t ORDER BY j) AS ts, list(v ORDER BY j) AS vs FROM x GROUP BY ALL),
i0 AS (SELECT rid, id AS item_id, least(8, len(ts)) AS n, unnest(generate_series(1, len(ts) - least(8, len(ts)) + 1)) AS pos, ts, vs FROM a WHERE kind = 'b'),
i1 AS (SELECT rid, item_id, n, pos, ts[pos:pos+n-1] AS t, vs[pos:pos+n-1] AS v FROM i0),
i2 AS (SELECT *, len(list_distinct(list_filter(t, lambda y: y NOT IN (chr(1), chr(2), chr(3))))) AS words, len(list_distinct(v)) AS different FROM i1),
items AS (SELECT *, array_to_string(t, ' ') AS h, array_to_string(v, ' ') AS own_h, words >= 3 AND n = 8 AS may_change, count(*) OVER (PARTITION BY rid) AS n_windows FROM i2 WHERE words >= 3 OR (n = 8 AND different >= 3)),
d0 AS (SELECT id AS doc_id, n, unnest(generate_series(1, len(ts) - n + 1)) AS pos, ts, vs FROM a, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(ts) >= n),
docs AS (SELECT doc_id, n, pos, ts[pos:pos+n-1] AS t, vs[pos:pos+n-1] AS v FROM d0),
found AS (SELECT *, array_to_string(t, ' ') AS h, array_to_string(v, ' ') AS own_h FROM docs WHERE array_to_string(t, ' ') IN (SELECT h FROM items)),
same AS (SELECT DISTINCT doc_id, item_id, n_windows, items.pos FROM found JOIN items USING (h, own_h, n)),
pairs AS (SELECT doc_id, item_id, n_windows, items.pos, found.pos - items.pos AS diagonal, unnest(items.t) AS slot, unnest(items.v) AS mine, unnest(found.v) AS other FROM found JOIN items USING (h, n) WHERE may_change AND found.own_h <> items.own_h),
one AS (SELECT doc_id, item_id, n_windows, diagonal FROM (SELECT doc_id, item_id, n_windows, diagonal, mine, count(DISTINCT other) AS k FROM pairs WHERE slot IN (chr(1), chr(2), chr(3)) GROUP BY ALL) GROUP BY ALL HAVING max(k) = 1),
both_ AS (SELECT *, TRUE AS same FROM same UNION ALL SELECT DISTINCT doc_id, item_id, n_windows, pos, FALSE FROM pairs JOIN one USING (doc_id, item_id, n_windows, diagonal)),
m AS (SELECT doc_id, item_id, n_windows, pos, bool_or(same) AS same FROM both_ GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, count(*) AS n_matched, CASE WHEN bool_and(same) THEN 'verbatim' ELSE 'reparameterised' END AS kind FROM m GROUP BY doc_id, item_id, n_windows HAVING 100 * count(*) >= 50 * n_windows
"""


def _filled(sql: str) -> str:
    from .decontaminate import UNITS

    return sql.replace("{units}", ", ".join(f"'{u}'" for u in UNITS))


ORACLES["op9_benchmark_decontamination"] = _filled(ORACLES["op9_benchmark_decontamination"])

#: Chats as tool calls: of the turns that are needed, only 2, 8, 14 and so on need a later one, and none needs those.
ORACLES["op8_tool_call_linking"] = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT m.conv_id, m.turn, m.text, m.turn % 6 = 2 AND later.turn IS NOT NULL AS late FROM m LEFT JOIN m AS later ON later.conv_id = m.conv_id AND later.turn = m.turn + 2 AND later.role = 'user' WHERE m.role = 'user'),
r AS (SELECT conv_id, turn, text FROM m WHERE role = 'assistant'),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'call-' || coalesce(c.turn, r.turn - 1) AS call_id, c.turn AS call_turn, r.turn AS result_turn, c.text AS prompt, r.text AS content, late FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1)
SELECT conv_id, call_id, call_turn, result_turn, CASE WHEN call_turn IS NULL THEN 'orphan_result' WHEN result_turn IS NULL THEN 'missing_result' ELSE 'linked' END AS status,
  CASE WHEN late THEN 1 ELSE 0 END AS level, CASE WHEN call_turn IS NULL THEN NULL WHEN prompt = '' THEN '$.prompt: minLength' ELSE '' END AS errors,
  CAST(CASE WHEN call_turn IS NULL THEN to_json({'id': call_id, 'result': content}) WHEN result_turn IS NULL THEN to_json({'arguments': {'prompt': prompt, 'role': 'user', 'turn': call_turn}, 'id': call_id, 'name': 'ask'})
    ELSE to_json({'arguments': {'prompt': prompt, 'role': 'user', 'turn': call_turn}, 'id': call_id, 'name': 'ask', 'result': content}) END AS VARCHAR) AS message
FROM j
"""

#: Unsigned CRC-32 of the decimal form of ``{id}``.
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"


def _levels(nodes: str, name: str, levels: int) -> str:
    """``{name}0`` to ``{name}{levels}``: the runs of eight (tree, g, hs, total) of each level above ``nodes`` (tree, i, h); the last holds one node a tree."""
    out, below = [], nodes
    for k in range(levels + 1):
        out.append(f"{name}{k} AS (SELECT tree, i // 8 AS g, list(h ORDER BY i) AS hs, max(total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS total FROM {below}) GROUP BY tree, i // 8)")
        below = f"(SELECT tree, g AS i, CASE WHEN total = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}{k})"
    return ",\n".join(out)


def _climb(leaves: str, name: str, levels: int, keep: str) -> str:
    """``leaves`` (tree, i) with ``path`` (left and right siblings of each level) by joins with the runs of each level."""
    joins = " ".join(f"JOIN {name}{k} ON {name}{k}.tree = a.tree AND {name}{k}.g = a.i // {8 ** (k + 1)}" for k in range(levels))
    place = [f"((a.i // {8**k}) % 8)" for k in range(levels)]
    pairs = ", ".join(f"CASE WHEN {name}{k}.total > 1 THEN [array_to_string({name}{k}.hs[1:{place[k]}], ''), array_to_string({name}{k}.hs[{place[k]}+2:], '')] ELSE [] END" for k in range(levels))
    return f"SELECT {keep}, flatten([{pairs}]) AS path, {name}{levels}.hs[1] AS top FROM {leaves} AS a {joins} JOIN {name}{levels} ON {name}{levels}.tree = a.tree"


def _value(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


_FIVE = " || ".join(_value(x) for x in ("doc_id", "source", "lang", "n_chars"))
_TAMPERED = f"CASE WHEN {CRC.format(id='doc_id')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"

#: Eight levels of eight (16 million documents a language), four over the languages; a fold takes the siblings two by two.
ORACLES["op13_merkle_manifest"] = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIVE} || {_value("text")}) AS h, sha256({_FIVE} || {_value(f"({_TAMPERED})")}) AS claim FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, claim) - 1 AS i FROM d),
{_levels("leaf", "r", 8)},
own AS ({_climb("leaf", "r", 8, "a.doc_id, a.tree, a.h, a.claim")}),
subs AS (SELECT '' AS tree, tree AS lang, hs[1] AS h, row_number() OVER (ORDER BY tree) - 1 AS i FROM r8),
{_levels("subs", "s", 4)},
over_ AS ({_climb("subs", "s", 4, "a.lang, a.h AS subroot")}),
p AS (SELECT doc_id, h AS leaf, subroot, over_.top AS root, claim, list_concat(own.path, over_.path) AS path FROM own JOIN over_ ON own.tree = over_.lang),
f AS (SELECT *, list_reduce(list_prepend(claim, list_transform(generate_series(1, len(path), 2), lambda k: path[k] || '|' || path[k + 1])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(path, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

#: Prefixes by the hash of their turns; every node adds itself to all prefixes of its smallest member down to it.
ORACLES["op12_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER own AS i, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)),
k AS (SELECT c, n, {CRC.format(id="c")} % 4 AS h, c - c % 20 AS base FROM (SELECT DISTINCT c, n FROM t)),
v AS (SELECT k.c, k.h, k.base, least(k.h, coalesce(b.n, 0)) AS taken FROM k LEFT JOIN k AS b ON b.c = k.base),
r AS (SELECT v.c, t.i AS d, role, text FROM v JOIN t ON t.c = v.base AND t.i <= v.h UNION ALL SELECT v.c, taken + i - h, role, text FROM v JOIN t ON t.c = v.c AND t.i > v.h),
x AS (SELECT c, d, sha256(strlen(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
paths AS (SELECT c, d, w, sha256(array_to_string(list(turn) OVER (PARTITION BY c ORDER BY d), '')) AS p FROM x UNION ALL SELECT c, 0, 0, '' FROM v),
node AS (SELECT d, p, count(*) AS n_convs, min(c) AS conv_id, max(w) AS w FROM paths GROUP BY d, p),
up AS (SELECT node.*, q.p AS above FROM node LEFT JOIN paths AS q ON q.c = node.conv_id AND q.d = node.d - 1),
family AS (SELECT above AS p, count(*) AS n_children FROM up WHERE d > 0 GROUP BY above),
full_ AS (SELECT up.*, coalesce(n_children, 0) AS n_children, m.conv_id AS parent_conv_id FROM up LEFT JOIN family ON family.p = up.p LEFT JOIN node AS m ON m.p = up.above),
sums AS (SELECT a.p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * f.w) AS saved_tokens FROM full_ AS f JOIN paths AS a ON a.c = f.conv_id AND a.d <= f.d GROUP BY a.p),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS most FROM paths) WHERE d = most GROUP BY p)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_ JOIN sums USING (p) LEFT JOIN ends USING (p)
"""
