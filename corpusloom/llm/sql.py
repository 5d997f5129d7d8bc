"""The registered queries of this subpackage in SQL, where SQL can express them."""

from __future__ import annotations

_SIGN = "chr(9243)"
#: Marks of the instruct template; each is broken behind its first character.
_MARKS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[AS]", "[SAYS]", "[/AS]")


def _escaped(text: str) -> str:
    found = f"replace({text}, {_SIGN}, {_SIGN} || '0')"
    for mark in _MARKS:
        found = f"replace({found}, '{mark}', '{mark[0]}' || {_SIGN} || '1{mark[1:]}')"
    return found


OP9 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length({_escaped("text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 15 + length({_escaped("role")}) END AS chars FROM turns),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM said
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS MATERIALIZED (
  SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, c.component_id FROM sizes s
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) || '0' AS h FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
    ((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31) + 1,
    1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

#: The table of CRC-32, folded from its polynomial.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 beside the table ``crc``."""
    data = f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    step = "xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: {step}), 4294967295)"


OP6 = f"""
WITH RECURSIVE {_CRC_TABLE},
walk(doc_id, n, state, shard, jump) AS (
  SELECT doc_id, n, CAST(doc_id AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT doc_id, n, next, jump, CAST(floor((jump + 1) * (CAST(2147483648 AS DOUBLE) / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM walk WHERE jump < n)),
shards AS (
  SELECT doc_id, CAST(max(shard) FILTER (WHERE n = 8) AS INTEGER) AS shard, CAST(max(shard) FILTER (WHERE n = 9) AS INTEGER) AS grown_shard
  FROM walk WHERE jump >= n GROUP BY doc_id)
SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32,
  'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM documents JOIN shards USING (doc_id), crc
"""

OP12 = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
counts AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base FROM turns GROUP BY conv_id),
convs AS MATERIALIZED (
  SELECT c.conv_id, c.own, c.base, {_crc32("CAST(c.conv_id AS VARCHAR)")} % 6 AS h,
    least({_crc32("CAST(c.conv_id AS VARCHAR)")} % 6, coalesce(b.own, 0)) AS k
  FROM counts c LEFT JOIN counts b ON b.conv_id = c.base, crc),
rebuilt AS (
  SELECT c.conv_id, t.nth - c.h + c.k + 1 AS depth, t.role, t.text FROM convs c JOIN turns t USING (conv_id) WHERE t.nth >= c.h
  UNION ALL
  SELECT c.conv_id, t.nth + 1, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE t.nth < c.k),
seats AS MATERIALIZED (
  SELECT conv_id, depth, length(text) AS chars,
    md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
paths AS MATERIALIZED (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
    lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS is_end FROM seats),
nodes AS MATERIALIZED (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM paths GROUP BY node, depth),
families AS MATERIALIZED (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children FROM nodes n),
sums AS (
  SELECT p.node, sum(f.saved) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS leaves
  FROM families f JOIN paths p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM families f JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = f.parent
"""

OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]{{5,}}')) AS run FROM documents),
hashed AS (
  SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), crc),
typed AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
    || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS MATERIALIZED (
  SELECT DISTINCT word, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT h.word, w.word AS short FROM holes h JOIN words w ON w.word = h.head || h.tail),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT word, short FROM shorter UNION SELECT short, word FROM shorter),
best AS (
  SELECT r.word, r.other, w.n AS other_n, row_number() OVER (PARTITION BY r.word ORDER BY w.n DESC, r.other) AS place,
    count(*) OVER (PARTITION BY r.word) AS n_near
  FROM near r JOIN words w ON w.word = r.other),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
    CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
reach(word, root) AS (
  SELECT word, word FROM forms UNION ALL SELECT r.word, f.form FROM reach r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN reach r USING (word) JOIN forms l ON l.word = r.root AND l.form IS NULL
"""

ORACLE: dict[str, str] = {
    "op6_jump_hash": OP6,
    "op7_sharded_writer": OP7,
    "op8_partenum": OP8,
    "op9_chat_machine": OP9,
    "op12_centroid_trie": OP12,
    "op13_kd_spelling": OP13,
}
