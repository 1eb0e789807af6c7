"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from barvault.llm import licenses, sharding

_SHARDS = ",".join(map(str, sharding.fill(sharding.shard_names())))

OP4 = f"""
SELECT doc_id, string_split('{_SHARDS}', ',')[
    1 + (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {sharding.TABLE_SIZE})]::INTEGER AS shard
FROM documents
"""

OP3 = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, len(h) // 2 AS n FROM bytes),
pieces AS (
    SELECT doc_id, n, b, substr(h, 2 * b + 1, 638) AS piece FROM (SELECT *, unnest(range(0, n - 199, 120)) AS b FROM sized)
),
starts AS (
    SELECT doc_id, b + p AS p, hash(substr(piece, 2 * p + 1, 400)) AS s
    FROM (SELECT *, unnest(range(0, least(120, n - 199 - b))) AS p FROM pieces)
),
again AS (SELECT doc_id, p FROM starts WHERE s IN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1)),
edges AS (SELECT doc_id, p, p > coalesce(lag(p) OVER w + 200, -1) AS fresh FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (
    SELECT doc_id, min(p) AS a, max(p) + 200 AS b
    FROM (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges) GROUP BY doc_id, run
),
totals AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL
    SELECT s.doc_id, coalesce(max(b), 0), any_value(n) FROM sized s LEFT JOIN runs r USING (doc_id) GROUP BY s.doc_id
),
kept AS (
    SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256
    FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM sized LEFT JOIN totals USING (doc_id) JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
often AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key
GROUP BY doc_id
"""

OP6 = r"""
WITH doc_words AS (
    SELECT doc_id, i AS pos, ws[i] AS word
    FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
         unnest(range(1, len(ws) + 1)) AS u(i)
),
item_lists AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
item_windows AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
    FROM item_lists, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i)
    WHERE len(ws) > 0
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_lists AS (SELECT doc_id, list(word ORDER BY pos) AS ws FROM doc_words GROUP BY doc_id),
hits AS (
    SELECT d.doc_id, d.i, w.n, w.item_id
    FROM (
        SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
        FROM doc_lists, lengths, unnest(range(1, len(ws) - n + 2)) AS u(i)
    ) d JOIN item_windows w ON d.n = w.n AND d.phrase = w.phrase
),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL)
    GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN doc_lists USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# known sentences cut like documents, and whole ones, as lists of pieces
_KNOWN = ", ".join(f"({list(pieces)}, '{name}')" for pieces, name in licenses.known_pieces())
_RULES = ", ".join(f"('{licence}', {list(ids)})" for licence, ids in licenses.rules())

OP8 = rf"""
WITH known(parts, sentence_id) AS (VALUES {_KNOWN}),
rules(licence, ids) AS (VALUES {_RULES}),
cut AS (
    SELECT doc_id, string_split(regexp_replace(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '([.!?:;])[\t\n\x0B\f\r ]+', '\1' || chr(10), 'g'), chr(10)) AS parts
    FROM documents
),
normal AS (
    SELECT doc_id, list_transform(parts, lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))) AS sentences FROM cut
),
placed AS (SELECT doc_id, sentences, unnest(range(1, len(sentences) + 1)) AS pos FROM normal),
found AS (
    SELECT doc_id, list(sentence_id ORDER BY pos) AS ids, list(pos ORDER BY pos) AS places,
           list(pos + len(parts) - 1 ORDER BY pos) AS lasts
    FROM placed JOIN known ON sentences[pos] = parts[1] AND sentences[pos:pos + len(parts) - 1] = parts
    GROUP BY doc_id
),
matches AS (
    SELECT doc_id, i, licence
    FROM (SELECT doc_id, ids, places, lasts, unnest(range(1, len(ids) + 1)) AS i FROM found) f, rules r
    WHERE f.ids[i:i + len(r.ids) - 1] = r.ids
      AND lasts[i + len(r.ids) - 1] - places[i]
          - list_sum(list_transform(range(i, i + len(r.ids)), lambda k: lasts[k] - places[k]))
          <= (len(r.ids) - 1) * ({licenses.GAP} + 1)
    QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY len(r.ids) DESC, licence, r.ids) = 1
),
listed AS (
    SELECT doc_id, CAST(count(*) AS INTEGER) AS n_matches, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licenses
    FROM matches GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS INTEGER) AS n_known, coalesce(licenses, '') AS licenses,
       coalesce(n_matches, 0) AS n_matches
FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

OP9 = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS units
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, v.vec_id,
           CAST(list_inner_product(CAST(q.units AS DOUBLE[]), CAST(v.units AS DOUBLE[])) AS BIGINT) AS score
    FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

# The CRC-32 of column ``h`` (the bytes in hexadecimal), with the table ``t`` of ``_CRC_TABLE``.
_CRC_TABLE = """
crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(
        [n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""
_CRC = """xor(list_reduce(
        [4294967295] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _moves() -> tuple[str, str]:
    """Rows (state, edits, inserted lines, role needed, new role, next state, cost) for a row, and the same for the end."""
    turn = {"": "u", "s": "u", "a": "u", "u": "a"}
    named = {"u": "user", "a": "assistant"}
    rows, ends = [], []
    for state in turn:
        here, lines = state, []
        for inserts in range(3):
            lead, shown, cost = "I" * inserts, str(lines), 2 * inserts
            if here in ("", "a"):
                ends.append(f"('{state}', '{lead}', {shown}::VARCHAR[], {cost})")
            then = turn[here]
            rows.append(f"('{state}', '{lead}D', {shown}::VARCHAR[], NULL, NULL, '{here}', {cost + 3})")
            rows.append(f"('{state}', '{lead}R', {shown}::VARCHAR[], NULL, '{named[then]}', '{then}', {cost + 2})")
            for initial in {then, "s"} if here == "" else {then}:
                rows.append(f"('{state}', '{lead}K', {shown}::VARCHAR[], '{initial}', NULL, '{initial}', {cost})")
            here, lines = then, [*lines, named[then] + ":"]
    return ", ".join(sorted(rows)), ", ".join(ends)


_ROW_MOVES, _END_MOVES = _moves()
_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
shown AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h
    FROM conversations
),
fated AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS fate FROM shown, crc),
harmed AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
    FROM fated WHERE fate <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed
),
judged AS (
    SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS c,
           substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS two,
           CASE WHEN trim(text, {_WHITE_SQL}) = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(trim(text, {_WHITE_SQL}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
    FROM placed
),
facts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
),
moves(state, edits, lines, c, named, target, cost) AS (VALUES {_ROW_MOVES}),
ends(state, edits, lines, cost) AS (VALUES {_END_MOVES}),
ways AS (
    SELECT DISTINCT conv_id, 0 AS i, '' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM conversations
    UNION ALL
    SELECT conv_id, i, state, cost, audit, lines FROM (
        SELECT w.conv_id, w.i + 1 AS i, m.target AS state,
               w.cost + m.cost + CASE WHEN j.fault = 'truncated' AND right(m.edits, 1) <> 'D' THEN 1 ELSE 0 END AS cost,
               w.audit || m.edits AS audit,
               w.lines || m.lines || CASE right(m.edits, 1) WHEN 'D' THEN []::VARCHAR[]
                   WHEN 'R' THEN [m.named || ':' || j.text] ELSE [j.role || ':' || j.text] END AS lines
        FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
        JOIN moves m ON m.state = w.state AND (m.c IS NULL OR m.c = j.c)
             AND (right(m.edits, 1) = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
    ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
),
finished AS (
    SELECT w.conv_id, w.i, w.cost + e.cost AS cost, w.audit || e.edits AS audit, w.lines || e.lines AS lines
    FROM ways w JOIN ends e ON e.state = w.state
)
SELECT f.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, f.cost::BIGINT AS cost, f.audit,
       sha256(coalesce(array_to_string(f.lines, chr(10)), '')) AS repaired_sha256
FROM finished f LEFT JOIN facts x ON x.conv_id IS NOT DISTINCT FROM f.conv_id
WHERE f.i = coalesce(x.n, 0)
QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY f.cost, f.audit) = 1
"""

OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE.strip()},
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
),
counted AS (SELECT id, run, count(*) AS m, hex(encode(id || ':' || run)) AS h FROM runs GROUP BY id, run),
hashed AS (SELECT run, m, {_CRC} AS v FROM counted, crc),
spelled AS (
    SELECT CASE WHEN v % 97 = 0 THEN substr(run, 1, v % length(run)) || substr(run, v % length(run) + 2) ELSE run END AS word, m
    FROM hashed
),
vocab AS (
    SELECT word, sum(m)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3
),
cut AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)
),
pairs AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest
    WHERE a.word <> b.word
    UNION
    SELECT c.word, c.n, v.word, v.n FROM cut c JOIN vocab v ON c.rest = v.word
    UNION
    SELECT v.word, v.n, c.word, c.n FROM cut c JOIN vocab v ON c.rest = v.word
),
best AS (
    SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
),
formed AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
           CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
    FROM vocab v LEFT JOIN best b ON b.word = v.word
),
path AS (
    SELECT word, word AS tip, 0 AS step FROM formed
    UNION ALL
    SELECT p.word, f.form, p.step + 1 FROM path p JOIN formed f ON f.word = p.tip WHERE f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(tip, step) AS root FROM path GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
"""

ORACLE: dict[str, str] = {
    "op3_suffix_dedup": OP3,
    "op4_sharding": OP4,
    "op5_line_dedup": OP5,
    "op6_decontamination": OP6,
    "op8_licenses": OP8,
    "op9_topk": OP9,
    "op12_conversation_repair": OP12,
    "op13_spelling_variants": OP13,
}
