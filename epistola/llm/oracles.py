"""DuckDB SQL for the queries that SQL can express, over the same tables."""

OP1 = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c
    FROM range(256) r(i))
), body AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
             lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS text_crc32
  FROM documents, tab
), costs AS (
  SELECT b.*, s.i AS s, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '#' || s.i::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) AS cost
  FROM body b, range(17) s(i)
), dealt AS (
  SELECT doc_id, size, text_crc32, arg_min(s, cost) FILTER (s < 16) AS shard, arg_min(s, cost) AS grown_shard
  FROM costs GROUP BY ALL
), placed AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '#' || text_crc32::VARCHAR || '#' || size::VARCHAR), 1, 8))::BIGINT % 1024 AS bucket FROM dealt
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM placed
"""

OP7 = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM patterns
), windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM tokens, lengths WHERE len(w) >= m)
), found AS (SELECT doc_id, item_id, m, i FROM windows JOIN patterns USING (m, p)
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM tokens LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP8 = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, (count(*) OVER (PARTITION BY text_sha256))::BIGINT AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""



def _after(state: str, cost: str, letter: str, line: str | None = None) -> str:
    lines = f"list_append({state}.l, {line})" if line else f"{state}.l"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_USER = _least("f.u", *[_after(f"f.{s}", "5", "I", "'user:'") for s in "nsa"])
_ASSISTANT = _least("f.a", _after("f.u", "5", "I", "'assistant:'"), *[_after(_after(f"f.{s}", "5", "I", "'user:'"), "5", "I", "'assistant:'") for s in "ns"])
_NONE = "{'c': 1000000000, 'a': '', 'l': []::VARCHAR[]}"

OP11 = f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c
    FROM range(256) r(i))
), coded AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS cid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'),
             lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % 20 AS code
  FROM conversations, tab
), damaged AS (
  SELECT cid, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS time
  FROM coded WHERE code > 0
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS said,
         row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, time) > 1 AS again
  FROM damaged WINDOW w AS (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, time)
), marked AS (
  SELECT *, said = '' AS blank, said <> '' AND again AS duplicate, said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
         pos > 1 AND before || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), figures AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS turns
  FROM marked GROUP BY cid
), fold AS (
  SELECT cid, 0::BIGINT AS pos, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}} AS n, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM figures
  UNION ALL
  SELECT f.cid, m.pos, {_after("f.n", "2", "D")},
    {_least(_after("f.s", "2", "D"), f"CASE WHEN m.free AND m.initial = 's' THEN {_after('f.n', 'm.extra', 'K', 'm.line')} END")},
    {_least(_after("f.iu", "2", "D"), f"CASE WHEN m.free AND m.initial = 'u' THEN {_after('f.pu', 'm.extra', 'K', 'm.line')} END", f"CASE WHEN m.free THEN {_after('f.pu', 'm.extra + 1', 'R', "'user:' || m.text")} END")},
    {_least(_after("f.ia", "2", "D"), f"CASE WHEN m.free AND m.initial = 'a' THEN {_after('f.iu', 'm.extra', 'K', 'm.line')} END", f"CASE WHEN m.free THEN {_after('f.iu', 'm.extra + 1', 'R', "'assistant:' || m.text")} END")}
  FROM (SELECT *, {_least("n", "s", "ia")} AS pu FROM (SELECT *, {_USER} AS iu, {_ASSISTANT} AS ia FROM fold f)) f
  JOIN (SELECT cid, pos, initial, text, role || ':' || text AS line, NOT (blank OR duplicate) AS free, CASE WHEN truncated THEN 5 ELSE 0 END AS extra FROM marked) m ON m.cid = f.cid AND m.pos = f.pos + 1
), done AS (
  SELECT f.cid, {_least("f.n", _ASSISTANT)} AS best FROM fold f JOIN figures g ON g.cid = f.cid AND g.turns = f.pos
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM coded) c LEFT JOIN figures USING (cid) LEFT JOIN done USING (cid)
"""

OP12 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM texts
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM (SELECT x.*, f.k IS NOT NULL AND x.doc_id IS DISTINCT FROM f.keeper AS lost FROM keyed x LEFT JOIN frequent f USING (k)) GROUP BY r, doc_id
"""


def _assigned(name: str, books: str) -> str:
    """Each part's nearest entry: dist, entry."""
    return f"""{name} AS (
  SELECT v.vec_id, v.part, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.entry}}) AS best
  FROM cut v JOIN {books} b USING (part) GROUP BY v.vec_id, v.part, v.x
)"""


def _moved(name: str, assigned: str, books: str) -> str:
    """Each entry at the floor of its parts' mean; unused entries stay."""
    return f"""{name} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
      SELECT part, entry, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT part, best.e AS entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM {assigned}) GROUP BY ALL
    ) GROUP BY ALL
  ) m USING (part, entry)
)"""


OP13 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT vec_id, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)
), seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), b0 AS (SELECT part, entry, x FROM cut JOIN seeds USING (vec_id)
), {_assigned("a1", "b0")}, {_moved("b1", "a1", "b0")}, {_assigned("a2", "b1")}, {_moved("b2", "a2", "b1")}, {_assigned("a3", "b2")},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
), errors AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best.e::INTEGER)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a3 JOIN kept USING (vec_id) GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM errors, books
"""

ORACLES = {"op1_sharding": OP1, "op7_decontamination": OP7, "op8_exact_dedup": OP8, "op11_conversation_repair": OP11, "op12_line_dedup": OP12, "op13_vector_codes": OP13}
