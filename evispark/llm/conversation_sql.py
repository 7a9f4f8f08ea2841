"""DuckDB's SQL of op13: the same damage, flags, and cheapest edits by a recursive query over the turns."""

_NEVER = "900000000000"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {byte}), 4294967295)"


def _go(state: str, cost: str, letter: str) -> str:
    """A state is its cost in twelve digits and its edits."""
    return f"(lpad((substr({state}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{letter}')"


def _step() -> str:
    stays, more = "fault NOT IN ('blank', 'duplicate')", "(fault = 'truncated')::INT"
    keep = lambda s, r: f"CASE WHEN {stays} AND role[1:1] = '{r}' THEN {_go(s, more, 'K')} END"
    rerole = lambda s, letter: f"CASE WHEN {stays} THEN {_go(s, more + ' + 2', letter)} END"
    user = ", ".join([_go("t2", "3", "D"), *[keep(s, "u") for s in ("t0", "t1", "t3")], *[rerole(s, "R") for s in ("t0", "t1", "t3")]])
    return (
        f"{_go('t0', '3', 'D')} AS s0, least({_go('t1', '3', 'D')}, {keep('t0', 's')}) AS s1, least({user}) AS s2,"
        f" least({_go('t3', '3', 'D')}, {keep('t2', 'a')}, {rerole('t2', 'S')}) AS s3"
    )


_USER = f"least(s2, {_go('s0', '2', 'I')}, {_go('s1', '2', 'I')}, {_go('s3', '2', 'I')})"

SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(CASE h WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER turns AS pos, lag(role) OVER turns AS last_role,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS said
  FROM damaged WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
flagged AS (
  SELECT conv_id, turn, role, text, pos,
         (last_role IS NOT NULL AND last_role[1:1] || role[1:1] NOT IN ('su', 'ua', 'au'))::INT AS illegal,
         CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN said NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, sum(illegal)::BIGINT AS illegal, count(*) AS turns
  FROM flagged GROUP BY conv_id),
fold AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000000' AS s0, '{_NEVER}' AS s1, '{_NEVER}' AS s2, '{_NEVER}' AS s3 FROM counted
  UNION ALL
  SELECT conv_id, pos, {_step()} FROM (
    SELECT *, least(s3, {_go('t2', '2', 'J')}) AS t3 FROM (
      SELECT f.conv_id, f.pos, f.role, f.fault, d.s0 AS t0, d.s1 AS t1, {_USER} AS t2, d.s3
      FROM fold d JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1))),
best AS (
  SELECT c.*, least(s0, s3, {_go(_USER, '2', 'J')}) AS won
  FROM fold JOIN counted c ON c.conv_id IS NOT DISTINCT FROM fold.conv_id AND pos = turns),
parts AS (
  SELECT conv_id, unnest(regexp_extract_all(won[13:], '[IJ]*[DKRS]|[IJ]+$')) AS part,
         generate_subscripts(regexp_extract_all(won[13:], '[IJ]*[DKRS]|[IJ]+$'), 1) AS pos FROM best),
said AS (
  SELECT p.conv_id, p.pos, list_transform(list_filter(string_split(part, ''), lambda c: c IN ('I', 'J')), lambda c: CASE c WHEN 'I' THEN 'user:' ELSE 'assistant:' END)
         || CASE right(part, 1) WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN ['user:' || text] WHEN 'S' THEN ['assistant:' || text] ELSE [] END AS lines
  FROM parts p LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos),
whole AS (SELECT conv_id, array_to_string(flatten(list(lines ORDER BY pos)), chr(10)) AS text FROM said GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(substr(won, 1, 12)::BIGINT, 0) AS cost, coalesce(translate(won[13:], 'JS', 'IR'), '') AS audit,
       sha256(coalesce(w.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""
