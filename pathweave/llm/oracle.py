"""DuckDB SQL for the training-data queries that SQL can express, written from their definitions."""

from __future__ import annotations

from pathweave.llm import chat, mixing, quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _chat() -> str:
    frame = len(chat.OPEN) + len(chat.BODY) + len(chat.CLOSE)
    return rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({frame} + length(role) + length(text)
    + 2 * (length(role || text) - length(replace(replace(role || text, '\', ''), '<', '')))
    - (length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


def _rules() -> str:
    def bad(r: quality_rules.Rule) -> str:
        value = r.over if r.under is None else f"{r.over} / nullif({r.under}, 0)"
        return " OR ".join([f"coalesce({value} < {r.low}, false)"] * (r.low is not None)
                           + [f"coalesce({value} > {r.high}, false)"] * (r.high is not None))

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (WHERE left(ltrim(line, ' '), 1) IN ('-', '*', '•', '‣')) AS n_bullet_lines,
    count(*) FILTER (WHERE rtrim(line, ' ') LIKE '%...' OR rtrim(line, ' ') LIKE '%…') AS n_cut_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_cut_lines, 0) AS n_cut_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN line_counts USING (doc_id) LEFT JOIN covered USING (doc_id)),
v AS (SELECT *, n_words < {quality_rules.BASE_MIN_WORDS}
    OR 100 * n_repeat_words > {quality_rules.BASE_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f'({bad(r)})' for r in quality_rules.RULES)}) AS kept FROM v"""


def _mixing() -> str:
    w = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w,
    {mixing.CAP} * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM n
  WINDOW before AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most::DOUBLE, w * max(level) FILTER (WHERE level <= most::DOUBLE / w) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS r,
    (('0x' || left(md5('{mixing.SEED}/' || coalesce(source, '') || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END), 8))::BIGINT >> 2) AS u FROM t),
k AS (SELECT d.*, r.source_size, r.target, r.r, r.u, round((r.r - floor(r.r)) * {2**mixing.BITS})::BIGINT AS part,
    row_number() OVER (PARTITION BY d.source ORDER BY
      CASE WHEN size <= 0 THEN -1 ELSE floor(log2(size::DOUBLE) * 16) END,
      ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % (1 + (SELECT count(*) FROM d) // {mixing.ROWS_PER_SALT}),
      size, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT, doc_id::VARCHAR) AS k
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(r)::BIGINT + ((part * k + u) >> {mixing.BITS}) - ((part * (k - 1) + u) >> {mixing.BITS})))::BIGINT AS taken FROM k"""


#: CRC-32 by its definition: the table of 256 remainders, then one step for each character of an ASCII text.
_CRC = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS remainders)"""


def _crc32(text: str) -> str:
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda c, b: xor(remainders[(xor(c, b) & 255) + 1], c >> 8)))")


def _repair() -> str:
    """Forward over the rows: for each last role, the least (cost, audit) that leads there; Spark's side goes backward by ranks."""
    def edit(state: str, label: str, cost: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{label}'}}"

    def when(test: str, value: str) -> str:
        return f"CASE WHEN {test} AND {value}.c IS NOT NULL THEN {value} END"

    def then(label: str, state: str, initial: str) -> str:
        if label == "D":
            return when(f"{state} IS NOT NULL", edit(state, "D", "3"))
        test = f"{state} IS NOT NULL AND fault NOT IN (1, 2) AND initial {'=' if label == 'K' else '<>'} '{initial}'"
        return when(test, edit(state, label, f"CASE fault WHEN 3 THEN 1 ELSE 0 END + {0 if label == 'K' else 2}"))

    def best(*of: str) -> str:
        return f"least({', '.join(of)})"

    def inserts(state: str) -> str:
        return when(f"{state} IS NOT NULL", edit(state, "I", "2"))

    user = [then(label, state, "u") for label in "KR" for state in ("none", "system", "assistant")]
    return rf"""
WITH RECURSIVE {_CRC},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM hit WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ordered),
marked AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM numbered),
path AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS none, NULL::STRUCT(c INTEGER, a VARCHAR) AS system,
    {{'c': 2, 'a': 'I'}} AS "user", {{'c': 4, 'a': 'II'}} AS assistant FROM marked WHERE i = 1
  UNION ALL
  SELECT conv_id, i, none, system, {best("moved_user", *[inserts(s) for s in ("none", "system", "moved_assistant")])},
    {best("moved_assistant", inserts("moved_user"), when("none IS NOT NULL", edit("none", "II", "4")), when("system IS NOT NULL", edit("system", "II", "4")))}
  FROM (SELECT p.conv_id, m.i, {then("D", "none", "")} AS none, {best(then("D", "system", ""), then("K", "none", "s"))} AS system,
      {best(then("D", '"user"', ""), *user)} AS moved_user,
      {best(then("D", "assistant", ""), then("K", '"user"', "a"), then("R", '"user"', "a"))} AS moved_assistant
    FROM path p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1)),
best AS (SELECT conv_id, least(none, assistant) AS b FROM path WHERE (conv_id, i) IN (SELECT conv_id, max(i) FROM marked GROUP BY conv_id)),
edits AS (SELECT conv_id, p, b.a[p] AS e, length(replace(left(b.a, p), 'I', '')) AS i, length(replace(left(b.a, p), 'D', '')) AS k
  FROM (SELECT *, unnest(range(1, length(b.a) + 1)) AS p FROM best)),
opening AS (SELECT e.conv_id FROM edits e JOIN marked m USING (conv_id, i) WHERE e = 'K' AND k = 1 AND initial = 's'),
repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN m.role
      WHEN (k + CASE WHEN conv_id IN (FROM opening) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN e = 'I' THEN '' ELSE m.text END, chr(10) ORDER BY p)) AS hash
  FROM edits LEFT JOIN marked m USING (conv_id, i) WHERE e <> 'D' GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
  count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
  coalesce(b.a, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN repaired USING (conv_id)"""


def _trie() -> str:
    """Nodes by the text of their whole path; sums go from each node to the prefixes of its smallest member."""
    return rf"""
WITH {_CRC},
said AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM said), crc),
turns AS (
  SELECT c.conv_id, 0 AS own, s.n, s.role, s.text FROM c JOIN said s ON s.conv_id = c.base AND s.n <= c.h
  UNION ALL SELECT c.conv_id, 1, s.n, s.role, s.text FROM c JOIN said s ON s.conv_id = c.conv_id AND s.n > c.h),
places AS (SELECT conv_id, text, row_number() OVER w AS depth,
  string_agg(md5(length(role) || ':' || role || text), '' ) OVER w AS node FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, n)),
members AS (SELECT conv_id AS m, depth, node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM places
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nodes AS (SELECT node, depth, min(m) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own FROM members GROUP BY node, depth),
children AS (SELECT p.node, count(*) AS n FROM nodes v JOIN nodes p ON p.depth = v.depth - 1 AND p.node = left(v.node, 32 * p.depth) GROUP BY p.node),
below AS (SELECT m.node, sum(v.own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM nodes v LEFT JOIN children k USING (node) JOIN members m ON m.m = v.conv_id AND m.depth <= v.depth GROUP BY m.node),
ends AS (SELECT node, sha256(string_agg(m::VARCHAR, ',' ORDER BY m)) AS hash
  FROM members JOIN (SELECT m, max(depth) AS depth FROM members GROUP BY m) USING (m, depth) GROUP BY node)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM nodes v JOIN below USING (node) LEFT JOIN children k USING (node) LEFT JOIN ends USING (node)
LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.node = left(v.node, 32 * p.depth)"""


SQL = {"op7_chat_formatting": _chat(), "op8_quality_rules": _rules(), "op10_mix_sources": _mixing(),
       "op11_conversation_repair": _repair(), "op13_rollup_trie": _trie()}
