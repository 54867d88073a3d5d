"""SQL for DuckDB that gives the rows of two queries by plain means: paths over rows one after the other, and all nodes of all levels."""

from __future__ import annotations


def crc_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    step = "lambda crc, bit: CASE WHEN crc & 1 = 1 THEN xor(3988292384, crc >> 1) ELSE crc >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda letter: CAST(ascii(letter) AS BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda sum, code: list_reduce(range(8), {step}, xor(sum, code)), CAST(4294967295 AS BIGINT)))"


# --- conversation repair: the cheapest way to each state, row by row

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# States: 0 nothing, 1 a system role, 2 a user role, 3 an assistant role. Insertions from state to state, and rows that lead on.
INSERTS = "(VALUES (0, 0, []), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']), (1, 1, []), (1, 2, ['user:']), (1, 3, ['user:', 'assistant:']), (2, 2, []), (2, 3, ['assistant:']), (3, 3, []), (3, 2, ['user:'])) AS i(p, q, lines)"
CONVERSATION_REPAIR = f"""WITH RECURSIVE spots AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS spot FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN spot = 4 THEN 'user' ELSE role END AS role, CASE spot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN spot = 3 THEN 2 ELSE 1 END)) AS copy FROM spots WHERE spot <> 0),
numbered AS (SELECT *, row_number() OVER () AS id FROM damaged),
convs AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT conv, turn, role, text, row_number() OVER o AS place, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, id) > 1 AS again,
  rtrim(text, {BLANKS}) AS ended, lag(left(role, 1)) OVER o AS before
  FROM numbered d JOIN convs c ON d.conv_id IS NOT DISTINCT FROM c.conv_id WINDOW o AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), id)),
faults AS (SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
facts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv),
edits AS (SELECT conv, place, p, q, 'D' AS edit, 2 AS price, CAST([] AS VARCHAR[]) AS lines FROM faults, (VALUES (0, 0), (1, 1), (2, 2), (3, 3)) AS s(p, q) UNION ALL
  SELECT conv, place, p, q, 'K', CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, [role || ':' || text] FROM faults JOIN (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) AS s(p, q, step)
    ON initial = step WHERE fault NOT IN ('blank', 'duplicate') UNION ALL
  SELECT conv, place, p, q, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, [name || ':' || text] FROM faults, (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS s(p, q, name)
    WHERE fault NOT IN ('blank', 'duplicate')),
paths AS (
  SELECT conv, CAST(0 AS BIGINT) AS place, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM facts UNION ALL
  SELECT conv, place + 1, state, min(best) FROM (
    SELECT f.conv, f.place, e.q AS state, {{'cost': f.best.cost + 5 * len(i.lines) + e.price, 'audit': f.best.audit || repeat('I', len(i.lines)) || e.edit, 'lines': list_concat(f.best.lines, i.lines, e.lines)}} AS best
    FROM paths f JOIN {INSERTS} ON i.p = f.state JOIN edits e ON e.conv = f.conv AND e.place = f.place + 1 AND e.p = i.q) GROUP BY conv, place, state),
lasts AS (SELECT conv, max(place) AS last FROM placed GROUP BY conv),
repaired AS (SELECT conv, min({{'cost': best.cost + 5 * len(i.lines), 'audit': best.audit || repeat('I', len(i.lines)), 'lines': list_concat(best.lines, i.lines)}}) AS best
  FROM paths JOIN lasts USING (conv) JOIN {INSERTS} ON i.p = state WHERE place = last AND i.q IN (0, 3) GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM convs LEFT JOIN facts USING (conv) LEFT JOIN repaired USING (conv)"""


# --- Merkle manifest


def leaf_sql(n_chars: str) -> str:
    fields = [f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')" for e in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(fields) + ")"


CLAIMED = f"CASE WHEN {crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN CAST(n_chars AS HUGEINT) + 1 ELSE n_chars END"


def levels_sql(name: str, base: str) -> str:
    """Every node of trees (tree, level, place, n nodes on its level, h), from their leaves."""
    return f"""{name} AS (
  {base} UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // 2, n)"""


MERKLE_MANIFEST = f"""WITH RECURSIVE langs AS (SELECT lang AS of_lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
hashed AS (SELECT doc_id, tree, {leaf_sql('n_chars')} AS leaf, {leaf_sql(CLAIMED)} AS claimed FROM documents JOIN langs ON lang IS NOT DISTINCT FROM of_lang),
leaves AS (SELECT *, row_number() OVER t - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed WINDOW t AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claimed)),
{levels_sql('nodes', 'SELECT tree, 0 AS level, place, n, leaf AS h FROM leaves')},
subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
{levels_sql('upper', 'SELECT CAST(0 AS BIGINT) AS tree, 0 AS level, tree AS place, count(*) OVER () AS n, subroot AS h FROM subroots')},
tops AS (SELECT h AS root FROM upper WHERE n = 1),
own AS (SELECT l.tree, l.place AS leaf_place, o.level, s.h, l.place >> o.level & 1 AS is_right FROM leaves l JOIN nodes o ON o.tree = l.tree AND o.place = l.place >> o.level AND o.n > 1
  LEFT JOIN nodes s ON s.tree = o.tree AND s.level = o.level AND s.place = xor(o.place, 1)),
over AS (SELECT r.tree, o.level, s.h, r.tree >> o.level & 1 AS is_right FROM subroots r JOIN upper o ON o.place = r.tree >> o.level AND o.n > 1
  LEFT JOIN upper s ON s.level = o.level AND s.place = xor(o.place, 1)),
steps AS (SELECT tree, leaf_place, 0 AS part, level, h, is_right FROM own UNION ALL
  SELECT l.tree, l.place, 1, level, h, is_right FROM leaves l JOIN over USING (tree)),
proofs AS (SELECT tree, leaf_place, list({{'h': h, 'right': is_right}} ORDER BY part, level) AS steps FROM steps GROUP BY ALL),
folded AS (SELECT doc_id, l.tree, leaf, claimed, coalesce(steps, []) AS steps FROM leaves l LEFT JOIN proofs p ON p.tree = l.tree AND leaf_place = place)
SELECT doc_id, of_lang AS lang, leaf, subroot, root, sha256(array_to_string(list_filter(list_transform(steps, lambda s: s.h), lambda h: h IS NOT NULL), '')) AS proof_sha256,
  list_reduce(list_concat([claimed], list_transform(steps, lambda s: CASE WHEN s.h IS NULL THEN '-' WHEN s.right = 1 THEN 'l' || s.h ELSE 'r' || s.h END)),
    lambda node, s: sha256(CASE s[1] WHEN '-' THEN node WHEN 'l' THEN s[2:] || node ELSE node || s[2:] END)) AS folded_root, folded_root = root AS verified
FROM folded JOIN langs USING (tree) JOIN subroots USING (tree), tops"""
