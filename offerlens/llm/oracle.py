"""DuckDB SQL for the queries that SQL can express at the size of the driver's check."""

from __future__ import annotations

from offerlens.llm.quality_rules import RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_RULES = " AND ".join(f"{measure} {sign} {bound}::DOUBLE" for measure, sign, bound in RULES)

OP7 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop,
  len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper FROM w LEFT JOIN covered ON w.r = covered.r),
m AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_word_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END AS stop_word_ratio, CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS upper_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, mean_word_length, symbol_ratio, repeat_word_ratio, dup_line_ratio, stop_word_ratio, upper_ratio, base_failed,
  NOT base_failed AND {_RULES} AS kept FROM m
"""

#: Every 50-byte string by brute force, on hexadecimal digits, two for each byte.
OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
hit AS (SELECT g.doc_id, g.i, lag(g.i) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS before FROM g JOIN f USING (s) WHERE f.first < g.doc_id),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
piece AS (SELECT d.doc_id, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low FROM run) r JOIN d ON d.doc_id = r.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN piece ON d.doc_id = piece.doc_id
"""


#: crc32 by bytes: a table of the polynomial's 256 remainders, then one look-up a byte. crc({text}) needs the table as tab(t).
_CRC_TABLE = """(SELECT list(t ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, [1,2,3,4,5,6,7,8]::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS t
  FROM (SELECT unnest(range(256))::UBIGINT AS i)))"""


def _crc(text: str) -> str:
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"


#: Neighbours by the words that one deletion leaves: an edit is a deletion on one side, or one at the same place on both.
OP11 = rf"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)),
p AS (SELECT doc_id, run, count(*) AS n FROM o WHERE length(run) >= 6 GROUP BY ALL),
h AS MATERIALIZED (SELECT run, n, {_crc("doc_id::VARCHAR || ':' || run")} AS h FROM p, tab),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) AS form FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) WHERE m = top GROUP BY word),
counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(counted.n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN form END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word LEFT JOIN counted ON w.word = counted.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
last AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, last.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN last ON f.word = last.word
"""

#: Every 13-word window by brute force, as one string.
OP12 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 12, 0))) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(13) v(k)),
kept AS (SELECT d.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN x END, ' ' ORDER BY d.i) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d) d LEFT JOIN gone ON d.doc_id = gone.doc_id AND d.i = gone.i GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: Both trees level by level; a row's path is the runs that it lies in, upper ones after lower ones.
OP13 = rf"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
l AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('a' || source, 'A') AS k, sha256({_HEAD} || {_framed("text")}) AS leaf,
  CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN sha256({_HEAD} || {_framed(_LOW)}) END AS tried FROM documents, tab),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM l),
node AS (SELECT k, 0 AS lvl, i, n, leaf AS h FROM p UNION ALL SELECT k, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY k, lvl, i // 16, n),
sub AS MATERIALIZED (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS lvl, i, n, h FROM sub UNION ALL SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 16, n),
run AS MATERIALIZED (SELECT k, lvl, i // 16 AS g, list(h ORDER BY i) AS hs FROM node WHERE n > 1 GROUP BY k, lvl, i // 16),
toprun AS MATERIALIZED (SELECT lvl, i // 16 AS g, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY lvl, i // 16),
step AS (SELECT p.r, run.lvl AS lev, hs, (p.i // (16 ** run.lvl)::BIGINT) % 16 AS own FROM p JOIN run ON p.k = run.k AND run.g = p.i // (16 ** (run.lvl + 1))::BIGINT
  UNION ALL SELECT p.r, 100 + toprun.lvl, hs, (sub.i // (16 ** toprun.lvl)::BIGINT) % 16 FROM p JOIN sub ON p.k = sub.k JOIN toprun ON toprun.g = sub.i // (16 ** (toprun.lvl + 1))::BIGINT),
path AS MATERIALIZED (SELECT r, row_number() OVER (PARTITION BY r ORDER BY lev) AS s, array_to_string(hs[1 : own], '') AS lft, array_to_string(hs[own + 2 :], '') AS rgt FROM step),
proof AS (SELECT r, string_agg(lft || rgt, '' ORDER BY s) AS t FROM path GROUP BY r),
fold AS (SELECT r, 0::BIGINT AS s, coalesce(tried, leaf) AS h FROM p UNION ALL SELECT fold.r, path.s, sha256(lft || h || rgt) FROM fold JOIN path ON path.r = fold.r AND path.s = fold.s + 1),
folded AS (SELECT r, arg_max(h, s) AS h FROM fold GROUP BY r),
root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(proof.t, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root.h AS verified
FROM p JOIN sub ON p.k = sub.k JOIN folded ON p.r = folded.r LEFT JOIN proof ON p.r = proof.r, root
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_repeat_removal": OP1, "op7_quality_rules": OP7, "op11_spelling_variants": OP11, "op12_passage_removal": OP12, "op13_merkle_manifest": OP13}
