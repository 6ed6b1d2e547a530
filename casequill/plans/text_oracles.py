"""DuckDB SQL for the text queries, written independently of the Spark expressions."""

from __future__ import annotations

from casequill.plans.inputs import GIVEN_NAMES, MIDDLE_NAMES, STREETS, TEST_PHRASES
from casequill.sources import rules

NL = "chr(10)"
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NWS = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD = r"\p{L}\p{N}_"
TOKEN = r"[\p{L}\p{Nl}\p{No}\x{0300}-\x{036f}]+(?:[-''][\p{L}\p{Nl}\p{No}\x{0300}-\x{036f}]+)*"

PARA = f"""para AS (
  SELECT doc_id, source, unnest(string_split(text, {NL})) AS t,
         CAST(generate_subscripts(string_split(text, {NL}), 1) AS BIGINT) AS para_no
  FROM documents)"""

# characters with their position, then each formatting rule by runs of characters
KEPT = f"""{PARA},
ch AS (SELECT doc_id, para_no, unnest(string_split(t, '')) AS c,
              CAST(generate_subscripts(string_split(t, ''), 1) AS BIGINT) AS i FROM para WHERE t <> ''),
flags AS (SELECT *, c IN (' ', chr(9)) AS blank, regexp_matches(c, '{WS}') AS ws,
                 lead(c) OVER (PARTITION BY doc_id, para_no ORDER BY i) AS nx FROM ch),
blank_runs AS (
  SELECT doc_id, para_no, min(i) - 1 AS s, max(i) AS e FROM (
    SELECT doc_id, para_no, i, i - row_number() OVER (PARTITION BY doc_id, para_no ORDER BY i) AS g
    FROM flags WHERE blank) GROUP BY doc_id, para_no, g HAVING count(*) > 1),
ws_runs AS (
  SELECT doc_id, para_no, min(i) - 1 AS s, max(i) AS e, arg_max(nx, i) AS mark FROM (
    SELECT doc_id, para_no, i, nx, i - row_number() OVER (PARTITION BY doc_id, para_no ORDER BY i) AS g
    FROM flags WHERE ws) GROUP BY doc_id, para_no, g),
r1 AS (SELECT doc_id, para_no, s, e, ' ' AS suggestion, '{rules.MESSAGE_SPACES}' AS message FROM blank_runs),
r2 AS (SELECT doc_id, para_no, s, e + 1 AS e, mark AS suggestion, '{rules.MESSAGE_SPACE_BEFORE}' AS message
       FROM ws_runs w WHERE mark IN (',', ';', ':', '!', '?')
         AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.doc_id = w.doc_id AND r1.para_no = w.para_no AND r1.s < w.e + 1 AND r1.e > w.s)),
r3 AS (SELECT doc_id, para_no, i - 1 AS s, i AS e, c || ' ' AS suggestion, '{rules.MESSAGE_NO_SPACE_AFTER}' AS message
       FROM flags f WHERE c IN (',', ';', ':', '!', '?') AND nx IS NOT NULL AND NOT regexp_matches(nx, '{WS}|\\p{{Nd}}')
         AND NOT EXISTS (SELECT 1 FROM r2 WHERE r2.doc_id = f.doc_id AND r2.para_no = f.para_no AND r2.s < f.i AND r2.e > f.i - 1)),
kept AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""


def _phrase_counts() -> str:
    """Doubling every separator lets neighbouring hits each have their own boundary."""
    parts = []
    for wrong, right in TEST_PHRASES.items():
        spaced = wrong.replace(" ", "  ")
        parts.append(
            f"SELECT doc_id, '{right.replace(chr(39), chr(39) * 2)}' AS suggestion, "
            f"len(regexp_extract_all(d, '[^{WORD}]{spaced}[^{WORD}]')) AS hits FROM doubled"
        )
    return (
        f"doubled AS (SELECT doc_id, {NL} || regexp_replace(lower(text), '([^{WORD}])', '\\1\\1', 'g') || {NL} AS d FROM documents), "
        "phrase AS (" + " UNION ALL ".join(parts) + ")"
    )


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} + 1 AS INTEGER)]"


NOTES = f"""fields AS (
  SELECT c_custkey AS doc_id,
         concat_ws(' ', {_pick(rules.SURNAMES, 'c_custkey')}, {_pick(MIDDLE_NAMES, 'c_custkey')}, {_pick(GIVEN_NAMES, 'c_custkey // 7')}) AS person,
         concat_ws(' ', {_pick(rules.SURNAMES, 'c_custkey // 3 + 11')}, {_pick(GIVEN_NAMES, 'c_custkey + 5')}) AS witness,
         '0' || lpad(CAST(c_custkey AS VARCHAR), 11, '1') AS id12,
         '09' || lpad(CAST(c_custkey AS VARCHAR), 8, '2') AS phone,
         'số ' || (c_custkey % 300 + 1) || ', đường ' || {_pick(STREETS, 'c_custkey')} || ', phường ' || (c_nationkey + 1) AS address
  FROM customer),
notes AS (SELECT *, 'Bị cáo ' || person || ', CCCD: ' || id12 || '; điện thoại: ' || phone || '.' || {NL} || 'Địa chỉ: ' || address
                    || {NL} || 'Người làm chứng ' || witness || ' khai đã gặp bà ' || person || ' tại tòa án.' AS text FROM fields),
found AS (
  SELECT doc_id, 1 AS entity_no, 'SĐT' AS type, phone AS value, text, substr(phone, 1, 4) || 'xxxx' || right(phone, 3) AS suggestion FROM notes
  UNION ALL SELECT doc_id, 2, 'CCCD', id12, text, substr(id12, 1, 3) || 'xxx' || right(id12, 3) FROM notes
  UNION ALL SELECT doc_id, 3, 'Địa chỉ', address, text, 'Địa chỉ [Đã ẩn]' FROM notes
  UNION ALL SELECT doc_id, 4, 'Tên', person, text, 'Tên-A' FROM notes
  UNION ALL SELECT doc_id, 5, 'Tên', witness, text, 'Tên-B' FROM notes)"""

def _letters(column: str) -> str:
    """Every accented letter of the test languages as one capital: DuckDB counts edits in bytes."""
    return f"translate({column}, 'äöüßéèêàçëîïôûùâœñáíóú', 'ABCDEFGHIJKLMNOPQRSTUV')"


_SUGGEST = f"""WITH known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{TOKEN}'))) AS word FROM benchmark),
sources AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{TOKEN}'))) AS word FROM documents),
unknown AS (SELECT word, strip_accents(word) AS bare FROM sources WHERE length(word) > 1 AND word NOT IN (SELECT word FROM known)),
names AS (SELECT word AS candidate, strip_accents(word) AS bare FROM known),
pairs AS (
  SELECT u.word, n.candidate,
         1.0::DOUBLE - levenshtein({_letters('u.bare')}, {_letters('n.bare')})::DOUBLE / greatest(length(u.bare), length(n.bare)) AS base,
         1.0::DOUBLE - levenshtein({_letters('u.word')}, {_letters('n.candidate')})::DOUBLE / greatest(length(u.word), length(n.candidate)) AS ratio
  FROM unknown u JOIN names n ON length(n.candidate) BETWEEN length(u.word) - 2 AND length(u.word) + 2
   AND levenshtein({_letters('u.bare')}, {_letters('n.bare')}) <= 0.34 * greatest(length(u.bare), length(n.bare))),
scored AS (SELECT *, ratio * 0.65::DOUBLE + base * 0.35::DOUBLE AS score FROM pairs WHERE base >= 0.67),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, length(candidate), candidate) AS rank FROM scored)
SELECT word, rank, candidate, round(ratio, 6) AS ratio, round(score, 6) AS score FROM ranked WHERE rank <= 3"""

_KNOWN = f"known AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{TOKEN}'))) AS word FROM benchmark)"

# the line as pieces in order; g marks the words that are asked for
_GUARDED = f"""WITH {_KNOWN},
keyed AS (SELECT p_partkey AS doc_id, CAST(p_partkey AS VARCHAR) AS n, 'zq' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'bcdfghjklm') AS w FROM part),
pieces AS (SELECT doc_id, unnest(ps) AS p, unnest(gs) AS g, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id,
  ['Xem', ' ', w, ' https://tòa.vn/' || w || '/x ', 'và', ' ' || w || '.q@vn.example.org ', 'nhé', ' ', w, ' 12/2020/' || w || ' TANDTC ', 'nặng', ' ' || n || ' kg ',
   'hay', ' ', 'kg', ' ', w, ' bị cáo Nguyễn Văn Zung of the ', w, '.'] AS ps,
  [true, false, true, false, true, false, true, false, true, false, true, false, true, false, true, false, true, false, true, false] AS gs FROM keyed)),
lined AS (SELECT doc_id, string_agg(p, '' ORDER BY i) AS text FROM pieces GROUP BY doc_id),
spots AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM pieces)
SELECT doc_id, CAST(1 AS BIGINT) AS para_no, e - length(p) AS start_pos, e AS end_pos, p AS token, lower(p) AS word,
  CASE WHEN e - length(p) > 55 THEN '…' ELSE '' END || substr(text, greatest(e - length(p) - 55, 0) + 1, least(length(text), e + 55) - greatest(e - length(p) - 55, 0))
  || CASE WHEN e + 55 < length(text) THEN '…' ELSE '' END AS context
FROM spots JOIN lined USING (doc_id) WHERE g AND lower(p) NOT IN (SELECT word FROM known)"""

_WARNINGS = f"""WITH {_KNOWN},
items AS (SELECT item_id, regexp_extract_all(text, '[a-z]{{5,}}') AS ws FROM benchmark),
chosen AS (SELECT p_partkey AS doc_id, ws[CAST((p_partkey // 7) % len(ws) + 1 AS INTEGER)] AS w
  FROM part JOIN items ON item_id = p_partkey % (SELECT count(*) FROM benchmark) WHERE len(ws) > 0),
wrong AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN w[1] || substr(w, 3) ELSE w || right(w, 1) END AS w FROM chosen),
sources AS (SELECT DISTINCT w AS word FROM wrong WHERE w NOT IN (SELECT word FROM known)),
pairs AS (SELECT s.word, k.word AS candidate,
    1.0::DOUBLE - levenshtein({_letters('s.word')}, {_letters('strip_accents(k.word)')})::DOUBLE / greatest(length(s.word), length(k.word)) AS base,
    1.0::DOUBLE - levenshtein({_letters('s.word')}, {_letters('k.word')})::DOUBLE / greatest(length(s.word), length(k.word)) AS ratio
  FROM sources s JOIN known k ON length(k.word) BETWEEN length(s.word) - 2 AND length(s.word) + 2),
best AS (SELECT word, candidate, ratio FROM pairs WHERE base >= 0.67 QUALIFY row_number() OVER
  (PARTITION BY word ORDER BY ratio * 0.65::DOUBLE + base * 0.35::DOUBLE DESC, length(candidate), candidate) = 1),
spelt AS (SELECT doc_id, w, 3 AS s, w AS original, candidate AS suggestion, ratio FROM wrong JOIN best ON word = w WHERE ratio >= 0.78
  UNION ALL SELECT doc_id, w, 7 + length(w), upper(w[1]) || substr(w, 2), upper(candidate[1]) || substr(candidate, 2), ratio FROM wrong JOIN best ON word = w WHERE ratio >= 0.86)
SELECT doc_id, CAST(s AS BIGINT) AS start_pos, CAST(s + length(w) AS BIGINT) AS end_pos, '{rules.KIND_SPELLING}' AS kind, 'warning' AS severity, original, suggestion,
  CAST(least(95, greatest(62, round_even(ratio * 100, 0))) AS BIGINT) AS confidence FROM spelt"""

_COUNTS = f"""WITH {KEPT}, {_phrase_counts()},
style AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id),
errors AS (SELECT doc_id, sum(hits) AS n FROM phrase GROUP BY doc_id),
per_doc AS (SELECT d.doc_id, d.source, coalesce(e.n, 0) AS error, 0 AS warning, coalesce(s.n, 0) AS style
            FROM documents d LEFT JOIN style s USING (doc_id) LEFT JOIN errors e USING (doc_id))"""

_BY_SOURCE = _COUNTS + """
SELECT source, CAST(sum(error) AS BIGINT) AS error, CAST(sum(warning) AS BIGINT) AS warning, CAST(sum(style) AS BIGINT) AS style
FROM per_doc GROUP BY source HAVING sum(error) + sum(style) > 0"""

_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"

_BOUNDED = "chr(1) || regexp_replace(text, '([^" + WORD + "])', '\\1' || chr(1), 'g') || chr(10)"


def _replace_word(text: str, old: str, new: str) -> str:
    """Whole-word literal replacement on text whose separators are followed by chr(1)."""
    return f"regexp_replace({text}, chr(1) || regexp_escape({old}) || '([^{WORD}])', chr(1) || {new} || '\\1', 'g')"


ORACLES = {
    "paragraph_scan": f"WITH {PARA} SELECT doc_id, para_no, '{rules.BODY_LOCATION}' AS location, t AS text FROM para",
    "paragraph_join": "SELECT doc_id, CAST(0 AS BIGINT) AS part_no, text FROM documents",
    "word_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{NWS}+')) AS BIGINT) AS words FROM documents",
    "rule_issue_counts_by_source": _BY_SOURCE,
    "streamed_issue_counts": _BY_SOURCE,
    "rule_issue_counts_by_document": _COUNTS
    + " SELECT doc_id, CAST(error AS BIGINT) AS error, CAST(warning AS BIGINT) AS warning, CAST(style AS BIGINT) AS style FROM per_doc WHERE error + style > 0",
    "formatting_issues": f"""WITH {KEPT}
SELECT k.doc_id, k.para_no, s AS start_pos, e AS end_pos, substr(t, s + 1, e - s) AS original, suggestion, message,
       CASE WHEN s > 55 THEN '…' ELSE '' END || substr(t, greatest(s - 55, 0) + 1, least(length(t), e + 55) - greatest(s - 55, 0))
       || CASE WHEN e + 55 < length(t) THEN '…' ELSE '' END AS context
FROM kept k JOIN para USING (doc_id, para_no)""",
    "phrase_issue_counts": f"WITH {_phrase_counts()} SELECT doc_id, suggestion, CAST(hits AS BIGINT) AS hits FROM phrase WHERE hits > 0",
    "numbered_issues": f"""WITH {KEPT}
SELECT doc_id, 'issue-' || row_number() OVER (PARTITION BY doc_id ORDER BY para_no, s) AS id, para_no,
       row_number() OVER (PARTITION BY doc_id, para_no ORDER BY s) AS para_index, s AS start_pos FROM kept""",
    "accepted_issues": f"""WITH {KEPT} SELECT doc_id, count(*) AS accepted FROM kept k JOIN para USING (doc_id, para_no)
WHERE substr(t, s + 1, e - s) NOT IN ('?', '!') GROUP BY doc_id""",
    "reviewed_texts": f"""WITH {KEPT},
inside AS (SELECT c.doc_id, c.para_no, c.i, c.c, k.s, k.suggestion, k.message, k.e
           FROM ch c LEFT JOIN kept k ON k.doc_id = c.doc_id AND k.para_no = c.para_no AND c.i > k.s AND c.i <= k.e),
built AS (SELECT doc_id, para_no,
   string_agg(CASE WHEN s IS NULL THEN c WHEN i = s + 1 THEN suggestion ELSE '' END, '' ORDER BY i) AS corrected,
   string_agg(CASE WHEN i = s + 1 THEN '<mark class="style" title="' || message || '">' ELSE '' END || {_ESC.format('c')}
              || CASE WHEN i = e THEN '</mark>' ELSE '' END, '' ORDER BY i) AS marked
   FROM inside GROUP BY doc_id, para_no)
SELECT p.doc_id, p.para_no, coalesce(corrected, '') AS corrected, coalesce(marked, '') AS marked FROM para p LEFT JOIN built USING (doc_id, para_no)""",
    "issue_payloads": f"""WITH {KEPT},
nested AS (SELECT k.doc_id, k.para_no, string_agg('{{"start":' || s || ',"end":' || e || ',"original":"'
   || replace(replace(substr(t, s + 1, e - s), chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't') || '","severity":"style"}}', ',' ORDER BY s) AS j
   FROM kept k JOIN para USING (doc_id, para_no) GROUP BY k.doc_id, k.para_no)
SELECT p.doc_id, p.para_no, '{{"issues":[' || coalesce(j, '') || ']}}' AS payload
FROM para p LEFT JOIN nested USING (doc_id, para_no) WHERE regexp_matches(t, '{NWS}')""",
    "detection_quality": """SELECT count(*) FILTER (contains(text, ', ')) AS error_cases, count(*) FILTER (contains(text, ', ')) AS caught,
count(*) AS clean_cases, CAST(0 AS BIGINT) AS false_alarms FROM benchmark""",
    "token_statistics": f"""SELECT lang, count(*) AS tokens, count(DISTINCT lower(token)) AS distinct_words
FROM (SELECT lang, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents) GROUP BY lang""",
    "unknown_words": f"""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{TOKEN}'))) AS word FROM documents),
good AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT word, count(*) AS uses FROM t WHERE doc_id NOT IN (SELECT doc_id FROM good)
  AND word NOT IN (SELECT word FROM t WHERE doc_id IN (SELECT doc_id FROM good)) GROUP BY word""",
    "suggestions_by_edits": _SUGGEST,
    "protected_tokens": _GUARDED,
    "dictionary_warnings": _WARNINGS,
    "note_entities": f"""WITH {NOTES} SELECT doc_id, CAST(entity_no AS BIGINT) AS entity_no, type, value,
CAST(strpos(text, value) - 1 AS BIGINT) AS first_pos, suggestion FROM found""",
    "anonymised_notes": f"""WITH {NOTES} SELECT doc_id, 'Bị cáo Tên-A, CCCD: ' || substr(id12, 1, 3) || 'xxx' || right(id12, 3) || '; điện thoại: '
|| substr(phone, 1, 4) || 'xxxx' || right(phone, 3) || '.' || {NL} || 'Địa chỉ: Địa chỉ [Đã ẩn]' || {NL}
|| 'Người làm chứng Tên-B khai đã gặp bà Tên-A tại tòa án.' AS text, CAST(6 AS BIGINT) AS replaced FROM notes""",
    "entity_payloads": f"""WITH {NOTES} SELECT doc_id, '{{"entities":[' || string_agg('{{"type":"' || type || '","value":"' || value || '","suggestion":"'
|| suggestion || '"}}', ',' ORDER BY entity_no) || ']}}' AS payload FROM found GROUP BY doc_id""",
    "personal_numbers": r"""WITH texts AS (SELECT 'document' AS origin, doc_id, CAST(0 AS BIGINT) AS turn, text FROM documents
  UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations),
runs AS (SELECT DISTINCT origin, doc_id, turn, unnest(regexp_extract_all(text, '\p{Nd}+')) AS value FROM texts),
doubled AS (SELECT origin, doc_id, turn, chr(10) || regexp_replace(text, '(\P{Nd})', '\1\1', 'g') || chr(10) AS d FROM texts),
hits AS (SELECT origin, doc_id, turn, unnest(regexp_extract_all(d, '\P{Nd}((?:\+\+84|0)(?:(?:  |\.\.|--)?\p{Nd}){9,10})\P{Nd}', 1)) AS h FROM doubled),
phones AS (SELECT DISTINCT origin, doc_id, turn, replace(replace(replace(replace(h, '++', '+'), '  ', ' '), '..', '.'), '--', '-') AS value FROM hits),
digits AS (SELECT *, regexp_replace(value, '\P{Nd}', '', 'g') AS n FROM phones)
SELECT origin, doc_id, turn, 'SĐT' AS type, value, substr(n, 1, 4) || 'xxxx' || right(n, 3) AS mask FROM digits
 WHERE CASE WHEN starts_with(value, '+84') THEN length(n) IN (11, 12) ELSE length(n) IN (10, 11) END
UNION ALL SELECT origin, doc_id, turn, CASE length(value) WHEN 12 THEN 'CCCD' ELSE 'CMND' END, value, substr(value, 1, 3) || 'xxx' || right(value, 3)
 FROM runs WHERE length(value) IN (9, 12)""",
    "replaced_terms": f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[{WORD}]+') AS ws FROM documents),
o AS (SELECT doc_id, {_BOUNDED} AS b, ws[1] AS w1, ws[-1] AS w2 FROM w WHERE len(ws) > 0),
pick AS (SELECT doc_id, b,
   CASE WHEN lower(w1) = lower(w2) OR length(w1) >= length(w2) THEN w1 ELSE w2 END AS old1,
   CASE WHEN lower(w1) = lower(w2) OR length(w1) >= length(w2) THEN '[Ẩn]' ELSE '$1-' || chr(92) || chr(92) END AS new1,
   CASE WHEN lower(w1) = lower(w2) THEN NULL WHEN length(w1) >= length(w2) THEN w2 ELSE w1 END AS old2,
   CASE WHEN length(w1) >= length(w2) THEN '$1-' || chr(92) || chr(92) ELSE '[Ẩn]' END AS new2 FROM o),
once AS (SELECT *, len(regexp_extract_all(b, chr(1) || regexp_escape(old1) || '[^{WORD}]')) AS n1, {_replace_word('b', 'old1', 'new1')} AS t1 FROM pick),
again AS (SELECT *, chr(1) || regexp_replace(replace(t1, chr(1), ''), '([^{WORD}])', '\\1' || chr(1), 'g') AS b2 FROM once),
twice AS (SELECT doc_id, n1, CASE WHEN old2 IS NULL THEN 0 ELSE len(regexp_extract_all(b2, chr(1) || regexp_escape(old2) || '[^{WORD}]')) END AS n2,
   CASE WHEN old2 IS NULL THEN t1 ELSE {_replace_word('b2', 'old2', 'new2')} END AS t2 FROM again)
SELECT doc_id, replace(t2, chr(1), '')[:-2] AS text, CAST(n1 + n2 AS BIGINT) AS replaced FROM twice""",
    "replacement_lists": f"""WITH words AS (SELECT item_id, unnest(ws) AS old, generate_subscripts(ws, 1) AS seq
  FROM (SELECT item_id, regexp_extract_all(text, '[{WORD}]+') AS ws FROM benchmark)),
uniq AS (SELECT item_id, old, seq FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(old) ORDER BY seq) AS r FROM words) WHERE r = 1),
lists AS (SELECT u.item_id, count(*) AS usable, arg_min(old, (-length(old)) * 100000 + seq) AS first_old,
   any_value(n) > 500 AS too_many FROM uniq u JOIN (SELECT item_id, count(*) AS n FROM words GROUP BY item_id) USING (item_id) GROUP BY u.item_id)
SELECT doc_id, usable, first_old, CASE WHEN too_many THEN 'too many replacements' END AS reject_reason
FROM documents d JOIN lists l ON l.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""",
    "reviewed_documents": f"""WITH words AS (SELECT item_id, unnest(ws) AS old, generate_subscripts(ws, 1) AS seq
  FROM (SELECT item_id, regexp_extract_all(text, '[{WORD}]+') AS ws FROM benchmark)),
uniq AS (SELECT item_id, old, CASE WHEN (seq - 1) % 3 = 0 THEN '{rules.MASK_DEFAULT}' ELSE '<#>' END AS new
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(old) ORDER BY seq) AS r FROM words) WHERE r = 1),
lists AS (SELECT b.item_id, count(old) AS usable, max(len(regexp_extract_all(b.text, '[{WORD}]+'))) AS given FROM benchmark b LEFT JOIN uniq USING (item_id) GROUP BY b.item_id),
docs AS (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents),
pieces AS (SELECT doc_id, item_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
  FROM (SELECT doc_id, item_id, regexp_extract_all(text, '[{WORD}]+|[^{WORD}]+') AS ps FROM docs)),
built AS (SELECT doc_id, string_agg(coalesce(new, p), '' ORDER BY i) AS t, count(new) AS n
  FROM pieces p LEFT JOIN uniq u ON u.item_id = p.item_id AND u.old = p.p GROUP BY doc_id)
SELECT d.doc_id, coalesce(t, text) AS text, coalesce(n, 0) AS replaced, usable, CAST(1 AS BIGINT) AS empty, CAST(given - usable AS BIGINT) AS repeated,
  CASE WHEN usable = 0 THEN 'nothing selected' END AS reject_reason FROM docs d LEFT JOIN lists USING (item_id) LEFT JOIN built USING (doc_id)""",
    "decoded_texts": "SELECT doc_id, md5(text) AS digest, false AS truncated FROM documents",
}
