"""DuckDB SQL for the file, page, loan, fee, term and register queries."""

from __future__ import annotations

from casequill.plans.text_oracles import NL, WORD, WS, _pick
from casequill.sources import rules

TITLES = f"""titles AS (
  SELECT doc_id, n_chars, source AS folder,
         translate(split_part(text, {NL}, 1), '/.', '--') || ' ' || doc_id AS stem,
         {_pick(('.docx', '.PDF', '.txt', '.md', '.zip', '.png'), 'doc_id')} AS suffix FROM documents),
named AS (SELECT *, folder || '/' || stem || suffix AS path, stem || suffix AS name FROM titles WHERE NOT starts_with(stem, '.'))"""

ACCENT = f"(?i)[{rules.ACCENTED_LETTERS}]"
SPECIAL = rf"[^{WORD}\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\-.()\[\],&+]"
REASONS = f"""found AS (SELECT *, regexp_extract_all(stem, '{SPECIAL}+') AS sp FROM named),
reasons AS (SELECT *, concat_ws('; ',
   CASE WHEN regexp_matches(stem, '{ACCENT}') THEN '{rules.REASON_ACCENTS}' END,
   CASE WHEN length(stem) > 60 THEN 'Ten qua dai (' || length(stem) || ' ky tu, toi da 60)' END,
   CASE WHEN len(sp) > 0 THEN '{rules.REASON_SPECIAL}' || concat_ws(', ', sp[1], CASE WHEN sp[2] <> sp[1] THEN sp[2] END,
        CASE WHEN sp[3] <> sp[1] AND sp[3] <> sp[2] THEN sp[3] END) END,
   CASE WHEN contains(stem, '  ') THEN '{rules.REASON_SPACES}' END,
   CASE WHEN contains(stem, '__') THEN '{rules.REASON_UNDERSCORES}' END) AS reasons FROM found)"""


def _squeeze(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


def _abbreviated(column: str) -> str:
    """The abbreviation rules one after the other on text whose separators are followed by chr(1)."""
    sql = f"chr(1) || regexp_replace({column}, '([^{WORD}])', '\\1' || chr(1), 'g') || chr(10)"
    for full, short in sorted(rules.ABBREVIATIONS.items(), key=lambda kv: len(kv[0]), reverse=True):
        inner = full.replace(" ", " ' || chr(1) || '")
        sql = f"regexp_replace({sql}, chr(1) || '(?i:{inner})([^{WORD}])', chr(1) || '{short}\\1', 'g')"
    return _squeeze(f"replace({sql}, chr(1), '')")


CLEAN = f"""{TITLES}, {REASONS},
plain AS (SELECT path, name, suffix, CASE WHEN regexp_matches(stem, '{ACCENT}') THEN strip_accents(stem) ELSE stem END AS x
          FROM reasons WHERE reasons <> ''),
cleaned AS (SELECT *, regexp_replace(regexp_replace({_squeeze(f"regexp_replace(x, '{SPECIAL}', '', 'g')")}, '-{{2,}}', '-', 'g'), '_{{2,}}', '_', 'g') AS y FROM plain),
short1 AS (SELECT *, {_abbreviated('y')} AS a FROM cleaned),
short2 AS (SELECT *, {_abbreviated('a')} AS b FROM short1),
short3 AS (SELECT *, {_squeeze(f"regexp_replace(b, '(?i)(^|[^{WORD}])(?:ngay|thang|nam) +[0-9]+($|[^{WORD}])', '\\1\\2', 'g')")} AS c FROM short2),
final AS (SELECT *, CASE WHEN length(a) <= 60 THEN a WHEN length(b) <= 60 THEN b WHEN length(c) <= 60 THEN c ELSE rtrim(substr(c, 1, 58)) || '..' END AS s FROM short3),
targets AS (SELECT path, name, CASE WHEN s = '' THEN 'file' ELSE s END || suffix AS target FROM final)"""

PARTS = """part_files AS (
  SELECT p_type AS folder, p_name || translate(CAST(p_partkey AS VARCHAR), '0123456789', '!@#$%^*=~?') || '.docx' AS name FROM part
  UNION ALL SELECT p_type, p_name || CASE WHEN min(p_size) % 2 = 0 THEN '_2' ELSE '' END || '.docx' FROM part GROUP BY p_type, p_name),
wanted AS (
  SELECT folder, name, folder || '/' || name AS path,
         contains(name, '!@') AND NOT contains(name, '#') AS custom,
         CASE WHEN contains(name, '!@') AND NOT contains(name, '#') THEN 'Hồ sơ.docx'
              ELSE regexp_replace(name, '[!@#$%^*=~?]', '', 'g') END AS target
  FROM part_files WHERE regexp_matches(name, '[!@#$%^*=~?]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, target ORDER BY path) AS k FROM wanted),
in_use AS (SELECT DISTINCT folder, name FROM part_files UNION SELECT DISTINCT folder, target FROM wanted),
slots AS (
  SELECT t.folder, t.target, n, CASE WHEN n = 0 THEN t.target ELSE regexp_replace(t.target, '\\.docx$', '') || '_' || n || '.docx' END AS candidate
  FROM (SELECT DISTINCT folder, target FROM wanted) t, range(0, (SELECT count(*) FROM in_use) + 1) r(n)),
free AS (
  SELECT s.folder, s.target, candidate, row_number() OVER (PARTITION BY s.folder, s.target ORDER BY n) AS k FROM slots s
  WHERE CASE WHEN n = 0 THEN (s.folder, candidate) NOT IN (SELECT (folder, name) FROM part_files)
             ELSE (s.folder, candidate) NOT IN (SELECT (folder, name) FROM in_use) END),
plan AS (
  SELECT r.path, r.folder, r.name AS old_name, f.candidate AS new_name, r.folder || '/' || f.candidate AS new_path, r.custom,
         CASE WHEN f.candidate IS NULL THEN 'ERROR' ELSE 'PROPOSED' END AS status
  FROM ranked r LEFT JOIN free f ON f.folder = r.folder AND f.target = r.target AND f.k = r.k)"""


def _pages(head: str, page: str, tail: str, fmt: str) -> str:
    return f"""SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part_no, 'hs-' || conv_id || '_OCR_20260101_000000.{fmt}' AS file_name,
{head} || string_agg({page}, '' ORDER BY turn) || {tail} AS text FROM conversations GROUP BY conv_id"""


BODY = f"regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')"
RESULTS = """results AS (SELECT conv_id AS doc_id, 'hs-' || conv_id || CASE WHEN conv_id % 7 = 0 THEN '.txt' ELSE '.pdf' END AS filename,
  conv_id % 7 <> 0 AS success, CASE WHEN conv_id % 7 <> 0 THEN count(*) END AS total_pages,
  CASE WHEN conv_id % 7 = 0 THEN 'extension' END AS error FROM conversations GROUP BY conv_id)"""

LOANS = """all_payments AS (
  SELECT l_orderkey AS loan_id, CAST(CAST(l_shipdate AS DATE) + INTERVAL 240 MONTH AS DATE) AS date,
         CAST(l_quantity * 10 AS DECIMAL(20,2)) AS principal_paid, CAST(l_quantity * 3 AS DECIMAL(20,2)) AS interest_paid FROM lineitem),
paid_span AS (SELECT loan_id, min(date) AS first_paid, max(date) AS last_paid FROM all_payments GROUP BY loan_id),
as_agreed AS (
  SELECT o_orderkey AS loan_id, CAST(o_totalprice AS DECIMAL(20,2)) AS principal,
         CAST(CASE WHEN o_orderkey % 5 = 0 THEN 15.0 ELSE o_orderkey % 9 + 6.5 END AS DECIMAL(9,4)) AS base_rate,
         CASE WHEN o_orderkey % 4 = 0 THEN CAST(15.25 AS DECIMAL(9,4)) END AS agreed,
         o_orderkey % 3 = 0 AS fixed, o_custkey % 24 + 1 AS months, o_orderkey % 30 AS days,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL 240 MONTH AS DATE) AS start_date FROM orders),
loans AS (SELECT a.* REPLACE (least(start_date, first_paid) AS start_date), start_date AS agreed_start, last_paid FROM as_agreed a LEFT JOIN paid_span USING (loan_id)),
termed AS (
  SELECT *, CAST(CAST(start_date + to_months(CAST(months AS INTEGER)) AS DATE) + CAST(days AS INTEGER) AS DATE) AS due_date,
         greatest(agreed_start + CAST(loan_id % 40 * 30 + 100 AS INTEGER), last_paid) + 1 AS accrual_end FROM loans),
payments AS (SELECT * FROM all_payments),
rates AS (
  SELECT loan_id, CAST(12.5 AS DECIMAL(9,4)) AS rate, agreed_start + 10 AS from_date, agreed_start + 40 AS to_date FROM loans WHERE loan_id % 2 = 0
  UNION ALL SELECT loan_id, CAST(18.0 AS DECIMAL(9,4)), agreed_start + 41, agreed_start + 60 FROM loans WHERE loan_id % 2 = 0),
cuts AS (
  SELECT loan_id, start_date AS d FROM termed UNION SELECT loan_id, due_date FROM termed UNION SELECT loan_id, accrual_end FROM termed
  UNION SELECT loan_id, DATE '2018-01-01' FROM termed UNION SELECT loan_id, date FROM payments
  UNION SELECT loan_id, from_date FROM rates UNION SELECT loan_id, to_date + 1 FROM rates),
pieces AS (SELECT loan_id, d AS seg_start, lead(d) OVER (PARTITION BY loan_id ORDER BY d) AS seg_end FROM cuts),
per_day AS (SELECT loan_id, date, sum(principal_paid) AS paid, sum(interest_paid) AS interest FROM payments GROUP BY loan_id, date),
balanced AS (
  SELECT c.loan_id, c.seg_start, c.seg_end, t.fixed, t.principal, t.due_date, t.base_rate, t.agreed,
         t.principal - coalesce(sum(p.paid) OVER (PARTITION BY c.loan_id ORDER BY c.seg_start ROWS UNBOUNDED PRECEDING), 0) AS balance
  FROM pieces c JOIN termed t USING (loan_id) LEFT JOIN per_day p ON p.loan_id = c.loan_id AND p.date = c.seg_start
  WHERE c.seg_start >= t.start_date AND c.seg_start < t.accrual_end),
rated AS (
  SELECT b.*, date_diff('day', seg_start, seg_end) AS days, CASE WHEN fixed THEN principal ELSE balance END AS amount,
         seg_start >= due_date AS overdue, coalesce(r.rate, base_rate) AS in_term,
         CASE WHEN seg_start < DATE '2018-01-01' THEN 360 ELSE 365 END AS basis
  FROM balanced b LEFT JOIN rates r ON r.loan_id = b.loan_id AND b.seg_start BETWEEN r.from_date AND r.to_date),
segs AS (
  SELECT *, CAST(CASE WHEN overdue THEN coalesce(agreed, CAST(in_term * 1.5 AS DECIMAL(9,4))) ELSE in_term END AS DECIMAL(9,4)) AS year_rate FROM rated),
valued AS (SELECT *, CAST(CAST(amount AS DECIMAL(18,2)) * year_rate AS DECIMAL(28,6)) * days AS num FROM segs)"""

MATRIX = """sums AS (SELECT loan_id,
   coalesce(sum(num) FILTER (NOT overdue AND basis = 360), 0)::DOUBLE / 100 / 360 + coalesce(sum(num) FILTER (NOT overdue AND basis = 365), 0)::DOUBLE / 100 / 365 AS t,
   coalesce(sum(num) FILTER (overdue AND basis = 360), 0)::DOUBLE / 100 / 360 + coalesce(sum(num) FILTER (overdue AND basis = 365), 0)::DOUBLE / 100 / 365 AS o
   FROM valued GROUP BY loan_id),
paid AS (SELECT loan_id, sum(principal_paid) AS pp, sum(interest_paid)::DOUBLE AS ip FROM payments GROUP BY loan_id),
owed AS (SELECT loan_id, (principal - coalesce(pp, 0))::DOUBLE AS principal_left, greatest(t - coalesce(ip, 0), 0) AS in_term_left,
   greatest(o - greatest(coalesce(ip, 0) - t, 0), 0) AS overdue_left FROM termed JOIN sums USING (loan_id) LEFT JOIN paid USING (loan_id))"""

_ROUND = "floor({0} * 100 + 0.5) / 100 AS {0}"

CALENDAR = """days AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS TIMESTAMP)), max(CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 3 YEAR, INTERVAL 1 DAY)) AS DATE) AS date FROM orders),
rest AS (SELECT date, dayofweek(date) IN (0, 6) OR (month(date), day(date)) IN ((1, 1), (4, 30), (5, 1), (9, 2)) AS off FROM days),
calendar AS (SELECT date, off, min(CASE WHEN NOT off THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS work_date FROM rest)"""

WEEKDAY = "(['Chủ nhật', 'Thứ hai', 'Thứ ba', 'Thứ tư', 'Thứ năm', 'Thứ sáu', 'Thứ bảy'])[dayofweek({}) + 1]"

FEES = """claims AS (SELECT o_orderkey AS claim_id, o_orderkey % 3 AS kind, CAST(o_totalprice AS DECIMAL(20,2)) * 10000 AS v, o_orderkey % 4 = 0 AS half FROM orders),
priced AS (SELECT *, CASE kind
  WHEN 0 THEN CASE WHEN v <= 6000000 THEN 300000 WHEN v <= 400000000 THEN greatest(v * 0.05, 300000) WHEN v <= 800000000 THEN 20000000 + (v - 400000000) * 0.04
    WHEN v <= 2000000000 THEN 36000000 + (v - 800000000) * 0.03 WHEN v <= 4000000000 THEN 72000000 + (v - 2000000000) * 0.02 ELSE 112000000 + (v - 4000000000) * 0.001 END
  WHEN 1 THEN CASE WHEN v <= 60000000 THEN 3000000 WHEN v <= 400000000 THEN greatest(v * 0.05, 3000000) END
  ELSE CASE WHEN v <= 6000000 THEN 300000 WHEN v <= 400000000 THEN greatest(v * 0.03, 300000) WHEN v <= 2000000000 THEN 12000000 + (v - 400000000) * 0.02 END END AS fee0 FROM claims),
charged AS (SELECT claim_id, CAST(CASE WHEN half THEN fee0 * 0.5 ELSE fee0 END AS DOUBLE) AS fee FROM priced)"""

ORACLES = {
    "bad_names": f"WITH {TITLES}, {REASONS} SELECT path, folder, stem, suffix, reasons FROM reasons WHERE reasons <> ''",
    "clean_names": f"WITH {CLEAN} SELECT path, name, target FROM targets WHERE target <> name",
    "rename_plan": f"WITH {PARTS} SELECT path, folder, old_name, new_name, new_path, custom, status FROM plan",
    "rename_totals": f"""WITH {PARTS} SELECT (SELECT count(*) FROM part_files) AS total_scanned, (SELECT count(*) FROM wanted) AS total_problematic,
count(*) FILTER (status = 'PROPOSED') AS total_proposed, count(*) FILTER (status = 'ERROR') AS total_errors, count(*) FILTER (custom) AS custom_used,
CAST(0 AS BIGINT) AS total_unchanged FROM plan""",
    "files_per_folder": f"WITH {PARTS} SELECT folder, count(*) AS files, count(*) FILTER (custom) AS custom_files FROM plan GROUP BY folder",
    "rename_report": f"WITH {CLEAN} SELECT split_part(path, '/', 1) AS folder, name AS old_name, '[PROPOSED] ' || path AS head FROM targets WHERE target <> name",
    "preview_classes": f"""WITH {TITLES}, c AS (SELECT folder, CASE lower(suffix) WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' WHEN '.png' THEN 'image' ELSE 'external' END AS preview FROM named)
SELECT folder, preview, preview AS again, count(*) AS files FROM c GROUP BY folder, preview""",
    "admitted_files": f"""WITH {TITLES} SELECT doc_id, name, CASE WHEN lower(suffix) NOT IN ('.docx', '.pdf', '.txt') THEN 'extension' WHEN n_chars > 3000 THEN 'size' END AS reject_reason FROM named""",
    "distinct_uploads": f"""SELECT split_part(text, {NL}, 1) AS name, n_chars AS length, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS path, count(*) AS copies
FROM documents GROUP BY 1, 2""",
    "unlabelled_documents": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "markdown_documents": _pages(
        f"'# Kết quả OCR - hs-' || conv_id || {NL} || {NL} || '> Ngày tạo: 01/01/2026 00:00:00' || {NL} || {NL} || '---' || {NL} || {NL}",
        f"'## Trang ' || (turn + 1) || {NL} || {NL} || CASE WHEN {BODY} = '' THEN '{rules.MARKDOWN_EMPTY_PAGE}' ELSE {BODY} END || repeat({NL}, 3)",
        f"'---' || {NL} || {NL} || '*Tổng số trang: ' || count(*) || '*' || {NL}", "md"),
    "text_documents": _pages(
        f"'KET QUA OCR - hs-' || conv_id || {NL} || 'Ngay tao: 01/01/2026 00:00:00' || {NL} || repeat('=', 60) || {NL} || {NL}",
        f"'=== Trang ' || (turn + 1) || ' ===' || {NL} || {NL} || CASE WHEN {BODY} = '' THEN '{rules.TEXT_EMPTY_PAGE}' ELSE {BODY} END || {NL} || {NL} || repeat('-', 40) || {NL} || {NL}",
        f"'Tong so trang: ' || count(*) || {NL}", "txt"),
    "document_results": f"WITH {RESULTS} SELECT * FROM results",
    "batch_totals": f"""WITH {RESULTS} SELECT count(*) AS total_files, count(*) FILTER (success) AS processed, count(*) FILTER (NOT success) AS errors,
CAST(sum(total_pages) AS BIGINT) AS total_pages FROM results""",
    "loan_segments": f"""WITH {LOANS} SELECT loan_id, seg_start, seg_end, days, CAST(balance AS DOUBLE) AS balance, CAST(amount AS DOUBLE) AS amount,
CAST(year_rate AS DOUBLE) AS year_rate, overdue, floor(num::DOUBLE / 100 / basis * 100 + 0.5) / 100 AS interest FROM valued""",
    "loan_details": f"""WITH {LOANS}, marked AS (SELECT *, CASE WHEN (amount, year_rate, overdue, basis) =
   lag((amount, year_rate, overdue, basis)) OVER (PARTITION BY loan_id ORDER BY seg_start) THEN 0 ELSE 1 END AS changed FROM valued),
isles AS (SELECT *, sum(changed) OVER (PARTITION BY loan_id ORDER BY seg_start ROWS UNBOUNDED PRECEDING) AS isle FROM marked)
SELECT loan_id, min(seg_start) AS seg_start, max(seg_end) AS seg_end, CAST(sum(days) AS BIGINT) AS days, CAST(any_value(amount) AS DOUBLE) AS amount,
CAST(any_value(year_rate) AS DOUBLE) AS year_rate, floor(sum(num)::DOUBLE / 100 / any_value(basis) * 100 + 0.5) / 100 AS interest FROM isles GROUP BY loan_id, isle""",
    "loan_matrix": f"""WITH {LOANS}, {MATRIX} SELECT loan_id, {', '.join(_ROUND.format(c) for c in ('principal_left', 'in_term_left', 'overdue_left'))},
0.0::DOUBLE AS late_left, floor((principal_left + in_term_left + overdue_left) * 100 + 0.5) / 100 AS total_left FROM owed""",
    "loan_waterfall": f"""WITH {LOANS}, flow AS (SELECT v.loan_id, v.seg_end,
   (sum(CASE WHEN basis = 360 THEN num ELSE 0 END) OVER w)::DOUBLE / 100 / 360 + (sum(CASE WHEN basis = 365 THEN num ELSE 0 END) OVER w)::DOUBLE / 100 / 365 AS accrued,
   (sum(coalesce(p.interest, 0)) OVER w)::DOUBLE AS paid
   FROM valued v LEFT JOIN per_day p ON p.loan_id = v.loan_id AND p.date = v.seg_end WINDOW w AS (PARTITION BY v.loan_id ORDER BY v.seg_end ROWS UNBOUNDED PRECEDING))
SELECT loan_id, seg_end, {_ROUND.format('accrued')}, {_ROUND.format('paid')}, floor((accrued - paid) * 100 + 0.5) / 100 AS unpaid FROM flow""",
    "loan_input_checks": f"""WITH {LOANS} SELECT p.loan_id, 'payment' AS kind, count(*) AS n FROM all_payments p LEFT JOIN as_agreed t USING (loan_id)
WHERE t.loan_id IS NULL OR p.date < start_date OR p.date > start_date + CAST(loan_id % 40 * 30 + 100 AS INTEGER) GROUP BY p.loan_id
UNION ALL SELECT loan_id, 'rate', CAST(1 AS BIGINT) FROM loans WHERE loan_id % 2 = 0 AND loan_id % 3 >= 1""",
    "court_fees": f"""WITH {FEES} SELECT claim_id, fee, replace(format('{{:,}}', CAST(round_even(fee, 0) AS BIGINT)), ',', '.') AS fee_text,
CASE WHEN fee IS NULL THEN 'no bracket' END AS reason FROM charged""",
    "detention_terms": """WITH t AS (SELECT o_orderkey AS term_id, CAST(o_orderdate AS DATE) AS s, o_orderkey % 5 AS m, o_orderkey % 31 AS d, o_custkey % 9 AS h FROM orders),
j AS (SELECT *, CASE WHEN m = 0 AND d = 0 THEN 'no term' WHEN m * 30 + d - h <= 0 THEN 'nothing left' END AS error, m * 30 + d - h AS n FROM t),
v AS (SELECT *, CASE WHEN error IS NULL THEN n END AS total_days, CASE WHEN error IS NULL THEN s + CAST(n - 1 AS INTEGER) END AS end_date,
   CASE WHEN error IS NULL THEN greatest(date_diff('day', s, DATE '1999-06-01'), 0) END AS elapsed FROM j),
w AS (SELECT *, CASE WHEN error IS NULL THEN greatest(date_diff('day', DATE '1999-06-01', end_date) + 1, 0) END AS remaining FROM v)
SELECT term_id, error, end_date, total_days, total_days // 30 AS left_months, total_days % 30 AS left_days, elapsed, remaining,
CAST(CASE WHEN error IS NULL THEN least(100, round(elapsed / total_days * 100)) END AS BIGINT) AS percent,
CASE WHEN error IS NULL THEN CASE WHEN remaining <= 0 THEN 'expired' WHEN remaining <= 3 THEN 'danger' WHEN remaining <= 10 THEN 'caution' ELSE 'safe' END END AS level,
CASE WHEN error IS NULL THEN CASE WHEN elapsed >= total_days THEN 'red' WHEN elapsed >= total_days * 0.75 THEN 'yellow' ELSE 'normal' END END AS color FROM w""",
    "procedural_terms": f"""WITH {CALENDAR}, t AS (SELECT o_orderkey AS term_id,
   CAST(CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 2 * 12 + o_orderkey % 13 AS INTEGER)) AS DATE) + CAST(o_orderkey % 29 AS INTEGER) AS DATE) AS calendar_end FROM orders)
SELECT term_id, calendar_end, work_date AS end_date, work_date <> calendar_end AS moved, CASE WHEN work_date IS NULL THEN 'no end date' END AS error, {WEEKDAY.format('work_date')} AS weekday
FROM t LEFT JOIN calendar ON date = calendar_end""",
    "rest_day_orders": f"WITH {CALENDAR} SELECT o_orderkey, date FROM orders JOIN calendar ON date = CAST(o_orderdate AS DATE) WHERE off",
    "custody_terms": """WITH t AS (SELECT event_id AS term_id, date_trunc('second', ts) + to_hours(CAST(event_id % 3 * 120 + 72 AS INTEGER)) AS e FROM events),
l AS (SELECT *, greatest(date_diff('second', TIMESTAMP '2024-01-15', e) / 3600.0::DOUBLE, 0) AS h FROM t)
SELECT term_id, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_time, round(h, 4) AS hours_left,
CASE WHEN h <= 6 THEN 'red' WHEN h <= 24 THEN 'yellow' ELSE 'normal' END AS color FROM l""",
    "order_ages": f"""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '2001-12-31' AS e FROM orders),
m AS (SELECT *, (year(e) - year(d)) * 12 + month(e) - month(d) AS m0 FROM t),
n AS (SELECT *, m0 - CASE WHEN CAST(d + to_months(CAST(m0 AS INTEGER)) AS DATE) > e THEN 1 ELSE 0 END AS k FROM m)
SELECT o_orderkey, k // 12 AS years, k % 12 AS months, date_diff('day', CAST(d + to_months(CAST(k AS INTEGER)) AS DATE), e) AS days,
strftime(d, '%d/%m/%Y') AS shown, {WEEKDAY.format('d')} AS weekday, d AS parsed FROM n""",
    "case_parties": """WITH c AS (SELECT o_orderkey AS case_id, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT case_id, 'plaintiff' AS role, CAST(1 AS BIGINT) AS party_no, c_name AS party FROM c UNION ALL SELECT case_id, 'defendant', 1, c_mktsegment FROM c
UNION ALL SELECT case_id, 'defendant', 2, 'clerk of ' || c_name FROM c""",
    "case_statistics": """SELECT o_orderpriority AS case_type, count(*) AS cases, count(*) FILTER (o_orderstatus = 'F') AS closed_cases,
CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS total_value, min(CAST(o_orderdate AS DATE)) AS first_filed, max(CAST(o_orderdate AS DATE)) AS last_filed
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
}
