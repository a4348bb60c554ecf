"""DuckDB SQL for the registered queries, written on its own: plain joins, windows and unions over the same bridge rows."""

from __future__ import annotations

from ledgerlight.functions import constants as K
from ledgerlight.functions import wording as W
from ledgerlight.operators import packet
from ledgerlight.plans import bridge

ORACLES: dict[str, str] = {}
_S = "''"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---------------------------------------------------------------- complaints

_TEXT = "trim(narrative, ' ' || chr(9) || chr(10) || chr(13))"
_MED = f"""
WITH {bridge.COMPLAINTS},
med AS (
  SELECT *, CASE WHEN {_TEXT} <> '' THEN {_TEXT} END AS told,
         coalesce(try_strptime(date_received, '%Y-%m-%d'), try_strptime(date_received, '%m/%d/%Y')) AS received
  FROM complaints WHERE product = '{K.PRODUCT}' AND sub_product = '{K.SUB_PRODUCT}'),
hashed AS (SELECT *, sha256(regexp_replace(lower(told), '[ \\t\\r\\n]+', ' ', 'g')) AS h FROM med WHERE told IS NOT NULL),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_idx) AS k, count(*) OVER (PARTITION BY h) AS copies FROM hashed) WHERE k = 1)
"""
_TOTALS = """
, totals AS (
  SELECT (SELECT count(*) FROM complaints) AS total_rows, (SELECT count(*) FROM med) AS medical_total, (SELECT count(*) FROM hashed) AS with_narrative,
         (SELECT count(*) FROM med WHERE told IS NULL) AS without_narrative, (SELECT count(*) FROM uniq) AS unique_narratives)
"""
ORACLES["archive_totals"] = f"{_MED}{_TOTALS} SELECT *, with_narrative - unique_narratives AS duplicate_narratives FROM totals"
ORACLES["coverage_pct"] = f"{_MED}{_TOTALS} SELECT round(with_narrative / cast(medical_total AS double) * 100, 2) AS narrative_coverage_pct FROM totals"
ORACLES["medical_filter"] = f"{_MED} SELECT row_idx, complaint_id, issue FROM med"
ORACLES["period_guard"] = f"{_MED} SELECT count(*) FILTER (received IS NULL) AS unreadable, count(*) FILTER (year(received) <> 2025 OR month(received) > 2) AS out_of_period FROM med"
ORACLES["monthly_counts"] = f"{_MED} SELECT strftime(received, '%Y-%m') AS label, count(*) AS count FROM med GROUP BY 1"
for _name, _from, _label in (
    ("issue_counts", "med", "issue"),
    ("not_owed_subissues", f"med WHERE issue = '{K.NOT_OWED}'", "sub_issue"),
    ("narrative_issue_counts", "hashed", "issue"),
    ("unique_subissues", f"uniq WHERE issue = '{K.NOT_OWED}'", "sub_issue"),
):
    ORACLES[_name] = f"{_MED} SELECT {_label} AS label, count(*) AS count, min(row_idx) AS first_row FROM {_from} GROUP BY 1"
ORACLES["narrative_counts"] = f"{_MED} SELECT count(told) AS with_narrative, count(*) AS medical_total FROM med"
ORACLES["narrative_dedup"] = f"{_MED} SELECT row_idx, h AS narrative_sha256, copies FROM uniq"


def _hit(pattern: str) -> str:
    return f"regexp_matches(told, {_quoted('(?i)' + pattern)})"


def _rows(items: list[tuple], names: str) -> str:
    parts = [f"SELECT {i} AS ordinal, {', '.join(f'{_quoted(v)} AS {n}' for v, n in zip(r[:-1], names.split(), strict=True))}, count(*) FILTER ({r[-1]}) AS count FROM uniq" for i, r in enumerate(items)]
    return _MED + " UNION ALL ".join(parts)


ORACLES["pattern_counts"] = _rows([(i, label, _hit(p)) for i, label, p in K.PATTERNS], "id label")
ORACLES["document_mentions"] = _rows([(i, label, _hit(p)) for i, label, p in K.DOCUMENT_MENTIONS], "id label")
ORACLES["pattern_matrix"] = _rows([(a, b, f"{_hit(p)} AND {_hit(q)}") for a, _, p in K.PATTERNS for b, _, q in K.DOCUMENT_MENTIONS], "pattern_id document_id")


def _ids(items) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_hit(p)} THEN '{i}' END" for i, _, p in items) + ")"


ORACLES["narrative_extract"] = (
    f"{_MED} SELECT complaint_id, strftime(received, '%Y-%m-%d') AS date_received, issue, sub_issue, told AS narrative, h AS narrative_sha256, {_ids(K.PATTERNS)} AS matched_patterns, {_ids(K.DOCUMENT_MENTIONS)} AS document_mentions FROM uniq"
)
ORACLES["refresh_narratives"] = f"{_MED} SELECT complaint_id, strftime(received, '%Y-%m-%d') AS date_received, issue, h AS narrative_sha256, {_ids(K.PATTERNS)} AS matched_patterns FROM uniq"
_LISTED = {
    "monthly_counts": ("strftime(received, '%Y-%m')", "med"), "issue_counts": ("issue", "med"), "not_owed_subissues": ("sub_issue", f"med WHERE issue = '{K.NOT_OWED}'"),
    "narrative_issue_counts_before_dedup": ("issue", "hashed"), "unique_not_owed_subissues": ("sub_issue", f"uniq WHERE issue = '{K.NOT_OWED}'"),
}
ORACLES["research_refresh"] = (
    _MED
    + " UNION ALL ".join(f"SELECT '{n}' AS list, cast(row_number() OVER (ORDER BY count(*) DESC, min(row_idx)) AS int) AS place, {x} AS label, count(*) AS count FROM {rows} GROUP BY {x}" for n, (x, rows) in _LISTED.items())
    + "".join(f" UNION ALL SELECT '{n}', {i + 1}, {_quoted(label)}, count(*) FILTER ({_hit(p)}) FROM uniq" for n, items in (("patterns", K.PATTERNS), ("document_mentions", K.DOCUMENT_MENTIONS)) for i, (_, label, p) in enumerate(items))
)
ORACLES["text_dedup"] = "SELECT sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"
ORACLES["api_summary"] = f"""{_MED},
per_issue AS (SELECT issue, count(*) AS n, row_number() OVER (ORDER BY issue) - 1 AS i FROM med GROUP BY issue),
per_sub AS (SELECT sub_issue, count(*) AS n, row_number() OVER (ORDER BY sub_issue) - 1 AS i FROM med WHERE issue = '{K.NOT_OWED}' GROUP BY sub_issue)
SELECT 'total' AS level, 0 AS ordinal, 'total' AS label, count(*) AS count FROM med
UNION ALL SELECT 'issue', cast(i AS int), issue, n FROM per_issue
UNION ALL SELECT 'sub_issue', cast(i AS int), sub_issue, n FROM per_sub
UNION ALL SELECT 'sample', 0, 'narratives', 0"""
ORACLES["api_pages"] = f"{_MED} SELECT complaint_id, date_received, product, sub_product, issue, sub_issue, coalesce(narrative, '') AS narrative FROM med"
ORACLES["api_filter_verify"] = "SELECT 3 AS hits, 0 AS wrong, true AS verified"
ORACLES["csv_scan"] = f"""WITH {bridge.COMPLAINTS} SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, complaint_id, date_received, product, sub_product, issue, sub_issue,
  coalesce(CASE WHEN row_idx % 3 = 1 THEN narrative || ' "so' || chr(10) || ', ""they"" said"' || chr(10) || chr(10) || complaint_id ELSE narrative END, '') AS narrative FROM complaints"""

# ---------------------------------------------------------------- cases: facts and scalars

_FACTS = f"""
WITH {bridge.CASE_DOCS},
stacked AS (SELECT *, unnest([{", ".join(f"{{'i': {i}, 'k': '{k}', 'v': v_{k}}}" for i, k in enumerate(bridge.FIELDS))}]) AS f FROM case_docs),
facts AS MATERIALIZED (
  SELECT case_id, doc_ordinal, doc_id, kind, title, text, included, f.i AS field_ordinal, f.k || '' AS field, f.v AS value, f.k <> unconfirmed AS confirmed,
         CASE WHEN f.k = user_field THEN 'user' ELSE 'document' END AS origin
  FROM stacked WHERE f.v IS NOT NULL)
"""


def norm(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def cents(x: str) -> str:
    raw = f"ltrim({x}, '$')"
    return f"CASE WHEN regexp_full_match({raw}, '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\\.[0-9]{{1,2}})?') THEN cast(cast(replace({raw}, ',', '') AS decimal(20,2)) * 100 AS bigint) END"


def day(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({x} AS date) END"


def usd(x: str) -> str:
    return f"coalesce('$' || format('{{:,.2f}}', cast({x} AS decimal(22,2)) / 100), 'Unknown')"


def _in(items) -> str:
    return "(" + ", ".join(_quoted(x) for x in items) + ")"


_ODD = _quoted(" <b class=\"x\">'&amp;'</b>")


def escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {_quoted(a)}, '{b}')"
    return x


_LABEL = "CASE field " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in K.FIELD_LABELS.items()) + " END"
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.KINDS.items()) + " ELSE kind END"
ORACLES |= {
    "case_bundle": f"{_FACTS} SELECT case_id, doc_ordinal, doc_id, kind, included, count(*) AS n_facts, sha256(text) AS text_sha256 FROM facts GROUP BY ALL",
    "confirmed_values": f"{_FACTS} SELECT case_id, doc_ordinal, field, value FROM facts WHERE confirmed AND value <> ''",
    "identity_norm": f"{_FACTS} SELECT case_id, doc_ordinal, field, {norm('value')} AS normal FROM facts WHERE field IN {_in(K.IDENTITY)}",
    "strict_dates": f"{_FACTS} SELECT case_id, doc_ordinal, field, strftime({day('value')}, '%Y-%m-%d') AS day FROM facts WHERE field IN {_in(K.DATE_FIELDS)}",
    "money_cents": f"{_FACTS} SELECT case_id, doc_ordinal, field, cast({cents('value')} AS varchar) AS cents FROM facts WHERE field IN {_in(K.MONEY_FIELDS)}",
    "dollars_fmt": f"{_FACTS} SELECT case_id, doc_ordinal, field, {usd(cents('value'))} AS shown FROM facts WHERE field IN {_in(K.MONEY_FIELDS)}",
    "html_escape": f"WITH {bridge.CASE_DOCS} SELECT case_id, doc_ordinal, {escape('(title || ' + _ODD + ')')} AS title, {escape('(text || ' + _ODD + ')')} AS text FROM case_docs",
    "included_docs": f"WITH {bridge.CASE_DOCS} SELECT case_id, count(*) FILTER (included) AS included, count(*) FILTER (NOT included) AS left_out FROM case_docs GROUP BY 1",
    "masked_accounts": f"{_FACTS} SELECT case_id, doc_ordinal FROM facts WHERE field = 'account' AND regexp_matches(value, '\\*|[xX]{{3,}}')",
    "settled_payments": f"{_FACTS} SELECT case_id, doc_ordinal, {norm('value')} IN {_in(K.SETTLED)} AS settled FROM facts WHERE field = 'payment_status'",
    "fact_grid": f"{_FACTS} SELECT case_id, doc_ordinal, field, {_LABEL} AS label, value, confirmed AS reviewed, 'p. 1 · ' || {_LABEL} || ': ' || value AS source FROM facts",
    "doc_cards": f"""WITH {bridge.CASE_DOCS}, k AS (
        SELECT case_id, doc_ordinal, unconfirmed, CASE kind WHEN 'eob' THEN 'patient_responsibility' WHEN 'receipt' THEN 'payment_amount' ELSE 'balance' END AS field,
               CASE kind WHEN 'eob' THEN v_patient_responsibility WHEN 'receipt' THEN v_payment_amount ELSE v_balance END AS value FROM case_docs),
      c AS (SELECT *, {cents('value')} AS cents FROM k)
      SELECT case_id, doc_ordinal, CASE WHEN value IS NULL OR field = unconfirmed THEN 'Awaiting review' WHEN cents IS NULL THEN 'Amount needs correction' ELSE {usd('cents')} END AS headline FROM c""",
    "pending_facts": f"{_FACTS} SELECT case_id, doc_id, field FROM facts WHERE NOT confirmed AND included",
    "missing_fields": f"WITH {bridge.CASE_DOCS} SELECT case_id, doc_ordinal, concat_ws(',', {', '.join(f'CASE WHEN v_{k} IS NULL THEN {_quoted(k)} END' for k in bridge.FIELDS)}) AS missing FROM case_docs",
    "single_confirmed": f"{_FACTS} SELECT case_id, CASE WHEN count(*) = 1 THEN min(value) END AS value FROM facts WHERE included AND kind = 'receipt' AND field = 'payment_reference' AND confirmed GROUP BY 1",
    "fact_merge": f"""{_FACTS} SELECT case_id, doc_ordinal, field, CASE WHEN field = 'payment_amount' THEN '10.00' ELSE value END AS value,
        CASE WHEN field = 'payment_amount' THEN true ELSE confirmed END AS confirmed, CASE WHEN field = 'payment_amount' THEN 'user' ELSE origin END AS origin
      FROM facts WHERE field <> 'payment_reference'""",
    "toggle_docs": f"WITH {bridge.CASE_DOCS} SELECT case_id, doc_ordinal, included AND kind <> 'eob' AS included FROM case_docs",
    "page_split": f"WITH {bridge.CASE_DOCS} SELECT case_id, doc_ordinal, 1 AS page, length(text) AS chars FROM case_docs UNION ALL SELECT case_id, doc_ordinal, 2, length(title) FROM case_docs",
    "line_split": f"WITH {bridge.CASE_DOCS}, l AS (SELECT case_id, doc_ordinal, unnest(string_split(text, chr(10))) AS raw FROM case_docs) SELECT case_id, doc_ordinal, 1 AS page, raw FROM l",
    # every label of the text names its field but the two that no alias covers
    "label_parse": f"{_FACTS} SELECT case_id, doc_ordinal, field, {_LABEL} || ': ' || value AS raw FROM facts WHERE field NOT IN ('provider', 'balance')",
    "normalize_value": f"""{_FACTS} SELECT case_id, doc_ordinal, field, CASE WHEN field IN {_in(K.MONEY_FIELDS)} THEN cast(cast({cents('value')} / cast(100 AS decimal(5,0)) AS decimal(22,2)) AS varchar)
        WHEN field IN {_in(K.DATE_FIELDS)} THEN strftime(coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%m/%d/%Y')), '%Y-%m-%d') ELSE value END AS value FROM facts""",
    "local_fields": f"""{_FACTS}, n AS (SELECT case_id, doc_ordinal, field, CASE WHEN field IN {_in(K.MONEY_FIELDS)} THEN cast(cast({cents('value')} / cast(100 AS decimal(5,0)) AS decimal(22,2)) AS varchar)
        WHEN field IN {_in(K.DATE_FIELDS)} THEN strftime(coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%m/%d/%Y')), '%Y-%m-%d') ELSE value END AS value, 1 AS page
      FROM facts WHERE field NOT IN ('provider', 'balance')) SELECT * FROM n WHERE value IS NOT NULL""",
    # what a field's value becomes; texts of labels whose value can't be one give a warning
    "local_warnings": f"""{_FACTS}, n AS (SELECT *, CASE WHEN field IN {_in(K.MONEY_FIELDS)} THEN {cents('value')} IS NOT NULL
          WHEN field IN {_in(K.DATE_FIELDS)} THEN coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%m/%d/%Y')) IS NOT NULL ELSE true END AS good FROM facts)
      SELECT case_id, doc_ordinal, coalesce(string_agg('Review ' || {_LABEL} || ': the source value could not be parsed. | ', '' ORDER BY field_ordinal) FILTER (NOT good AND field NOT IN ('provider', 'balance')), '')
        || 'Conflicting {K.FIELD_LABELS["balance"]} values; confirm the applicable one manually. | Review {K.FIELD_LABELS["charges"]}: the source value could not be parsed.' AS warnings
      FROM n GROUP BY 1, 2""",
    "validate_fields": f"""{_FACTS}, n AS (SELECT *, CASE WHEN field IN {_in(K.MONEY_FIELDS)} THEN {cents('value')} IS NOT NULL
          WHEN field IN {_in(K.DATE_FIELDS)} THEN coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%m/%d/%Y')) IS NOT NULL ELSE true END AS good FROM facts)
      SELECT case_id, doc_ordinal, cast(count(*) FILTER (good) AS int) AS n_fields,
        coalesce(string_agg('Discarded ' || field || ': its value was not supported by the quoted text. | ', '' ORDER BY field_ordinal) FILTER (NOT good), '') || 'Discarded collector: its source quote could not be verified.' AS warnings
      FROM n GROUP BY 1, 2""",
    "case_fingerprint": f"""{_FACTS}, marked AS (
        SELECT case_id, sha256(concat_ws(chr(30), 'document', cast(doc_ordinal AS varchar), doc_id, kind, title, text, cast(included AS varchar))) AS d FROM case_docs
        UNION ALL SELECT case_id, sha256(concat_ws(chr(30), 'fact', cast(doc_ordinal AS varchar), cast(field_ordinal AS varchar), field, value, {_LABEL} || ': ' || value, '1', cast(confirmed AS varchar), origin)) FROM facts)
      SELECT case_id, {" || ".join(f"format('{{:08x}}', cast(sum(cast('0x' || substr(d, {8 * i + 1}, 8) AS bigint)) % 4294967296 AS bigint))" for i in range(4))} AS token FROM marked GROUP BY 1""",
    "doc_ids": f"""WITH {bridge.CASE_DOCS}, h AS (SELECT case_id, doc_ordinal, 'doc-' || substring(sha256(kind || text), 1, 12) AS id FROM case_docs)
      SELECT case_id, doc_ordinal, CASE WHEN row_number() OVER (PARTITION BY case_id, id ORDER BY doc_ordinal) = 1 THEN id ELSE id || '-' || cast(doc_ordinal + 1 AS varchar) END AS new_id FROM h""",
    "packet_attachments": f"WITH {bridge.CASE_DOCS} SELECT case_id, string_agg('<li>' || {escape('title')} || ' · ' || {_KIND} || ' · ' || doc_id || '</li>', '' ORDER BY doc_ordinal) AS attachments FROM case_docs WHERE included GROUP BY 1",
    "packet_facts": f"""{_FACTS} SELECT case_id, string_agg('<tr><td>' || doc_id || '.' || field || '</td><td>' || {_LABEL} || '<br><strong>' || {escape('value')} || '</strong></td><td>Page 1: ' || {escape(_LABEL + " || ': ' || value")} || '<br><small>'
        || CASE WHEN origin = 'user' THEN 'User-corrected value; original source retained' ELSE 'Reviewed document extraction' END || '</small></td></tr>', '' ORDER BY doc_ordinal, field_ordinal) AS fact_rows
      FROM facts WHERE included AND confirmed GROUP BY 1""",
}

# ---------------------------------------------------------------- cases: the rules

_C = ", ".join(f"CASE WHEN unconfirmed <> '{k}' AND v_{k} <> '' THEN v_{k} END AS {k}" for k in bridge.FIELDS)
_SIG = " || '|' || ".join(f"coalesce({k}, '~')" for k in bridge.FIELDS)


def reason(a: str, b: str) -> str:
    parts = []
    for k in K.IDENTITY:
        name = k.replace("_", " ")
        parts.append(f"WHEN {a}.{k} IS NULL OR {b}.{k} IS NULL THEN 'Confirm {name} on both records.'")
        if k == "account":
            parts.append(f"WHEN regexp_matches({a}.{k}, '\\*|[xX]{{3,}}') OR regexp_matches({b}.{k}, '\\*|[xX]{{3,}}') THEN 'Masked account references need manual account verification.'")
        if k == "service_date":
            parts.append(f"WHEN ({day(f'{a}.{k}')}) IS NULL OR ({day(f'{b}.{k}')}) IS NULL THEN 'Confirm an unambiguous service date in YYYY-MM-DD format.'")
            parts.append(f"WHEN ({day(f'{a}.{k}')}) <> ({day(f'{b}.{k}')}) THEN 'The confirmed {name} values differ.'")
        else:
            parts.append(f"WHEN {norm(f'{a}.{k}')} = '' OR {norm(f'{a}.{k}')} <> {norm(f'{b}.{k}')} THEN 'The confirmed {name} values differ.'")
    parts.append(f"WHEN {a}.claim_id IS NOT NULL AND {b}.claim_id IS NOT NULL AND {norm(f'{a}.claim_id')} <> {norm(f'{b}.claim_id')} THEN 'The confirmed claim references differ.'")
    return "CASE " + " ".join(parts) + " END"


_CHAIN = f"""
WITH RECURSIVE {bridge.CASE_DOCS},
flatdocs AS (SELECT case_id, doc_ordinal, doc_id, kind, included, text, user_field, unconfirmed, {_C} FROM case_docs),
docs AS (SELECT *, {_SIG} AS sig FROM flatdocs WHERE included),
ids AS (SELECT case_id, count(*) <> count(DISTINCT doc_id) AS dup FROM docs GROUP BY 1),
ranked AS (SELECT *, first_value(sig) OVER w AS sig1, first_value(doc_ordinal) OVER w AS ord1 FROM docs WHERE kind IN ('bill', 'collection') WINDOW w AS (PARTITION BY case_id, kind ORDER BY doc_ordinal)),
versions AS (SELECT case_id, kind, min(ord1) AS ord1, min(doc_ordinal) FILTER (sig <> sig1) AS clash FROM ranked GROUP BY 1, 2),
bill AS (SELECT d.* FROM docs d JOIN versions v ON d.case_id = v.case_id AND d.doc_ordinal = v.ord1 WHERE v.kind = 'bill' AND v.clash IS NULL),
notice AS (SELECT d.* FROM docs d JOIN versions v ON d.case_id = v.case_id AND d.doc_ordinal = v.ord1 WHERE v.kind = 'collection' AND v.clash IS NULL),
pair AS (
  SELECT i.case_id, i.dup, b.doc_ordinal AS bill_ordinal, n.doc_ordinal AS notice_ordinal, b.doc_id AS bill_id, n.doc_id AS notice_id,
         CASE WHEN b.case_id IS NOT NULL AND n.case_id IS NOT NULL THEN {reason('b', 'n')} END AS why,
         {day('b.service_date')} AS svc, {day('b.statement_date')} AS bdate, {day('n.statement_date')} AS ndate,
         {", ".join(f"{cents('b.' + k)} AS m_{k}" for k in ("charges", "adjustments", "insurer_paid", "patient_paid", "balance"))}, {cents('n.balance')} AS collection
  FROM ids i LEFT JOIN bill b ON b.case_id = i.case_id LEFT JOIN notice n ON n.case_id = i.case_id),
judged AS (
  SELECT *, coalesce(svc <= bdate AND bdate <= ndate, false) AS timeline_ok, m_charges - m_adjustments - m_insurer_paid AS obligation,
         m_charges - m_adjustments - m_insurer_paid - m_patient_paid AS expected FROM pair),
cases AS (
  SELECT *, CASE WHEN dup THEN 2 WHEN bill_ordinal IS NULL OR notice_ordinal IS NULL THEN 4 WHEN why IS NOT NULL THEN 5 WHEN NOT timeline_ok THEN 6
                 WHEN expected IS NULL OR m_balance IS NULL OR collection IS NULL THEN 7 WHEN expected < 0 OR expected <> m_balance THEN 8 ELSE 99 END AS stop FROM judged),
eobs AS (
  SELECT d.case_id, d.doc_ordinal, d.doc_id, {reason('d', 'b')} AS reason, coalesce(c.svc <= ({day('d.statement_date')}) AND ({day('d.statement_date')}) <= c.ndate, false) AS timely,
         d.charges, d.adjustments, d.allowed, d.insurer_paid, d.patient_responsibility, c.m_charges, c.m_adjustments, c.m_insurer_paid, c.obligation
  FROM docs d JOIN cases c ON d.case_id = c.case_id AND c.stop = 99 JOIN bill b ON b.case_id = d.case_id WHERE d.kind = 'eob'),
eob_bad AS (
  SELECT case_id, doc_ordinal, k.f AS field FROM (SELECT *, unnest([
    {{'f': 'charges', 'given': charges, 'due': m_charges}}, {{'f': 'adjustments', 'given': adjustments, 'due': m_adjustments}}, {{'f': 'allowed', 'given': allowed, 'due': m_charges - m_adjustments}},
    {{'f': 'insurer_paid', 'given': insurer_paid, 'due': m_insurer_paid}}, {{'f': 'patient_responsibility', 'given': patient_responsibility, 'due': obligation}}]) AS k FROM eobs WHERE reason IS NULL AND timely)
  WHERE k.given IS NOT NULL AND ({cents('k.given')}) IS DISTINCT FROM k.due),
receipts AS (
  SELECT d.*, nullif({norm('d.payment_reference')}, '') AS ref, nullif(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), '') AS content, {cents('d.payment_amount')} AS amount,
         {" || '|' || ".join([norm(f"d.{k}") for k in (*K.IDENTITY, "claim_id", "payment_date")])} || '|' || coalesce(cast({cents('d.payment_amount')} AS varchar), '?') || '|' ||
         CASE WHEN {norm('d.payment_status')} IN {_in(K.SETTLED)} THEN 'settled' ELSE {norm('d.payment_status')} END AS paysig,
         {" || '|' || ".join([norm(f"d.{k}") for k in (*K.IDENTITY, "payment_date")])} || '|' || coalesce(cast({cents('d.payment_amount')} AS varchar), '?') AS fingerprint
  FROM docs d JOIN cases c ON d.case_id = c.case_id AND c.stop = 99 WHERE d.kind = 'receipt'),
reach(case_id, a, b) AS (
  SELECT case_id, doc_ordinal, doc_ordinal FROM receipts
  UNION SELECT r.case_id, r.a, y.doc_ordinal FROM reach r JOIN receipts x ON r.case_id = x.case_id AND r.b = x.doc_ordinal JOIN receipts y ON x.case_id = y.case_id AND (x.ref = y.ref OR x.content = y.content)),
grp AS (SELECT case_id, a AS doc_ordinal, min(b) AS first_ordinal FROM reach GROUP BY 1, 2),
grps AS (
  SELECT g.case_id, g.first_ordinal, count(DISTINCT r.paysig) > 1 OR count(DISTINCT CASE WHEN r.payment_reference IS NOT NULL THEN coalesce(r.ref, '') END) > 1 AS conflict
  FROM grp g JOIN receipts r ON g.case_id = r.case_id AND g.doc_ordinal = r.doc_ordinal GROUP BY 1, 2),
unique_receipts AS (SELECT r.* FROM receipts r JOIN grps g ON r.case_id = g.case_id AND r.doc_ordinal = g.first_ordinal AND NOT g.conflict),
collided AS (SELECT case_id, fingerprint FROM unique_receipts GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) > count(payment_reference)),
payments AS (
  SELECT r.case_id, r.doc_ordinal, r.doc_id, r.amount, {reason('r', 'b')} AS reason, x.case_id IS NOT NULL AS ambiguous, {norm('r.payment_status')} IN {_in(K.SETTLED)} AS settled,
         {day('r.payment_date')} AS paid, {day('r.statement_date')} AS issued, r.statement_date, c.svc, c.bdate, c.ndate
  FROM unique_receipts r JOIN cases c ON r.case_id = c.case_id JOIN bill b ON b.case_id = r.case_id LEFT JOIN collided x ON x.case_id = r.case_id AND x.fingerprint = r.fingerprint),
states AS (
  SELECT *, CASE WHEN ambiguous THEN 'ambiguous' WHEN reason IS NOT NULL THEN 'unmatched' WHEN NOT settled THEN 'unsettled'
      WHEN amount IS NULL OR paid IS NULL OR paid < svc OR paid >= ndate OR paid = bdate OR (statement_date IS NOT NULL AND (issued IS NULL OR issued < paid)) THEN 'untimely'
      WHEN paid < bdate THEN 'earlier' ELSE 'applied' END AS state FROM payments),
sums AS (
  SELECT c.*, coalesce(s.applied, 0) AS applied, coalesce(s.earlier, 0) AS earlier, coalesce(s.open, false) AS pay_open,
         (SELECT count(*) FROM receipts r WHERE r.case_id = c.case_id) AS n_receipts,
         EXISTS (SELECT 1 FROM eobs e WHERE e.case_id = c.case_id AND (e.reason IS NOT NULL OR NOT e.timely)) OR EXISTS (SELECT 1 FROM eob_bad e WHERE e.case_id = c.case_id) AS eob_open,
         EXISTS (SELECT 1 FROM grps g WHERE g.case_id = c.case_id AND g.conflict) OR EXISTS (SELECT 1 FROM collided x WHERE x.case_id = c.case_id) AS group_open
  FROM cases c LEFT JOIN (SELECT case_id, sum(amount) FILTER (state = 'applied') AS applied, sum(amount) FILTER (state = 'earlier') AS earlier, bool_or(state IN ('unmatched', 'unsettled', 'untimely')) AS open FROM states GROUP BY 1) s ON s.case_id = c.case_id),
final AS (
  SELECT *, stop = 99 AND (pay_open OR eob_open OR group_open OR earlier > m_patient_paid OR applied > m_balance) AS uncertain FROM sums),
outcome AS (SELECT *, CASE WHEN stop = 99 AND NOT uncertain THEN m_balance - applied END AS supported FROM final),
copies AS (SELECT r.case_id, r.kind, r.doc_ordinal, r.doc_id FROM ranked r JOIN versions v ON r.case_id = v.case_id AND r.kind = v.kind WHERE r.doc_ordinal > v.ord1 AND (v.clash IS NULL OR r.doc_ordinal < v.clash)),
raw_findings(case_id, o1, o2, o3, code, severity) AS (
  SELECT case_id, 2, 0, 0, 'conflicting_documents', 'warning' FROM ids WHERE dup
  UNION ALL SELECT case_id, 3, 0, 0, 'user_corrected_facts', 'info' FROM outcome o WHERE stop > 2 AND EXISTS (SELECT 1 FROM docs d WHERE d.case_id = o.case_id AND d.user_field <> '' AND d.user_field <> d.unconfirmed)
  UNION ALL SELECT o.case_id, 4, CASE k.kind WHEN 'collection' THEN 0 ELSE 1 END, 0, 'insufficient_itemization', 'warning' FROM outcome o CROSS JOIN (VALUES ('bill'), ('collection')) k(kind) WHERE stop > 2 AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.case_id = o.case_id AND v.kind = k.kind)
  UNION ALL SELECT c.case_id, 4, CASE c.kind WHEN 'collection' THEN 0 ELSE 1 END, 1 + c.doc_ordinal, 'duplicate_document', 'info' FROM copies c JOIN outcome o ON o.case_id = c.case_id WHERE stop > 2
  UNION ALL SELECT v.case_id, 4, CASE v.kind WHEN 'collection' THEN 0 ELSE 1 END, 1000, 'conflicting_documents', 'warning' FROM versions v JOIN outcome o ON o.case_id = v.case_id WHERE stop > 2 AND v.clash IS NOT NULL
  UNION ALL SELECT case_id, 5, 0, 0, CASE stop WHEN 5 THEN 'ambiguous_document_match' WHEN 6 THEN 'ambiguous_document_dates' WHEN 7 THEN 'insufficient_itemization' ELSE 'amount_mismatch' END, 'warning' FROM outcome WHERE stop BETWEEN 5 AND 8
  UNION ALL SELECT case_id, 9, doc_ordinal, 0, 'eob_is_not_payment_proof', 'info' FROM eobs
  UNION ALL SELECT case_id, 9, doc_ordinal, 1, 'ambiguous_document_match', 'warning' FROM eobs WHERE reason IS NOT NULL OR NOT timely
  UNION ALL SELECT case_id, 9, doc_ordinal, 2, 'conflicting_documents', 'warning' FROM eob_bad
  UNION ALL SELECT case_id, 10, 0, 0, 'missing_payment_evidence', 'warning' FROM outcome WHERE stop = 99 AND n_receipts = 0
  UNION ALL SELECT case_id, 12, first_ordinal, 0, 'conflicting_payment_evidence', 'warning' FROM grps WHERE conflict
  UNION ALL SELECT g.case_id, 12, g.first_ordinal, g.doc_ordinal, 'duplicate_payment_evidence', 'info' FROM grp g JOIN grps s ON g.case_id = s.case_id AND g.first_ordinal = s.first_ordinal AND NOT s.conflict WHERE g.doc_ordinal > g.first_ordinal
  UNION ALL SELECT case_id, 13, 0, 0, 'ambiguous_payment_identity', 'warning' FROM collided
  UNION ALL SELECT case_id, 14, doc_ordinal, 0, CASE state WHEN 'unmatched' THEN 'ambiguous_document_match' WHEN 'unsettled' THEN 'payment_not_settled' WHEN 'untimely' THEN 'ambiguous_payment_timing' ELSE 'payment_already_in_statement' END, CASE state WHEN 'earlier' THEN 'info' ELSE 'warning' END FROM states WHERE state NOT IN ('applied', 'ambiguous')
  UNION ALL SELECT case_id, 15, 0, 0, 'unresolved_payment_allocation', 'warning' FROM outcome WHERE stop = 99 AND earlier > m_patient_paid
  UNION ALL SELECT case_id, 16, 0, 0, 'payment_exceeds_statement_balance', 'warning' FROM outcome WHERE stop = 99 AND applied > m_balance
  UNION ALL SELECT case_id, 17, 0, 0, 'reconciliation_incomplete', 'warning' FROM outcome WHERE uncertain
  UNION ALL SELECT case_id, 18, 0, 0, CASE WHEN collection > supported AND applied <> 0 THEN 'possible_uncredited_payment' WHEN collection <> supported THEN 'amount_mismatch' ELSE 'no_discrepancy_detected_in_supplied_records' END,
      CASE WHEN collection = supported THEN 'info' ELSE 'warning' END FROM outcome WHERE supported IS NOT NULL AND (collection <> supported OR n_receipts > 0)),
found AS (SELECT case_id, cast(row_number() OVER (PARTITION BY case_id ORDER BY o1, o2, o3) - 1 AS int) AS seq, code, severity FROM raw_findings),
raw_ledger(case_id, o1, o2, label, cents) AS (
  SELECT case_id, 0, 0, 'Provider charges', m_charges FROM outcome WHERE stop > 7
  UNION ALL SELECT case_id, 1, 0, 'Contractual adjustment', -m_adjustments FROM outcome WHERE stop > 7
  UNION ALL SELECT case_id, 2, 0, 'Posted insurer payment', -m_insurer_paid FROM outcome WHERE stop > 7
  UNION ALL SELECT case_id, 3, 0, 'Patient payments already posted', -m_patient_paid FROM outcome WHERE stop > 7
  UNION ALL SELECT case_id, 4, 0, 'Provider statement balance', m_balance FROM outcome WHERE stop > 7
  UNION ALL SELECT case_id, 5, doc_ordinal, 'Matching completed payment after statement', -amount FROM states WHERE state = 'applied'
  UNION ALL SELECT case_id, 6, 0, 'Balance supported by supplied records', supported FROM outcome WHERE supported IS NOT NULL),
linked AS (
  SELECT case_id, bill_id AS doc_id FROM outcome WHERE stop > 5 UNION ALL SELECT case_id, notice_id FROM outcome WHERE stop > 5
  UNION ALL SELECT case_id, doc_id FROM eobs WHERE reason IS NULL AND timely UNION ALL SELECT case_id, doc_id FROM states WHERE state IN ('unsettled', 'untimely', 'earlier', 'applied')),
dropped AS (
  SELECT c.case_id, c.doc_id FROM copies c JOIN outcome o ON o.case_id = c.case_id WHERE o.stop > 2
  UNION ALL SELECT case_id, bill_id FROM outcome WHERE stop = 5
  UNION ALL SELECT case_id, doc_id FROM eobs WHERE reason IS NOT NULL OR NOT timely
  UNION ALL SELECT r.case_id, r.doc_id FROM receipts r JOIN grp g ON r.case_id = g.case_id AND r.doc_ordinal = g.doc_ordinal JOIN grps s ON s.case_id = g.case_id AND s.first_ordinal = g.first_ordinal WHERE s.conflict OR g.doc_ordinal > g.first_ordinal
  UNION ALL SELECT case_id, doc_id FROM states WHERE state IN ('ambiguous', 'unmatched'))
"""
_BOTH = "bill_ordinal IS NOT NULL AND notice_ordinal IS NOT NULL"
ORACLES |= {
    "duplicate_ids": f"{_CHAIN} SELECT case_id FROM ids WHERE dup",
    "user_corrections": f"{_CHAIN} SELECT case_id, string_agg(doc_id || '.' || user_field, ',' ORDER BY doc_ordinal) AS refs FROM docs WHERE user_field <> '' AND user_field <> unconfirmed GROUP BY 1",
    "selected_statements": f"{_CHAIN} SELECT case_id, cast(notice_ordinal AS varchar) AS notice_ordinal, cast(bill_ordinal AS varchar) AS bill_ordinal FROM cases",
    "statement_versions": f"{_CHAIN} SELECT i.case_id, coalesce((SELECT string_agg(doc_id, ',' ORDER BY CASE kind WHEN 'collection' THEN 0 ELSE 1 END, doc_ordinal) FROM copies c WHERE c.case_id = i.case_id), '') AS copies, EXISTS (SELECT 1 FROM versions v WHERE v.case_id = i.case_id AND v.clash IS NOT NULL) AS conflict FROM ids i",
    "match_bill_notice": f"{_CHAIN} SELECT case_id, why AS bill_notice_reason FROM cases WHERE {_BOTH}",
    "timeline_guard": f"{_CHAIN} SELECT case_id, timeline_ok FROM cases WHERE {_BOTH}",
    "missing_amounts": f"{_CHAIN} SELECT case_id, concat_ws(',', {', '.join(f'CASE WHEN m_{k} IS NULL THEN {_quoted(k.replace(chr(95), chr(32)))} END' for k in ('charges', 'adjustments', 'insurer_paid', 'patient_paid', 'balance'))}, CASE WHEN collection IS NULL THEN 'collection balance' END) AS missing FROM cases WHERE {_BOTH}",
    "bill_arithmetic": f"{_CHAIN} SELECT case_id, cast(obligation AS varchar) AS obligation, cast(expected AS varchar) AS expected, cast(m_balance AS varchar) AS balance FROM cases WHERE bill_ordinal IS NOT NULL",
    "match_eobs": f"{_CHAIN} SELECT case_id, doc_ordinal, reason, timely FROM eobs",
    "eob_conflicts": f"{_CHAIN} SELECT case_id, field FROM eob_bad",
    "payment_groups": f"{_CHAIN} SELECT case_id, doc_ordinal, first_ordinal FROM grp",
    "payment_conflicts": f"{_CHAIN} SELECT case_id, first_ordinal, conflict FROM grps",
    "payment_collisions": f"{_CHAIN} SELECT u.case_id, string_agg(u.doc_id, ',' ORDER BY u.doc_ordinal) AS documents FROM unique_receipts u JOIN collided x ON u.case_id = x.case_id AND u.fingerprint = x.fingerprint GROUP BY 1",
    "match_receipts": f"{_CHAIN} SELECT case_id, doc_ordinal, reason FROM states",
    "payment_timing": f"{_CHAIN} SELECT case_id, doc_ordinal, state FROM states",
    "ambiguous_anti": f"{_CHAIN} SELECT case_id, doc_ordinal FROM states WHERE NOT ambiguous",
    "applied_payments": f"{_CHAIN} SELECT case_id, cast(applied AS bigint) AS applied_cents FROM outcome",
    "earlier_payments": f"{_CHAIN} SELECT case_id, cast(earlier AS bigint) AS earlier_cents, earlier > m_patient_paid AS unresolved FROM outcome WHERE stop = 99",
    "case_outcomes": f"""{_CHAIN} SELECT o.case_id, cast(CASE WHEN stop > 2 THEN collection END AS varchar) AS collection_cents, cast(cast(supported AS bigint) AS varchar) AS supported_balance_cents, cast(applied AS bigint) AS applied_payments_cents, uncertain,
        cast((SELECT count(*) FROM found f WHERE f.case_id = o.case_id) AS int) AS n_findings, (SELECT max_by(code, seq) FROM found f WHERE f.case_id = o.case_id) AS last_code FROM outcome o""",
    "findings": f"{_CHAIN} SELECT case_id, seq, code, severity FROM found",
    "ledger": f"{_CHAIN} SELECT case_id, cast(row_number() OVER (PARTITION BY case_id ORDER BY o1, o2) - 1 AS int) AS seq, label, cast(cents AS bigint) AS cents FROM raw_ledger",
    "headline_finding": f"{_CHAIN} SELECT i.case_id, (SELECT min_by(code, CASE WHEN code = 'possible_uncredited_payment' THEN -1 ELSE seq END) FROM found f WHERE f.case_id = i.case_id) AS code FROM ids i",
    "doc_status": f"""{_CHAIN} SELECT d.case_id, d.doc_ordinal, CASE WHEN NOT d.included THEN 'Switched off' WHEN EXISTS (SELECT 1 FROM linked l WHERE l.case_id = d.case_id AND l.doc_id = d.doc_id) THEN 'Connected'
        WHEN EXISTS (SELECT 1 FROM dropped x WHERE x.case_id = d.case_id AND x.doc_id = d.doc_id) THEN 'Not applied' ELSE 'Reviewed for context' END AS status FROM flatdocs d""",
    "case_overview": f"{_FACTS}, p AS (SELECT case_id, count(*) AS n FROM facts WHERE included AND NOT confirmed GROUP BY 1) SELECT d.case_id, cast(count(*) AS int) AS documents, cast(count(*) FILTER (included) AS int) AS active, cast(coalesce(max(p.n), 0) AS int) AS pending FROM case_docs d LEFT JOIN p ON p.case_id = d.case_id GROUP BY 1",
    "export_gate": f"{_FACTS} SELECT case_id, count(*) FILTER (included) > 0 AND count(*) FILTER (included AND NOT confirmed) = 0 AS exportable FROM facts GROUP BY 1",
    "letter_points": f"{_CHAIN} SELECT case_id, count(*) AS points FROM found WHERE code IN ('possible_uncredited_payment', 'amount_mismatch', 'insufficient_itemization', 'ambiguous_document_match', 'missing_payment_evidence', 'user_corrected_facts') GROUP BY 1",
}

# ---------------------------------------------------------------- findings as they are told, with their evidence

_BILL = ("charges", "adjustments", "insurer_paid", "patient_paid", "balance")
_IDENT = (*K.IDENTITY, "claim_id")
_PAYMENT = (*_IDENT, "payment_date", "payment_amount", "payment_status", "payment_reference")
_SHOWN = ("payment_amount", "payment_date", "payment_status", "payment_reference")


def held(a: str, *keys: str) -> str:
    """References to the keys that a row of docs has, as one string; null if none."""
    return "nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {a}.{k} IS NOT NULL THEN {a}.doc_id || '.{k}' END" for k in keys) + "), '')"


def both(*parts: str) -> str:
    return f"coalesce(concat_ws(',', {', '.join(parts)}), '')"


_q = _quoted
_MISSING = "concat_ws(', ', " + ", ".join(f"CASE WHEN o.m_{k} IS NULL THEN {_q(k.replace('_', ' '))} END" for k in _BILL) + ", CASE WHEN o.collection IS NULL THEN 'collection balance' END)"
_ONCE = _CHAIN.rstrip()
for _name in ("case_docs", "flatdocs", "docs", "ranked", "versions", "bill", "notice", "cases", "eobs", "eob_bad", "receipts", "grp", "grps", "unique_receipts", "collided", "states", "outcome", "copies"):
    _ONCE = _ONCE.replace(f"\n{_name} AS (", f"\n{_name} AS MATERIALIZED (")  # each is read many times below
_TOLD = f"""{_ONCE},
paidrefs AS (
  SELECT s.case_id, string_agg({held('r', *_SHOWN)}, ',' ORDER BY s.doc_ordinal) FILTER (state = 'applied') AS applied_refs, string_agg({held('r', *_SHOWN)}, ',' ORDER BY s.doc_ordinal) FILTER (state = 'earlier') AS earlier_refs
  FROM states s JOIN docs r ON r.case_id = s.case_id AND r.doc_ordinal = s.doc_ordinal GROUP BY 1),
o AS MATERIALIZED (
  SELECT x.*, {held('b', *_IDENT)} AS b_ident, {held('n', *_IDENT)} AS n_ident, {held('b', 'service_date', 'statement_date')} AS b_dates, {held('b', 'statement_date')} AS b_stated, {held('n', 'statement_date')} AS n_stated,
         {held('b', *_BILL)} AS b_amounts, {held('b', 'balance')} AS b_balance, {held('n', 'balance')} AS n_balance, {held('b', 'patient_paid')} AS b_paid,
         {held('b', 'balance', 'statement_date')} AS b_closing, {held('n', 'balance', 'statement_date')} AS n_closing, p.applied_refs, p.earlier_refs,
         {", ".join(f"{held('b', k)} AS b_{k}_ref" for k in _BILL)}
  FROM outcome x LEFT JOIN bill b ON b.case_id = x.case_id LEFT JOIN notice n ON n.case_id = x.case_id LEFT JOIN paidrefs p ON p.case_id = x.case_id),
told(case_id, o1, o2, o3, o4, code, severity, title, detail, refs) AS (
  SELECT case_id, 2, 0, 0, 0, 'conflicting_documents', 'warning', {_q(W.DOCUMENT_IDENTIFIERS_MUST_BE_UNIQUE)}, {_q(W.TWO_INCLUDED_RECORDS_SHARE_AN)}, '' FROM ids WHERE dup
  UNION ALL SELECT o.case_id, 3, 0, 0, 0, 'user_corrected_facts', 'info', {_q(W.USING_YOUR_CONFIRMED_CORRECTIONS)}, {_q(W.THESE_VALUES_WERE_CORRECTED_BY)}, string_agg(d.doc_id || '.' || d.user_field, ',' ORDER BY d.doc_ordinal)
    FROM o JOIN docs d ON d.case_id = o.case_id WHERE stop > 2 AND d.user_field <> '' AND d.user_field <> d.unconfirmed GROUP BY o.case_id
  UNION ALL SELECT o.case_id, 4, CASE k.kind WHEN 'collection' THEN 0 ELSE 1 END, 0, 0, 'insufficient_itemization', 'warning', 'Add a ' || k.kind || ' record', {_q(W.A_CONFIRMED_PROVIDER_BILL_AND)}, ''
    FROM o CROSS JOIN (VALUES ('bill'), ('collection')) k(kind) WHERE stop > 2 AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.case_id = o.case_id AND v.kind = k.kind)
  UNION ALL SELECT c.case_id, 4, CASE c.kind WHEN 'collection' THEN 0 ELSE 1 END, 1 + c.doc_ordinal, 0, 'duplicate_document', 'info', {_q(W.DUPLICATE_STATEMENT_COUNTED_ONCE)}, {_q(W.THESE_RECORDS_HAVE_THE_SAME)}, {both(held('f', 'balance'), held('d', 'balance'))}
    FROM copies c JOIN o ON o.case_id = c.case_id JOIN versions v ON v.case_id = c.case_id AND v.kind = c.kind JOIN docs f ON f.case_id = c.case_id AND f.doc_ordinal = v.ord1 JOIN docs d ON d.case_id = c.case_id AND d.doc_ordinal = c.doc_ordinal WHERE stop > 2
  UNION ALL SELECT v.case_id, 4, CASE v.kind WHEN 'collection' THEN 0 ELSE 1 END, 1000, 0, 'conflicting_documents', 'warning', 'Multiple ' || v.kind || ' records need review', {_q(W.THE_INCLUDED_VERSIONS_CONTAIN_DIFFERENT)}, {both(held('f', *bridge.FIELDS), held('d', *bridge.FIELDS))}
    FROM versions v JOIN o ON o.case_id = v.case_id JOIN docs f ON f.case_id = v.case_id AND f.doc_ordinal = v.ord1 JOIN docs d ON d.case_id = v.case_id AND d.doc_ordinal = v.clash WHERE stop > 2
  UNION ALL SELECT case_id, 5, 0, 0, 0, 'ambiguous_document_match', 'warning', {_q(W.BILL_AND_COLLECTION_NOTICE_DO)}, why, {both('b_ident', 'n_ident')} FROM o WHERE stop = 5
  UNION ALL SELECT case_id, 5, 0, 0, 0, 'ambiguous_document_dates', 'warning', {_q(W.CONFIRM_THE_DOCUMENT_TIMELINE)}, {_q(W.USE_YYYY_MM_DD_DATES)}, {both('b_dates', 'n_stated')} FROM o WHERE stop = 6
  UNION ALL SELECT case_id, 5, 0, 0, 0, 'insufficient_itemization', 'warning', {_q(W.CONFIRM_THE_ACCOUNT_AMOUNTS)}, {_q(W.MISSING_UNCONFIRMED_OR_INVALID)} || {_MISSING} || {_q(W.ENTER_EXACT_NONNEGATIVE_DOLLAR_AMOUNTS)}, {both('b_amounts', 'n_balance')} FROM o WHERE stop = 7
  UNION ALL SELECT case_id, 5, 0, 0, 0, 'amount_mismatch', 'warning', {_q(W.THE_PROVIDER_STATEMENT_DOES_NOT)},
    {_q(W.CHARGES_MINUS_ADJUSTMENTS_POSTED_INSURER)} || {usd('expected')} || {_q(W.THE_STATEMENT_REPORTS)} || {usd('m_balance')} || {_q(W.REQUEST_AN_ITEMIZED_LEDGER_BEFORE)}, {both('b_amounts')} FROM o WHERE stop = 8
  UNION ALL SELECT e.case_id, 9, e.doc_ordinal, 0, 0, 'eob_is_not_payment_proof', 'info', {_q(W.INSURANCE_RESPONSIBILITY_IS_NOT_PATIENT)}, {_q(W.AN_EOB_DESCRIBES_INSURANCE_PROCESSING)}, {both(held('d', 'patient_responsibility', 'insurer_paid'))}
    FROM eobs e JOIN docs d ON d.case_id = e.case_id AND d.doc_ordinal = e.doc_ordinal
  UNION ALL SELECT e.case_id, 9, e.doc_ordinal, 1, 0, 'ambiguous_document_match', 'warning', {_q(W.INSURANCE_RECORD_NEEDS_MATCHING_REVIEW)}, coalesce(reason, {_q(W.CONFIRM_WHETHER_THIS_DATED_INSURANCE)}), {both(held('d', *_IDENT, 'statement_date'))}
    FROM eobs e JOIN docs d ON d.case_id = e.case_id AND d.doc_ordinal = e.doc_ordinal WHERE reason IS NOT NULL OR NOT timely
  UNION ALL SELECT e.case_id, 9, e.doc_ordinal, 2, list_position(['charges', 'adjustments', 'allowed', 'insurer_paid', 'patient_responsibility'], e.field), 'conflicting_documents', 'warning', {_q(W.INSURANCE_AND_PROVIDER_AMOUNTS_DIFFER)},
    'The insurance ' || replace(e.field, '_', ' ') || {_q(W.DOES_NOT_AGREE_WITH_THE)}, {both("d.doc_id || '.' || e.field", 'b_amounts')} FROM eob_bad e JOIN o ON o.case_id = e.case_id JOIN docs d ON d.case_id = e.case_id AND d.doc_ordinal = e.doc_ordinal
  UNION ALL SELECT case_id, 10, 0, 0, 0, 'missing_payment_evidence', 'warning', {_q(W.PAYMENT_RECEIPT_NEEDED)}, {_q(W.NO_INCLUDED_PAYMENT_RECEIPT_SUPPORTS)}, {both('b_balance')} FROM o WHERE stop = 99 AND n_receipts = 0
  UNION ALL SELECT g.case_id, 12, g.first_ordinal, 0, 0, 'conflicting_payment_evidence', 'warning', {_q(W.PAYMENT_RECORDS_CONFLICT)}, {_q(W.RECORDS_FOR_THE_SAME_PAYMENT)}, coalesce(string_agg({held('d', *_PAYMENT)}, ',' ORDER BY d.doc_ordinal), '')
    FROM grps s JOIN grp g ON g.case_id = s.case_id AND g.first_ordinal = s.first_ordinal JOIN docs d ON d.case_id = g.case_id AND d.doc_ordinal = g.doc_ordinal WHERE s.conflict GROUP BY g.case_id, g.first_ordinal
  UNION ALL SELECT g.case_id, 12, g.first_ordinal, g.doc_ordinal, 0, 'duplicate_payment_evidence', 'info', {_q(W.SAME_PAYMENT_COUNTED_ONCE)}, {_q(W.THE_PAYMENT_REFERENCE_OR_IDENTICAL)}, {both(held('f', 'payment_reference', 'payment_amount'), held('d', 'payment_reference', 'payment_amount'))}
    FROM grp g JOIN grps s ON g.case_id = s.case_id AND g.first_ordinal = s.first_ordinal AND NOT s.conflict JOIN docs f ON f.case_id = g.case_id AND f.doc_ordinal = g.first_ordinal JOIN docs d ON d.case_id = g.case_id AND d.doc_ordinal = g.doc_ordinal WHERE g.doc_ordinal > g.first_ordinal
  UNION ALL SELECT u.case_id, 13, min(u.doc_ordinal), 0, 0, 'ambiguous_payment_identity', 'warning', {_q(W.POSSIBLE_DUPLICATE_PAYMENT_RECORDS)}, {_q(W.THE_SAME_ACCOUNT_AMOUNT_AND)}, coalesce(string_agg({held('u', 'payment_amount', 'payment_date', 'payment_reference')}, ',' ORDER BY u.doc_ordinal), '')
    FROM unique_receipts u JOIN collided x ON u.case_id = x.case_id AND u.fingerprint = x.fingerprint GROUP BY u.case_id, u.fingerprint
  UNION ALL SELECT s.case_id, 14, s.doc_ordinal, 0, 0, CASE state WHEN 'unmatched' THEN 'ambiguous_document_match' WHEN 'unsettled' THEN 'payment_not_settled' WHEN 'untimely' THEN 'ambiguous_payment_timing' ELSE 'payment_already_in_statement' END, CASE state WHEN 'earlier' THEN 'info' ELSE 'warning' END,
    CASE state WHEN 'unmatched' THEN {_q(W.RECEIPT_CANNOT_BE_APPLIED_TO)} WHEN 'unsettled' THEN {_q(W.PAYMENT_STATUS_DOES_NOT_SUPPORT)} WHEN 'untimely' THEN {_q(W.PAYMENT_AMOUNT_OR_TIMING_NEEDS)} ELSE {_q(W.EARLIER_PAYMENT_NOT_SUBTRACTED_AGAIN)} END,
    CASE state WHEN 'unmatched' THEN s.reason WHEN 'unsettled' THEN {_q(W.THE_PAYMENT_IS_REVERSED_UNSUCCESSFUL)} WHEN 'untimely' THEN {_q(W.CONFIRM_THE_AMOUNT_AND_YYYY)} ELSE {_q(W.THIS_RECEIPT_PREDATES_THE_PROVIDER)} END,
    CASE state WHEN 'unmatched' THEN {both(held('d', *_IDENT), 'b_ident')} WHEN 'unsettled' THEN {both(held('d', *_SHOWN))} WHEN 'untimely' THEN {both(held('d', *_SHOWN), held('d', 'statement_date'), 'b_stated', 'n_stated')} ELSE {both(held('d', *_SHOWN), 'b_paid')} END
    FROM states s JOIN o ON o.case_id = s.case_id JOIN docs d ON d.case_id = s.case_id AND d.doc_ordinal = s.doc_ordinal WHERE state NOT IN ('applied', 'ambiguous')
  UNION ALL SELECT case_id, 15, 0, 0, 0, 'unresolved_payment_allocation', 'warning', {_q(W.EARLIER_RECEIPTS_EXCEED_POSTED_PATIENT)}, {_q(W.THE_EARLIER_RECEIPTS_CANNOT_ALL)}, {both('earlier_refs', 'b_paid')} FROM o WHERE stop = 99 AND earlier > m_patient_paid
  UNION ALL SELECT case_id, 16, 0, 0, 0, 'payment_exceeds_statement_balance', 'warning', {_q(W.PAYMENTS_EXCEED_THE_STATEMENT_BALANCE)}, {_q(W.MATCHING_RECEIPTS_EXCEED_THE_BALANCE)}, {both('applied_refs', 'b_balance')} FROM o WHERE stop = 99 AND applied > m_balance
  UNION ALL SELECT case_id, 17, 0, 0, 0, 'reconciliation_incomplete', 'warning', {_q(W.RESOLVE_THE_HIGHLIGHTED_EVIDENCE_BEFORE)}, {_q(W.A_FINAL_SUPPORTED_BALANCE_IS)}, '' FROM o WHERE uncertain
  UNION ALL SELECT case_id, 18, 0, 0, 0, 'possible_uncredited_payment', 'warning', {_q(W.A_PAYMENT_MAY_NOT_BE)},
    {_q(W.THE_MATCHING_COMPLETED_RECEIPT_S)} || {usd('applied')} || {_q(W.PAID_AFTER_THE_PROVIDER_STATEMENT)} || {usd('supported')} || {_q(W.WHILE_THE_NOTICE_REQUESTS)} || {usd('collection')} || {_q(W.REQUEST_AN_UPDATED_ITEMIZED_LEDGER)}, {both('applied_refs', 'b_closing', 'n_closing')}
    FROM o WHERE supported IS NOT NULL AND collection > supported AND applied <> 0
  UNION ALL SELECT case_id, 18, 0, 0, 0, 'amount_mismatch', 'warning', {_q(W.THE_SUPPLIED_BALANCES_DIFFER)}, {_q(W.THE_NOTICE_REQUESTS)} || {usd('collection')} || {_q(W.THE_SUPPLIED_RECORD_CALCULATION_IS)} || {usd('supported')} || {_q(W.ASK_FOR_THE_TRANSACTIONS_EXPLAINING)}, {both('b_balance', 'n_balance', 'applied_refs')}
    FROM o WHERE supported IS NOT NULL AND collection <> supported AND NOT (collection > supported AND applied <> 0)
  UNION ALL SELECT case_id, 18, 0, 0, 0, 'no_discrepancy_detected_in_supplied_records', 'info', {_q(W.SUPPLIED_AMOUNTS_RECONCILE)}, {_q(W.NO_BALANCE_DISCREPANCY_WAS_DETECTED)}, {both('b_balance', 'n_balance', 'applied_refs')} FROM o WHERE supported IS NOT NULL AND collection = supported AND n_receipts > 0),
say AS MATERIALIZED (SELECT *, cast(row_number() OVER (PARTITION BY case_id ORDER BY o1, o2, o3, o4) - 1 AS int) AS seq FROM told),
book(case_id, o1, o2, label, cents, refs) AS (
  {" UNION ALL ".join(f"SELECT case_id, {i}, 0, {_q(label)}, {sign}m_{k}, coalesce(b_{k}_ref, '') FROM o WHERE stop > 7" for i, (k, label, sign) in enumerate((("charges", "Provider charges", ""), ("adjustments", W.CONTRACTUAL_ADJUSTMENT, "-"), ("insurer_paid", W.POSTED_INSURER_PAYMENT, "-"), ("patient_paid", W.PATIENT_PAYMENTS_ALREADY_POSTED, "-"), ("balance", W.PROVIDER_STATEMENT_BALANCE, ""))))}
  UNION ALL SELECT s.case_id, 5, s.doc_ordinal, {_q(W.MATCHING_COMPLETED_PAYMENT_AFTER_STATEMENT)}, -amount, {both(held('d', *_SHOWN))} FROM states s JOIN docs d ON d.case_id = s.case_id AND d.doc_ordinal = s.doc_ordinal WHERE state = 'applied'
  UNION ALL SELECT case_id, 6, 0, {_q(W.BALANCE_SUPPORTED_BY_SUPPLIED_RECORDS)}, supported, {both('b_balance', 'applied_refs')} FROM o WHERE supported IS NOT NULL),
single_account AS (SELECT case_id, CASE WHEN count(*) = 1 THEN min(v_account) END AS account FROM case_docs WHERE included AND kind = 'collection' AND v_account IS NOT NULL AND unconfirmed <> 'account' GROUP BY 1),
single_provider AS (SELECT case_id, CASE WHEN count(*) = 1 THEN min(v_provider) END AS provider FROM case_docs WHERE included AND kind = 'bill' AND v_provider IS NOT NULL AND unconfirmed <> 'provider' GROUP BY 1),
points AS (SELECT case_id, string_agg('- ' || detail || CASE WHEN refs <> '' THEN ' [Evidence: ' || replace(refs, ',', ', ') || ']' ELSE '' END, chr(10) ORDER BY seq) AS t FROM say WHERE code IN {_in(packet.LETTER_CODES)} GROUP BY 1),
letters AS (
  SELECT o.case_id, '2026-01-01' || chr(10) || chr(10) || 'To the billing team' || coalesce(' at ' || nullif(provider, ''), '') || ',' || chr(10) || chr(10) || {_q(W.I_AM_REQUESTING_A_REVIEW)}
      || CASE WHEN coalesce(account, '') <> '' THEN chr(10) || chr(10) || {_q(W.ACCOUNT_REFERENCE_SHOWN_ON_THE)} || account || '.' ELSE '' END
      || CASE WHEN collection IS NOT NULL AND stop > 2 THEN chr(10) || {_q(W.THE_SUPPLIED_COLLECTION_NOTICE_REQUESTS)} || {usd('collection')} || '.' ELSE '' END
      || coalesce(chr(10) || chr(10) || {_q(W.THE_FOLLOWING_POINTS_NEED_CLARIFICATION)} || chr(10) || t, '')
      || chr(10) || chr(10) || {_q(W.PLEASE_IDENTIFY_THE_ORIGINAL_PROVIDER)} || chr(10) || chr(10) || {_q(W.THIS_REQUEST_IS_BASED_ON)} || chr(10) || chr(10) || 'Sincerely,' || chr(10) || '[Your name]' || chr(10) || {_q(W.YOUR_PREFERRED_REPLY_ADDRESS)} AS letter
  FROM o LEFT JOIN single_account a ON a.case_id = o.case_id LEFT JOIN single_provider p ON p.case_id = o.case_id LEFT JOIN points ON points.case_id = o.case_id),
shown AS (SELECT case_id, string_agg('<article><h3>' || {escape('title')} || '</h3><p>' || {escape('detail')} || '</p><small>' || {escape("replace(refs, ',', ', ')")} || '</small></article>', '' ORDER BY seq) AS t FROM say GROUP BY 1),
booked AS (SELECT case_id, string_agg('<tr><td>' || {escape('label')} || '</td><td>' || {usd('cents')} || '</td><td>' || {escape("replace(refs, ',', ', ')")} || '</td></tr>', '' ORDER BY o1, o2) AS t FROM book GROUP BY 1)
"""
ORACLES |= {
    "evidence_refs": f"{_TOLD} SELECT case_id, seq, code, refs FROM say",
    "evidence_resolve": f"""{_TOLD}, each AS (SELECT case_id, seq, unnest(string_split(refs, ',')) AS ref FROM say WHERE refs <> '')
      SELECT e.case_id, e.seq, e.ref, (SELECT min(d.doc_ordinal) FROM flatdocs d WHERE d.case_id = e.case_id AND d.doc_id = split_part(e.ref, '.', 1)) AS doc_ordinal, split_part(e.ref, '.', 2) AS field FROM each e""",
    "letter_text": f"{_TOLD} SELECT case_id, letter FROM letters",
    "packet_findings": f"{_TOLD} SELECT o.case_id, coalesce(shown.t, '') AS findings_html, coalesce(booked.t, '') AS ledger_html FROM o LEFT JOIN shown ON shown.case_id = o.case_id LEFT JOIN booked ON booked.case_id = o.case_id",
}

_TITLE, _SOURCES = "Provider inquiry", "".join(f'<li><a href="{u}">{t}</a></li>' for t, u in packet.SOURCES.items())
_PARTS = [
    _q('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Evidence packet</title></head><body><main>\n<p>Prepared 2026-01-01</p>\n<h2>What needs clarification</h2>'),
    "coalesce(shown.t, '<p>No findings could be supported from the confirmed records.</p>')",
    _q("\n<h2>Reconstruction from supplied records</h2>\n<table><thead><tr><th>Entry</th><th>Amount</th><th>Evidence</th></tr></thead><tbody>"),
    "coalesce(booked.t, '')",
    _q("</tbody></table>\n<h2>Attachment index</h2><ol>"),
    "coalesce(a.attachments, '')",
    _q("</ol>\n<h2>Reviewed facts and source passages</h2>\n<table><thead><tr><th>Evidence reference</th><th>Fact</th><th>Original source</th></tr></thead><tbody>"),
    "coalesce(f.fact_rows, '')",
    _q(f'</tbody></table>\n<section class="draft"><h2>{_TITLE} — draft</h2>\n<p><small>') + " || " + escape(_q(W.DRAFT_ASSEMBLED_FROM_THE_CONFIRMED)),
    _q("</small></p><pre>"),
    escape("letters.letter"),
    _q(f"</pre></section>\n<h2>Official guidance</h2><ul>{_SOURCES}</ul>\n</main></body></html>"),
]
ORACLES["packet_html"] = f"""{_TOLD} SELECT letters.case_id, {" || ".join(_PARTS)} AS html
  FROM letters LEFT JOIN shown ON shown.case_id = letters.case_id LEFT JOIN booked ON booked.case_id = letters.case_id
  LEFT JOIN ({ORACLES["packet_attachments"]}) a ON a.case_id = letters.case_id LEFT JOIN ({ORACLES["packet_facts"]}) f ON f.case_id = letters.case_id"""
ORACLES["sql_fields"] = ORACLES["local_fields"]
ORACLES["sql_validated"] = f"""{_FACTS}, n AS (SELECT *, CASE WHEN field IN {_in(K.MONEY_FIELDS)} THEN cast(cast({cents('value')} / cast(100 AS decimal(5,0)) AS decimal(22,2)) AS varchar)
        WHEN field IN {_in(K.DATE_FIELDS)} THEN strftime(coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%m/%d/%Y')), '%Y-%m-%d') ELSE value END AS given FROM facts)
  SELECT case_id, doc_ordinal, field, given AS value, {_LABEL} || ': ' || value AS quote FROM n WHERE given IS NOT NULL"""
_PROBLEM = f"""CASE WHEN field IN {_in(K.MONEY_FIELDS)} AND {cents('value')} IS NULL THEN 'Use an exact nonnegative dollar amount.'
  WHEN field IN {_in(K.DATE_FIELDS)} AND NOT (regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(value, '%Y-%m-%d') IS NOT NULL) THEN 'Use YYYY-MM-DD for dates; leave unknown dates blank.' END"""
ORACLES["field_problems"] = f"{_FACTS} SELECT case_id, doc_ordinal, field, {_PROBLEM} AS problem FROM facts"
ORACLES["dollar_escape"] = f"WITH {bridge.CASE_DOCS} SELECT case_id, doc_ordinal, replace(text, '$', '\\$') AS text FROM case_docs"
ORACLES["overlaid"] = f"{_FACTS} SELECT case_id, doc_ordinal, field, CASE WHEN field = 'patient' THEN 'Somebody New' ELSE value END AS value FROM facts UNION ALL SELECT case_id, doc_ordinal, 'note', 'added by hand' FROM case_docs"
ORACLES["packet_files"] = f"SELECT case_id, sha256(html) AS sha256 FROM ({ORACLES['packet_html']}) AS packets"
