"""Queries of the evidence checks: the prints of tickets, line by line, and the fields captured from them.

The DuckDB texts work on the lines themselves: they join, search and count what the two bindings hold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import evidence as V
from tallyforge.operators import standardise as S
from tallyforge.operators import validate as L
from tallyforge.plans.register import Register
from tallyforge.sources import records as X

Q = Register()

_N = "trim(regexp_replace(translate({0}, '，。：；（）【】、－　', ',.:;()[],- '), '\\s+', ' ', 'g'))"
_A = "regexp_replace({0}, '[^0-9A-Za-z]', '', 'g')"
_D = "regexp_replace({0}, '[^0-9]', '', 'g')"
#: one row a record: lines, whole text; then one row a field that has a value
_TEXTS = f""", lines AS (SELECT stem, i, {_N.format('text')} AS t FROM prints),
texts AS (SELECT stem, list(t ORDER BY i) AS ls, {_N.format("string_agg(t, ' ' ORDER BY i)")} AS w FROM lines GROUP BY stem),
f AS (SELECT p.stem, p.field, p.kind, p.value AS raw, {_N.format('p.value')} AS v, {_A.format('p.value')} AS a, ls, w FROM print_fields p JOIN texts t ON p.stem = t.stem WHERE trim(p.value) <> '') """
_TEXT_OK = "contains(w, v)"
_ALNUM = "({a} <> '' AND (len(list_filter(ls, lambda l: contains(" + _A.format("l") + ", {a}))) > 0 OR (length({a}) >= 6 AND contains(" + _A.format("w") + ", {a}))))"
_IDS = "len(list_filter(string_split(trim(raw), ' / '), lambda s: trim(s) <> '' AND NOT " + _ALNUM.format(a=_A.format("s")) + ")) = 0"
_M = _D.format("raw")
_MASTER = f"(length({_M}) = 11 AND (contains({_D.format('w')}, {_M}) OR (contains({_D.format('w')}, substr({_M}, 1, 3)) AND contains({_D.format('w')}, substr({_M}, 4)))))"
_TOKENS = "list_filter(regexp_split_to_array(upper(v), '[^0-9A-Z&]+'), lambda x: x <> '')"
_NUMS = f"list_filter({_TOKENS}, lambda x: regexp_matches(x, '[0-9]'))"
_WORDS = f"list_filter({_TOKENS}, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '[0-9]'))"
_LAST = f"list_extract({_TOKENS}, -1)"
_COVER = f"""(len({_NUMS}) + len({_WORDS}) > 0 AND len(list_filter({_NUMS}, lambda x: NOT contains(upper(w), x))) = 0
 AND len(list_filter({_WORDS}, lambda x: NOT contains(upper(w), x))) <= 0.05 * len({_WORDS})
 AND contains(upper(w), {_TOKENS}[1]) AND contains(upper(w), {_LAST})
 AND strpos(upper(w), {_TOKENS}[1]) <= length(w) - strpos(reverse(upper(w)), reverse({_LAST})) - length({_LAST}) + 2)"""
_LONG = f"({_TEXT_OK} OR {_COVER})"
#: days of the print: with a year, and without one
_MON = "CAST((strpos('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', upper({0})) + 2) // 3 AS INTEGER)"
_DATES = f""", named AS (
  SELECT stem, unnest(regexp_extract_all(w, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b')) AS day FROM texts
  UNION ALL SELECT stem, '20' || x[8:9] || '-' || lpad(CAST({_MON.format('x[4:6]')} AS VARCHAR), 2, '0') || '-' || x[1:2] FROM (SELECT stem, unnest(regexp_extract_all(w, '\\b[0-9]{{2}}-[A-Z][a-z]{{2}}-[0-9]{{2}}\\b')) AS x FROM texts)
  UNION ALL SELECT stem, '--' || lpad(CAST({_MON.format('x[3:5]')} AS VARCHAR), 2, '0') || '-' || x[1:2] FROM (SELECT stem, unnest(regexp_extract_all(w, '\\b[0-9]{{2}}(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\\b')) AS x FROM texts)
  UNION ALL SELECT stem, replace(replace(replace(x, '年', '-'), '月', '-'), '日', '') FROM (SELECT stem, unnest(regexp_extract_all(w, '[0-9]{{4}}年[0-9]{{2}}月[0-9]{{2}}日')) AS x FROM texts)
  UNION ALL SELECT stem, CAST(y AS VARCHAR) || '-' || x[5:6] || '-' || x[7:8] FROM (SELECT stem, x, CAST(x[1:4] AS INT) + CASE WHEN CAST(x[1:4] AS INT) < 100 THEN 2000 ELSE 0 END AS y FROM (SELECT stem, unnest(regexp_extract_all(w, '\\b[0-9]{{8}}\\b')) AS x FROM texts))
    WHERE y BETWEEN 1990 AND 2100 AND CAST(x[5:6] AS INT) BETWEEN 1 AND 12 AND CAST(x[7:8] AS INT) BETWEEN 1 AND 31
), days AS (SELECT stem, list(DISTINCT day) AS c FROM named GROUP BY stem),
dated AS (
  SELECT f.stem, field, kind, raw, CASE WHEN len(list_filter(c, lambda d: NOT starts_with(d, '--'))) > 0 OR contains(w, raw[1:4])
    THEN list_contains(c, raw) OR (list_contains(c, '-' || raw[5:10]) AND contains(w, raw[1:4])) END AS passed
  FROM f JOIN days d ON f.stem = d.stem WHERE kind = 'date' AND len(c) > 0
) """
_VALUES = ", held AS (SELECT stem, string_agg(coalesce(value, ''), ' ' ORDER BY field) AS vs, max(CASE WHEN field = 'GOODS_HS_CODE' THEN value END) AS hs FROM print_fields GROUP BY stem) "
_REVERSE = f"""
  SELECT DISTINCT x.stem, 'MAWB_NO' AS field, 'missed' AS kind, n AS value, false AS passed FROM (
    SELECT stem, {_D.format('m')} AS n FROM (SELECT stem, unnest(regexp_extract_all(w, '(?:^|[^0-9])([0-9]{{3}}[- ]?[0-9]{{4}} ?[0-9]{{4}})(?:$|[^0-9])', 1)) AS m FROM texts)) x JOIN held h ON x.stem = h.stem
  WHERE CAST(n[4:10] AS BIGINT) % 7 = CAST(n[11:11] AS BIGINT) AND NOT contains({_D.format('vs')}, n)
  UNION ALL SELECT DISTINCT x.stem, 'TAX_ID', 'missed', n, false FROM (SELECT stem, unnest(regexp_extract_all(upper(w), '(?:VAT|EORI) NO:? ([A-Z]{{0,3}}[0-9][0-9A-Z./-]{{5,}})', 1)) AS n FROM texts) x JOIN held h ON x.stem = h.stem
  WHERE length({_A.format('n')}) >= 8 AND NOT contains({_A.format('vs')}, {_A.format('n')})
  UNION ALL SELECT DISTINCT x.stem, 'GOODS_HS_CODE', 'missed', n, false FROM (SELECT stem, unnest(regexp_extract_all(regexp_extract(upper(t), '\\bHS\\s*(?:CODES?)?\\s*:(.*)$', 1), '[0-9]{{6,10}}')) AS n FROM lines) x JOIN held h ON x.stem = h.stem
  WHERE NOT contains({_D.format("coalesce(hs, '')")}, n[1:6])"""
_ALL = (
    _TEXTS + _DATES + _VALUES + f""", checks AS (SELECT stem, field, kind, raw AS value, CASE kind WHEN 'text' THEN {_TEXT_OK} WHEN 'long' THEN {_LONG} WHEN 'alnum' THEN {_ALNUM.format(a='a')} WHEN 'ids' THEN {_IDS} ELSE {_MASTER} END AS passed
  FROM f WHERE kind IN ('text', 'long', 'alnum', 'ids', 'master') UNION ALL SELECT stem, field, kind, raw, passed FROM dated WHERE passed IS NOT NULL UNION ALL {_REVERSE}) """
)
#: line numbers of a text value: single lines, else the first of the shortest spans
_SPANS = """, spans AS (SELECT a.stem, a.i, n, CASE n WHEN 1 THEN a.t WHEN 2 THEN a.t || ' ' || b.t WHEN 3 THEN a.t || ' ' || b.t || ' ' || c.t ELSE a.t || ' ' || b.t || ' ' || c.t || ' ' || d.t END AS s
  FROM lines a CROSS JOIN (VALUES (1), (2), (3), (4)) k(n) LEFT JOIN lines b ON b.stem = a.stem AND b.i = a.i + 1 LEFT JOIN lines c ON c.stem = a.stem AND c.i = a.i + 2 LEFT JOIN lines d ON d.stem = a.stem AND d.i = a.i + 3),
hits AS (SELECT f.stem, f.field, s.n, s.i FROM f JOIN spans s ON f.stem = s.stem WHERE s.s IS NOT NULL AND contains(s.s, f.v)),
least AS (SELECT stem, field, min(n) AS n FROM hits GROUP BY stem, field),
found AS (SELECT h.stem, h.field, CASE WHEN l.n = 1 THEN string_agg(CAST(h.i AS VARCHAR), ',' ORDER BY h.i) ELSE array_to_string(range(min(h.i), min(h.i) + l.n), ',') END AS sources FROM hits h JOIN least l ON h.stem = l.stem AND h.field = l.field AND h.n = l.n GROUP BY h.stem, h.field, l.n) """
_JOINED = lambda c="sources": F.array_join(c, ",").alias("sources")
INPUTS = ["prints", "print_fields"]


def _rows(prints, fields, kind):
    """Fields of a kind beside the lines of their record."""
    return fields.where((F.col("kind") == kind) & ~T.blank(F.col("value"))).join(V.printed(prints), "stem")


def _checked(kind, of):
    return lambda p, f: _rows(p, f, kind).select("stem", "field", of(F.col("value"), F.col("lines"), F.col("whole")).alias("passed"))


for _n in ("evd_01_text_evidence", "jn_17_evidence_join"):
    Q.add(_n, INPUTS, lambda p, f: V.text_evidence(f.where("kind = 'text'"), p).select("stem", "field", "passed", _JOINED()),
          _TEXTS + _SPANS + f"SELECT f.stem, f.field, {_TEXT_OK} AS passed, x.sources FROM f LEFT JOIN found x ON f.stem = x.stem AND f.field = x.field WHERE kind = 'text'")
Q.add("win_03_line_spans", ["prints"], lambda p: V.line_spans(p).select("stem", "i", "n", "span"), _TEXTS.split(", texts AS")[0].split(",\ntexts")[0] + _SPANS.split("),\nhits")[0] + ") SELECT stem, i, n, s AS span FROM spans WHERE s IS NOT NULL")
Q.add("evd_02_alnum_evidence", INPUTS, _checked("alnum", V.in_alnum), _TEXTS + f"SELECT stem, field, {_ALNUM.format(a='a')} AS passed FROM f WHERE kind = 'alnum'")
Q.add("evd_03_multi_id_evidence", INPUTS, _checked("ids", V.in_multi_id), _TEXTS + f"SELECT stem, field, {_IDS} AS passed FROM f WHERE kind = 'ids'")
Q.add("evd_04_master_number_evidence", INPUTS, _checked("master", lambda v, lines, whole: V.in_master_number(v, whole)), _TEXTS + f"SELECT stem, field, {_MASTER} AS passed FROM f WHERE kind = 'master'")
Q.add(
    "evd_05_long_value_evidence", INPUTS,
    lambda p, f: _rows(p, f, "long").select("stem", "field", V.long_sources(F.col("value"), F.col("lines"), F.col("whole")).alias("r")).select("stem", "field", "r.passed", _JOINED("r.sources")),
    _TEXTS + f""", c AS (SELECT *, {_COVER} AS passed, list_slice({_TOKENS}, 1, 50) AS tok FROM f WHERE kind = 'long')
    SELECT stem, field, passed, CASE WHEN passed THEN array_to_string(list_filter(range(1, len(ls) + 1), lambda k: len(list_filter(tok, lambda x: contains(upper(ls[k]), x))) > 0), ',') END AS sources FROM c""",
)
Q.add("evd_06_date_evidence", INPUTS, lambda p, f: _rows(p, f, "date").select("stem", F.explode(F.array_compact(F.array(V.date_evidence(F.col("value"), S.date_candidates(F.col("whole")), F.col("whole"))))).alias("passed")), _TEXTS + _DATES + "SELECT stem, passed FROM dated WHERE passed IS NOT NULL")
Q.add(
    "evd_09_missed_hs", INPUTS,
    lambda p, f: f.where("field = 'GOODS_HS_CODE'").join(V.printed(p), "stem").select("stem", F.array_join(F.array_sort(V.missed_hs(F.col("lines"), F.col("value"))), ",").alias("missed")),
    _TEXTS + _VALUES + f", r AS ({_REVERSE}) SELECT p.stem, coalesce(string_agg(r.value, ',' ORDER BY r.value), '') AS missed FROM print_fields p LEFT JOIN r ON r.stem = p.stem AND r.field = 'GOODS_HS_CODE' WHERE p.field = 'GOODS_HS_CODE' GROUP BY p.stem",
)
_JOB = lambda r: V.check_records(V.as_records(r), dates=S.date_candidates, sources=False)
Q.add_records("evd_10_evidence_job", INPUTS, lambda r: _JOB(r).select("stem", "field", "kind", "value", "passed"), _ALL + "SELECT stem, field, kind, value, passed FROM checks")
_COUNTS = "SELECT stem, count(*) AS checked, count(*) FILTER (WHERE passed) AS passed, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE NOT passed), '') AS failed FROM checks GROUP BY stem"
Q.add_records("agg_14_fidelity_summary", INPUTS, lambda r: V.fidelity_summary(_JOB(r)).select("stem", "checked", "passed", "failed"), _ALL + _COUNTS)
Q.add(
    "agg_14_source_lines", INPUTS,
    lambda p, f: V.fidelity_summary(V.evidence_job(f.where("kind = 'text'"), p, reverse=())).select("stem", F.explode("sources").alias("field", "lines")).select("stem", "field", F.array_join("lines", ",").alias("lines")),
    _TEXTS + _SPANS + "SELECT f.stem, f.field, x.sources AS lines FROM f JOIN found x ON f.stem = x.stem AND f.field = x.field WHERE kind = 'text'",
)
Q.add_records("agg_14_batch", INPUTS, lambda r: V.fidelity_batch(V.fidelity_summary(_JOB(r))), _ALL + f", s AS ({_COUNTS}) SELECT count(*) AS records, count(*) FILTER (WHERE checked > passed) AS with_failures, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(passed) AS BIGINT) AS passed FROM s")
_HISTORY = ["model", "processed_at", "uploader"]


def _recheck(records, pairs, tickets):
    """Checks of all records, computed twice: on records parsed in the past, then on the result."""
    flags = L.validate(pairs, [*L.number_rules(("sent_MAWB_NO", "sent_HAWB_NO")), *L.length_rules(["SHIPPER_INFO_STATE", "NOTIFY_INFO_CITY"])]).select("stem", F.concat("field", F.lit(": "), "message").alias("message"))
    # some records have no print, some no fields: neither kind is checked
    evidence = V.fidelity_summary(_JOB(records.where((F.col("num") % 9 != 0) & (F.substring("stem", -1, 1) != "9"))))
    old = tickets.where("num % 4 <> 0").select("stem", "model", F.when(F.col("num") % 3 == 0, " ").otherwise(F.col("CREATE_TIME")).alias("processed_at"), F.when(F.col("num") % 2 == 0, "u1").alias("uploader"))
    first = X.recheck(pairs, flags, evidence, old, _HISTORY)
    return X.recheck(pairs, flags, evidence, first, _HISTORY)


_SENT = lambda n: f"trim({n}) || trim(coalesce(sent_{n}, '')) <> ''"
Q.add_records(
    "acc_10_recheck", ["pairs", *INPUTS, "tickets"],
    lambda r, p, t: _recheck(r, p, t).select("stem", *_HISTORY, F.array_join("flags", "; ").alias("flags"), "needs_review", "checked", "passed"),
    _ALL + f""", s AS (SELECT c.stem, count(*) AS checked, count(*) FILTER (WHERE passed) AS passed, list_sort(list('evidence: ' || field) FILTER (WHERE NOT passed)) AS failed FROM checks c JOIN tickets t ON c.stem = t.stem WHERE t.num % 9 <> 0 AND right(c.stem, 1) <> '9' GROUP BY c.stem),
    w AS (SELECT stem, CASE WHEN {_SENT('MAWB_NO')} THEN CASE WHEN {_SENT('HAWB_NO')} THEN [] ELSE ['HAWB_NO: house number missing'] END WHEN {_SENT('HAWB_NO')} THEN ['MAWB_NO: master number missing'] ELSE ['MAWB_NO: both numbers missing'] END AS a,
      CASE WHEN length(NOTIFY_INFO_CITY) > 50 THEN ['NOTIFY_INFO_CITY: longer than 50'] ELSE [] END AS b, CASE WHEN length(SHIPPER_INFO_STATE) > 50 THEN ['SHIPPER_INFO_STATE: longer than 50'] ELSE [] END AS c FROM pairs),
    g AS (SELECT w.stem, array_to_string(list_concat(list_concat(list_concat(a, b), c), CASE WHEN s.stem IS NULL THEN ['no transcript'] ELSE coalesce(s.failed, []) END), '; ') AS flags, coalesce(s.checked, 0) AS checked, coalesce(s.passed, 0) AS passed FROM w LEFT JOIN s ON w.stem = s.stem)
    SELECT g.stem, CASE WHEN num % 4 <> 0 THEN model END AS model, CASE WHEN num % 4 <> 0 AND num % 3 <> 0 THEN CREATE_TIME END AS processed_at, CASE WHEN num % 4 <> 0 AND num % 2 = 0 THEN 'u1' END AS uploader, flags, flags <> '' AS needs_review, checked, passed FROM g JOIN tickets t ON g.stem = t.stem""",
)
