"""Queries of record comparison and accuracy statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyforge.operators import accuracy as A
from tallyforge.operators import events as E
from tallyforge.operators import ledger as G
from tallyforge.plans.bindings import FIELDS
from tallyforge.plans.register import Register
from tallyforge.plans.scalar_queries import KINDS, SAME
from tallyforge.sources.records import settle
from tallyforge.streaming.streams import shared_folder

Q = Register()
_C = f", c AS (SELECT *, {KINDS} AS kind, NOT (trim(model) = '' AND trim(final) = '') AS comparable, NOT {SAME} AS changed FROM cells) "
_R = _C.rstrip() + ", r AS (SELECT stem, count(*) FILTER (WHERE comparable) AS comparable, count(*) FILTER (WHERE changed) AS total FROM c GROUP BY stem) "


def _cells(t, f):
    return A.to_cells(t, f, FIELDS)


def _kinded(c):
    return c.withColumn("kind", F.expr(KINDS))


Q.add(
    "acc_01_accuracy_rows",
    ["tickets", "finals", "cells"],
    lambda t, f, _: A.accuracy_rows(_cells(t, f)).select("stem", "comparable", "total", "fields"),
    _C + "SELECT stem, count(*) FILTER (WHERE comparable) AS comparable, count(*) FILTER (WHERE changed) AS total, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE changed), '') AS fields FROM c GROUP BY stem",
)
# --- tickets with staging events -----------------------------------------------------

#: columns that staging events carry, with their kind
STAGED = {"PIECES": "int", "GOODS": "text", "COUNTRY": "text"}
_URGENT = "model IN ('1-URGENT', '2-HIGH')"
_FOLD = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def _same(kind: str, a: str, b: str) -> str:
    """DuckDB's comparison of two values of a kind."""
    number = f"TRY_CAST({a} AS DOUBLE) = TRY_CAST({b} AS DOUBLE)" if kind == "int" else f"{_FOLD(a)} = {_FOLD(b)}"
    return f"(CASE WHEN {_FOLD(a)} = '' OR {_FOLD(b)} = '' THEN {_FOLD(a)} = {_FOLD(b)} ELSE {number} END)"


def staged_tickets(t, f, e):
    """Attribution and exemption of each ticket from its model, staged and final values: the log is folded in one pass, and its row
    meets the ticket's two versions in one row, so each input is read once."""
    last = E.folded_touches(e, STAGED).select("stem", F.struct(*STAGED).alias("s"), "staged", "reviewed", "first", *[f"later_{c}" for c in STAGED])
    both = t.select("stem", F.struct(*STAGED).alias("m")).join(f.select("stem", "model", "status", F.struct(*STAGED).alias("_f")), "stem").join(last, "stem", "left")
    final = F.struct(*[F.when(F.expr(_URGENT) | ~F.coalesce("staged", F.lit(False)) | F.col(f"s.{c}").isNull(), F.col(f"_f.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in STAGED])
    touched = F.struct(*[E.touches(c, k, F.col(f"m.{c}")).alias(c) for c, k in STAGED.items()])
    records = both.select("stem", "model", "status", F.when(F.col("staged"), F.col("reviewed")).alias("reviewed"), "staged", "m", "s", final.alias("f"), touched.alias("touched"))
    return A.attributed_rows(records, STAGED, ["model", "status", "reviewed"])


_DIFFS = " UNION ALL ".join(
    f"SELECT e.stem, seq, role, '{c}' AS field, CASE WHEN row_number() OVER w = 1 THEN t.{c} ELSE lag(e.{c}) OVER w END AS a, e.{c} AS b, {'rule_' + c if c != 'PIECES' else chr(39) * 2} AS rule, '{k}' AS kind FROM ticket_events e JOIN tickets t ON t.stem = e.stem WHERE e.kind <> 'review' WINDOW w AS (PARTITION BY e.stem ORDER BY seq)"
    for c, k in STAGED.items()
)
_BOTH = lambda a, b: f"CASE WHEN kind = 'int' THEN {_same('int', a, b)} ELSE {_same('text', a, b)} END"
_TICKETS = f""", s AS (SELECT stem, {', '.join(f"arg_max({c}, seq) AS {c}" for c in STAGED)}, bool_or(role = 'inputter') AS reviewed FROM ticket_events WHERE kind <> 'review' GROUP BY stem),
rv AS (SELECT stem, bool_or(role = 'inputter') AS reviewed FROM ticket_events GROUP BY stem HAVING bool_or(kind <> 'review')),
n AS (SELECT f.stem, f.num, f.model, f.status, {', '.join(f"CASE WHEN {_URGENT} OR s.{c} IS NULL THEN f.{c} ELSE s.{c} END AS {c}" for c in STAGED)} FROM finals f LEFT JOIN s ON s.stem = f.stem),
d AS (SELECT stem, seq, role, field, rule, a, b FROM ({_DIFFS}) WHERE NOT {_BOTH('a', 'b')}),
h AS (SELECT stem, field, nullif(arg_max(rule, seq), '') AS rule, bool_or(role = 'inputter') AS by_inp, bool_or(role <> 'inputter') AS by_doc FROM d GROUP BY stem, field),
x AS ({' UNION ALL '.join(f"SELECT t.stem, '{c}' AS field, '{k}' AS kind, t.{c} AS m, n.{c} AS f, s.{c} AS s, s.stem IS NOT NULL AS staged FROM tickets t JOIN n ON n.stem = t.stem LEFT JOIN s ON s.stem = t.stem" for c, k in STAGED.items())}),
y AS (SELECT x.*, NOT (trim(m) = '' AND trim(f) = '') AS comparable, NOT {_BOTH('m', 'f')} AS changed, staged AND NOT {_BOTH('s', 'f')} AS late FROM x),
z AS (SELECT y.*, coalesce(h.by_inp, false) AS by_inp, coalesce(h.by_doc, false) AS by_doc, CASE WHEN changed AND NOT late THEN h.rule END AS rule FROM y LEFT JOIN h ON h.stem = y.stem AND h.field = y.field),
r AS (SELECT stem, count(*) FILTER (WHERE comparable AND rule IS NULL) AS comparable, count(*) FILTER (WHERE changed AND rule IS NULL) AS total,
  count(*) FILTER (WHERE rule IS NULL AND CASE WHEN staged THEN by_doc ELSE changed END) AS doc, count(*) FILTER (WHERE rule IS NULL AND staged AND (by_inp OR late)) AS inp, count(*) FILTER (WHERE rule IS NOT NULL) AS polished FROM z GROUP BY stem) """
_IN = ["tickets", "finals", "ticket_events"]
Q.add("acc_02_attribution", _IN, lambda t, f, e: staged_tickets(t, f, e).select("stem", "doc", "inp"), _TICKETS + "SELECT stem, doc, inp FROM r")
Q.add("acc_03_rule_exemption", _IN, lambda t, f, e: staged_tickets(t, f, e).select("stem", "comparable", "total", "polished"), _TICKETS + "SELECT stem, comparable, total, polished FROM r")
Q.add("agg_07_rule_histogram", _IN, lambda t, f, e: A.accepted_rules(staged_tickets(t, f, e)), _TICKETS + "SELECT rule, count(*) AS n FROM z WHERE rule IS NOT NULL GROUP BY rule")
Q.add(
    "evt_03_event_diffs",
    ["tickets", "ticket_events"],
    lambda t, e: E.event_diffs(e, t, STAGED).select("stem", "seq", "field", "from", "to", F.coalesce("rule", F.lit("")).alias("rule")),
    _TICKETS.replace("finals", "tickets") + 'SELECT stem, seq, field, a AS "from", b AS "to", rule FROM d',
)
Q.add("win_05_last_toucher", ["tickets", "ticket_events"], lambda t, e: E.last_touchers(E.event_diffs(e, t, STAGED)).select("stem", "field", F.coalesce("rule", F.lit("")).alias("rule"), "by_inputter", "by_preparer"), _TICKETS.replace("finals", "tickets") + "SELECT stem, field, coalesce(rule, '') AS rule, by_inp AS by_inputter, by_doc AS by_preparer FROM h")
_LEGACY = "status = 'F' AND model = '4-NOT SPECIFIED'"


def _summary_rows(t, f, e):
    how = G.review_provenance(F.col("reviewed"), F.when(F.col("model") == "5-LOW", "inputter").otherwise("preparer"))
    rows = staged_tickets(t, f, e).withColumns({"legacy": F.expr(_LEGACY), "submitted": F.col("status") == "F", "h": how})
    return rows.select("*", "h.*").drop("h", "model", "status", "reviewed")


def _settled_rows(t, f, e):
    """The rows of a report whose tables all read them."""
    return settle(_summary_rows(t, f, e), f"{shared_folder(t.sparkSession)}/accuracy-{uuid.uuid4().hex}")


_SUMMARY = _TICKETS + f""", q AS (SELECT r.*, {_LEGACY} AS legacy, status = 'F' AS submitted, NOT coalesce(rv.reviewed, false) AND model <> '5-LOW' AS unrev, NOT coalesce(rv.reviewed, false) AND model = '5-LOW' AS own FROM r JOIN n ON n.stem = r.stem LEFT JOIN rv ON rv.stem = r.stem),
u AS (SELECT count(*) FILTER (WHERE NOT legacy) AS tickets, count(*) FILTER (WHERE legacy) AS legacy, {', '.join(f"CAST(sum({c}) FILTER (WHERE NOT legacy) AS BIGINT) AS {a}" for c, a in (('comparable', 'comparable'), ('total', 'edits'), ('doc', 'doc'), ('inp', 'inp'), ('polished', 'polished')))},
  count(*) FILTER (WHERE NOT legacy AND total = 0) AS clean, count(*) FILTER (WHERE NOT legacy AND submitted AND unrev) AS unreviewed, count(*) FILTER (WHERE NOT legacy AND submitted AND own) AS self_submit FROM q) """
Q.add(
    "agg_04_full_summary",
    _IN,
    lambda t, f, e: A.accuracy_summary(_summary_rows(t, f, e)).select("tickets", "legacy", "comparable", "edits", "doc", "inp", "polished", "clean", "unreviewed", "self_submit", *[F.round(c, 6).alias(c) for c in ("acc_ticket", "acc_field", "acc_after_review")]),
    _SUMMARY + "SELECT *, round(clean / tickets, 6) AS acc_ticket, round(1 - edits / comparable, 6) AS acc_field, round(1 - inp / comparable, 6) AS acc_after_review FROM u",
)
Q.add("rec_03_review_provenance", _IN, lambda t, f, e: _summary_rows(t, f, e).select("stem", "no_inputter_review", "inputter_self_submit"), _SUMMARY + "SELECT stem, unrev AS no_inputter_review, own AS inputter_self_submit FROM q")
Q.add("agg_08_closure", _IN, lambda t, f, e: (lambda rows: A.closure(A.accuracy_summary(rows), rows.where("NOT legacy")))(_settled_rows(t, f, e)), _SUMMARY + "SELECT tickets + legacy = (SELECT count(*) FROM q WHERE NOT legacy) AS rows_match, comparable = (SELECT sum(comparable) FROM q WHERE NOT legacy) AS columns_match FROM u")
Q.add(
    "src_13_report_tables",
    _IN,
    lambda t, f, e: (lambda r: r["summary"].unionByName(r["fields"].select(F.concat(F.lit("field "), "field").alias("name"), F.col("edits").cast("double").alias("value"))).unionByName(r["tickets"].select(F.concat(F.lit("ticket "), "stem").alias("name"), F.col("total").cast("double").alias("value"))).select("name", F.round("value", 6).alias("value")))(
        (lambda rows: A.report_tables(rows, rows.select("stem", F.inline("cells"))))(_settled_rows(t, f, e))
    ),
    _SUMMARY
    + ", v AS (SELECT *, clean / tickets AS acc_ticket, 1 - edits / comparable AS acc_field, 1 - inp / comparable AS acc_after_review FROM u) "
    + " UNION ALL ".join(f"SELECT '{c}' AS name, round(CAST({c} AS DOUBLE), 6) AS value FROM v" for c in ("tickets", "legacy", "comparable", "edits", "doc", "inp", "polished", "clean", "unreviewed", "self_submit", "acc_ticket", "acc_field", "acc_after_review"))
    + " UNION ALL SELECT 'field ' || field, CAST(count(*) AS DOUBLE) FROM z WHERE changed GROUP BY field UNION ALL SELECT 'ticket ' || stem, CAST(total AS DOUBLE) FROM r",
)
_CONFLICT = "SELECT stem, field, CASE WHEN kind = 'no' THEN 'num' ELSE 'count' END AS \"group\", field || ': ' || CASE WHEN trim(model) = '' THEN 'blank' ELSE trim(model) END || ' / ' || CASE WHEN trim(final) = '' THEN 'blank' ELSE trim(final) END AS flag FROM c WHERE kind IN ('no', 'int', 'num') AND trim(model) <> trim(final)"
Q.add("acc_04_reader_conflicts", ["cells"], lambda c: A.reader_conflicts(_kinded(c)).select("stem", "field", "group"), _C + f"SELECT stem, field, \"group\" FROM ({_CONFLICT})")
Q.add("acc_05_conflict_flags", ["cells"], lambda c: A.reader_conflicts(_kinded(c)).select("stem", "flag"), _C + f"SELECT stem, flag FROM ({_CONFLICT})")
Q.add(
    "acc_06_blank_records",
    ["finals"],
    lambda f: f.select("stem", A.is_blank_record(["SHIPPER"]).alias("no_shipper"), A.is_blank_record(list(FIELDS)).alias("empty")),
    "SELECT stem, trim(SHIPPER) = '' AS no_shipper, false AS empty FROM finals",
)
#: the cells of a record as people see them: flags by number, versions by layer
_SEEN = ["SHIPPER", "COUNTRY", "GOODS", "HAWB_NO"]


def _seen(t, f):
    rows = t.alias("t").join(f.alias("f"), "stem")
    blank = lambda c, k: F.when(F.col("t.num") % k == 0, "").otherwise(F.col(c))
    cell = lambda i, n: F.struct(
        F.lit(n).alias("field"), F.when((F.col("t.num") + i) % 4 == 0, i + 1).otherwise(0).alias("flags"), ((F.col("t.num") + i) % 3 == 0).alias("acked"),
        blank(f"t.{n}", 5 + i).alias("raw"), F.when((F.col("t.num") + i) % 5 == 0, "").otherwise(F.col(f"f.{n}")).alias("air"), ((F.col("t.num") + i) % 7 == 0).alias("skip"))
    return rows.select("stem", F.inline(F.array(*[cell(i, n) for i, n in enumerate(_SEEN)])))


_SEEN_SQL = ", seen AS (" + " UNION ALL ".join(
    f"SELECT t.stem, '{n}' AS field, (t.num + {i}) % 4 = 0 AS flagged, (t.num + {i}) % 3 = 0 AS acked, CASE WHEN t.num % {5 + i} = 0 THEN '' ELSE t.{n} END AS raw, CASE WHEN (t.num + {i}) % 5 = 0 THEN '' ELSE f.{n} END AS air, (t.num + {i}) % 7 = 0 AS skip FROM tickets t JOIN finals f ON t.stem = f.stem"
    for i, n in enumerate(_SEEN)) + """), marked AS (SELECT *, CASE WHEN flagged AND acked THEN 'confirmed' WHEN flagged THEN 'flag' WHEN trim(raw) || trim(air) = '' AND acked THEN 'emptyok' WHEN trim(raw) || trim(air) = '' AND skip THEN 'skipped'
  WHEN trim(raw) || trim(air) = '' THEN 'empty' WHEN trim(air) = '' THEN 'miss' ELSE 'same' END AS status FROM seen) """
Q.add("acc_08_cell_status", ["tickets", "finals"], lambda t, f: A.cell_status(_seen(t, f)).select("stem", "field", "status", "todo"), _SEEN_SQL + "SELECT stem, field, status, status IN ('flag', 'empty') AS todo FROM marked", dealt=("tickets", "finals"))
Q.add("acc_09_accuracy_segments", ["cells"], lambda c: A.accuracy_rows(_kinded(c)).groupBy(A.segment(F.col("total"), F.col("comparable")).alias("seg")).agg(F.count(F.lit(1)).alias("n")), _R + "SELECT CASE WHEN comparable = 0 THEN 'no trace' WHEN total > 0 THEN 'changed' ELSE 'clean' END AS seg, count(*) AS n FROM r GROUP BY 1")
Q.add("flt_05_accuracy_filter", ["cells"], lambda c: A.accuracy_rows(_kinded(c)).where(A.segment(F.col("total"), F.col("comparable")) == "changed").select("stem"), _R + "SELECT stem FROM r WHERE total > 0")
Q.add(
    "agg_04_accuracy_summary",
    ["cells"],
    lambda c: A.accuracy_summary(A.accuracy_rows(_kinded(c))).select("tickets", "comparable", "edits", "clean", F.round("acc_ticket", 6).alias("acc_ticket"), F.round("acc_field", 6).alias("acc_field")),
    _R + "SELECT count(*) AS tickets, CAST(sum(comparable) AS BIGINT) AS comparable, CAST(sum(total) AS BIGINT) AS edits, count(*) FILTER (WHERE total = 0) AS clean, round(count(*) FILTER (WHERE total = 0) / count(*), 6) AS acc_ticket, round(1 - sum(total) / sum(comparable), 6) AS acc_field FROM r",
)
for _n in ("agg_05_edits_by_field", "srt_04_field_ranking"):
    Q.add(_n, ["cells"], lambda c: A.edits_by_field(_kinded(c)), _C + "SELECT field, count(*) AS edits FROM c WHERE changed GROUP BY field")
Q.add(
    "agg_06_accuracy_by",
    ["cells", "tickets"],
    lambda c, t: A.accuracy_by(A.accuracy_rows(_kinded(c)).join(t.select("stem", F.when(F.col("num") % 10 > 0, F.col("model")).otherwise("").alias("who")), "stem"), "who"),
    _R + "SELECT CASE WHEN num % 10 > 0 THEN t.model ELSE '(not recorded)' END AS axis, count(*) AS tickets, CAST(sum(comparable) AS BIGINT) AS comparable, CAST(sum(total) AS BIGINT) AS edits FROM r JOIN tickets t ON t.stem = r.stem GROUP BY 1",
)
Q.add(
    "agg_12_segment_state",
    ["tickets", "finals"],
    lambda t, f: A.segment_state(_seen(t, f), {"HAWB_NO": "numbers", "SHIPPER": "party", "COUNTRY": "party"}),
    _SEEN_SQL + """, g AS (SELECT stem, CASE field WHEN 'HAWB_NO' THEN 'numbers' WHEN 'GOODS' THEN 'other' ELSE 'party' END AS grp, count(*) AS total, count(*) FILTER (WHERE status IN ('flag', 'empty')) AS todo,
      count(*) FILTER (WHERE status = 'flag') AS hard, count(*) FILTER (WHERE status = 'empty') AS soft FROM marked GROUP BY 1, 2)
    SELECT *, total - todo AS cleared, CASE WHEN hard > 0 THEN 'hasflag' WHEN soft > 0 THEN 'hasissue' ELSE 'clear' END AS state FROM g""",
    dealt=("tickets", "finals"),
)
Q.add(
    "set_02_reader_gain_loss",
    ["cells"],
    lambda c: A.reader_gain_loss(_kinded(c)),
    _C + "SELECT stem, count(*) FILTER (WHERE trim(model) = '' AND trim(final) <> '') AS gained, count(*) FILTER (WHERE trim(model) <> '' AND trim(final) = '') AS lost, count(*) FILTER (WHERE trim(model) <> '' AND trim(final) <> '' AND changed) AS changed FROM c GROUP BY stem",
)
