"""Queries of event folding, ledgers and the board."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import events as E
from tallyforge.plans.bindings import FIELDS
from tallyforge.plans.bindings import prelude
from tallyforge.plans.register import Register
from tallyforge.plans.report_queries import SUPPRESSED

Q = Register()
_LAST = "arg_max({c}, seq) FILTER (WHERE kind <> 'review')"

Q.add(
    "evt_02_field_diff",
    ["tickets", "finals"],
    lambda t, f: t.select("stem", F.struct(*FIELDS).alias("a")).join(f.select("stem", F.struct(*FIELDS).alias("b")), "stem").select("stem", E.field_diff("a", "b", FIELDS).alias("d")).select("stem", F.array_join(F.array_sort(F.map_keys("d")), ",").alias("fields"), F.size("d").cast("long").alias("n")).where("n > 0"),
    """, d AS (SELECT t.stem, CASE WHEN t.num % 7 = 4 THEN 'COUNTRY' END AS a, CASE WHEN t.num % 13 = 5 THEN 'GOODS' END AS b, CASE WHEN t.num % 11 = 3 THEN 'PIECES' END AS c, CASE WHEN t.num % 7 = 5 THEN 'SHIPPER' WHEN t.num % 7 = 6 THEN 'SHIPPER' END AS e FROM tickets t)
    SELECT stem, array_to_string(list_filter([a, b, c, e], lambda x: x IS NOT NULL), ',') AS fields, CAST(len(list_filter([a, b, c, e], lambda x: x IS NOT NULL)) AS BIGINT) AS n FROM d WHERE coalesce(a, b, c, e) IS NOT NULL""",
)
Q.add(
    "evt_03_fold_stage_events",
    ["stage_events"],
    lambda e: E.fold_stage_events(e, ["weight", "goods"]).select("stem", "weight", "goods", "n_events", "n_staged", "staged", "last_who"),
    f"SELECT stem, {_LAST.format(c='weight')} AS weight, {_LAST.format(c='goods')} AS goods, count(*) AS n_events, count(*) FILTER (WHERE kind <> 'review') AS n_staged, count(*) FILTER (WHERE kind <> 'review') > 0 AS staged, arg_max(who, seq) AS last_who FROM stage_events GROUP BY stem",
)
Q.add(
    "evt_04_review_marks",
    ["stage_events"],
    lambda e: E.fold_stage_events(e, []).select("stem", "staged", "reviewed"),
    "SELECT stem, bool_or(kind <> 'review') AS staged, bool_or(role = 'inputter') AS reviewed FROM stage_events GROUP BY stem",
)
Q.add(
    "evt_05_record_state",
    ["qc"],
    lambda q: q.select("stem", E.derive_state(F.col("error"), F.col("num") % 3 == 0, F.col("num") % 2 == 0).alias("state")),
    "SELECT stem, CASE WHEN trim(error) <> '' THEN 'failed' WHEN num % 3 = 0 THEN 'submitted' WHEN num % 2 = 0 THEN 'staged' ELSE 'parsed' END AS state FROM qc",
)
Q.add(
    "evt_06_touched_days",
    ["stage_events"],
    lambda e: E.touched_days([(e, "stem", "who", "at")]).groupBy("stem", "who").agg(F.count("day").alias("days")),
    "SELECT stem, who, count(DISTINCT substr(\"at\", 1, 10)) AS days FROM stage_events GROUP BY stem, who",
)
Q.add(
    "evt_07_owned",
    ["stage_events"],
    lambda e: E.owned(e.select("stem").distinct(), E.touched_days([(e, "stem", "who", "at")]), "u3", None),
    "SELECT DISTINCT stem FROM stage_events WHERE who = 'u3'",
)
Q.add("evt_11_void_current", ["marks"], E.void_current, "SELECT kind, key, arg_max(who, seq) AS who FROM marks GROUP BY kind, key HAVING arg_max(action, seq) = 'void'")
Q.add("evt_12_unlock_log", ["marks"], E.unlock_log, "SELECT kind, key, count(*) AS n, arg_max(who, seq) AS last_who, max(seq) AS last_seq FROM marks GROUP BY kind, key")
Q.add(
    "evt_13_apply_submissions",
    ["ledger"],
    lambda l: E.apply_submissions(l.where("num % 3 <> 0"), l.where("num % 2 = 0").withColumn("submitted_at", F.concat(F.substring("submitted_at", 1, 10), F.lit("T12:00:00")))).select("stem", "submitted_at"),
    "SELECT stem, CASE WHEN num % 2 = 0 THEN substr(submitted_at, 1, 10) || 'T12:00:00' ELSE submitted_at END AS submitted_at FROM ledger WHERE num % 2 = 0 OR num % 3 <> 0",
)
Q.add(
    "evt_14_row_numbers",
    ["finals", "ledger"],
    lambda f, l: f.join(l.select("stem", F.col("mawb").alias("lm")), "stem", "left").select("stem", F.coalesce(F.nullif(F.trim("lm"), F.lit("")), F.nullif(F.trim("MAWB_NO"), F.lit(""))).alias("mawb")),
    "SELECT f.stem, coalesce(nullif(trim(l.mawb), ''), nullif(trim(f.MAWB_NO), '')) AS mawb FROM finals f LEFT JOIN ledger l ON l.stem = f.stem",
)
Q.add(
    "win_01_previous_version",
    ["stage_events"],
    lambda e: E.with_previous(e, ["weight"]).select("stem", "seq", "weight", "prev_weight"),
    "SELECT stem, seq, weight, lag(weight) OVER (PARTITION BY stem ORDER BY seq) AS prev_weight FROM stage_events",
)
Q.add(
    "win_02_baseline",
    ["stage_events"],
    lambda e: E.with_baseline(e, ["goods"]).select("stem", "seq", "base_goods"),
    "SELECT stem, seq, first_value(goods) OVER (PARTITION BY stem ORDER BY seq) AS base_goods FROM stage_events",
)
Q.add(
    "win_04_cluster_order",
    ["tickets"],
    lambda t: E.cluster_order(t.select("stem", "num", "cust"), "cust", "num", F.col("num") % 5 == 0).select("stem", "first_pos", "kind_rank"),
    "SELECT stem, min(num) OVER (PARTITION BY cust) AS first_pos, CASE WHEN num % 5 = 0 THEN 0 ELSE 1 END AS kind_rank FROM tickets",
)
Q.add(
    "win_06_stable_files",
    ["scans"],
    lambda s: E.stable_files(s).select("name", "scan", "stable"),
    "SELECT name, scan, coalesce(lag(size) OVER w = size AND lag(mtime) OVER w = mtime, false) AS stable FROM scans WINDOW w AS (PARTITION BY name ORDER BY scan)",
)
Q.add(
    "win_07_retry_cap",
    ["scans"],
    lambda s: E.retry_state(s, 3),
    ", g AS (SELECT name, max(scan) FILTER (WHERE ok = 1) AS last_ok FROM scans GROUP BY name) SELECT s.name, count(*) FILTER (WHERE ok = 0 AND scan > coalesce(last_ok, -1)) AS failures, count(*) FILTER (WHERE ok = 0 AND scan > coalesce(last_ok, -1)) >= 3 AS given_up FROM scans s JOIN g USING (name) GROUP BY s.name",
)
Q.add(
    "rec_05_suppress_repeats",
    ["scans"],
    lambda s: E.suppress_repeats(s.select(F.col("name").alias("key"), F.col("scan").alias("at"), F.col("size").cast("string").alias("fp"), (F.col("ok") == 1).alias("ok")), 500),
)
Q.oracles["rec_05_suppress_repeats"] = prelude("scans").replace("WITH ", "WITH RECURSIVE ", 1) + SUPPRESSED
Q.add("brd_01_board_current", ["board_events"], E.board_current, "SELECT id, arg_min(who, seq) AS who, coalesce(arg_max(status, seq) FILTER (WHERE action = 'decide'), 'open') AS status, bool_or(action = 'retract') AS retracted, count(*) FILTER (WHERE action = 'edit') AS edits FROM board_events GROUP BY id")
_BOARD = ", b AS (SELECT id, arg_min(who, seq) AS who, coalesce(arg_max(status, seq) FILTER (WHERE action = 'decide'), 'open') AS status, bool_or(action = 'retract') AS retracted FROM board_events GROUP BY id) "
Q.add("brd_02_board_listing", ["board_events"], lambda b: E.board_current(b).orderBy(F.desc("id")).select("id", "status", "retracted", (F.col("who") == "u2").alias("mine")), _BOARD + "SELECT id, status, retracted, who = 'u2' AS mine FROM b")
_COLUMNS = ["GOODS", "SHIPPER"]
_BOARD_LOG = """, own AS (SELECT *, trim(text) AS body, CASE
    WHEN action IN ('add', 'edit') AND trim(text) = '' THEN 'empty' WHEN action IN ('add', 'edit') AND length(trim(text)) > 2000 THEN 'too long'
    WHEN action = 'add' AND trim(field) NOT IN ('', 'GOODS', 'SHIPPER') THEN 'unknown column' WHEN action = 'add' AND trim(who) = '' THEN 'unsigned'
    WHEN action = 'decide' AND status NOT IN ('open', 'adopted', 'declined', 'later') THEN 'unknown status' WHEN action = 'decide' AND trim(note) = '' THEN 'no reason'
    WHEN action = 'decide' AND (length(trim(note)) > 200 OR length(ref) > 60) THEN 'too long' END AS fault FROM board_log),
  born AS (SELECT id, min(seq) AS made FROM own WHERE action = 'add' AND fault IS NULL GROUP BY id),
  died AS (SELECT o.id, min(seq) AS gone FROM own o JOIN born b ON o.id = b.id WHERE action = 'retract' AND seq > made GROUP BY o.id),
  judged AS (SELECT o.*, CASE WHEN fault IS NOT NULL THEN fault WHEN action = 'add' AND seq > made THEN 'there already' WHEN action <> 'add' AND (made IS NULL OR seq < made) THEN 'missing'
    WHEN action <> 'retract' AND seq > gone THEN 'retracted' END AS reason FROM own o LEFT JOIN born b ON o.id = b.id LEFT JOIN died d ON o.id = d.id),
  texts AS (SELECT id, seq, lag(body) OVER (PARTITION BY id ORDER BY seq) AS before FROM judged WHERE reason IS NULL AND action IN ('add', 'edit')) """
Q.add("brd_03_event_validity", ["board_log"], lambda b: E.board_apply(b, _COLUMNS).select("id", "seq", "accepted", "reason", "old_text"),
      _BOARD_LOG + "SELECT j.id, j.seq, reason IS NULL AS accepted, reason, CASE WHEN action = 'edit' AND before <> body THEN before END AS old_text FROM judged j LEFT JOIN texts t ON j.id = t.id AND j.seq = t.seq")
Q.add("brd_03_rejects", ["board_log"], lambda b: E.board_apply(b, _COLUMNS).where("NOT accepted").groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n")), _BOARD_LOG + "SELECT action, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2")
Q.add("brd_03_comments", ["board_log"], lambda b: E.board_state(E.board_apply(b, _COLUMNS)).select("id", "text", F.array_join("revised", "|").alias("revised"), "status", "retracted"),
      _BOARD_LOG + """SELECT j.id, arg_max(body, j.seq) FILTER (WHERE action IN ('add', 'edit')) AS text, coalesce(string_agg(before, '|' ORDER BY j.seq) FILTER (WHERE action = 'edit' AND before <> body), '') AS revised,
      coalesce(arg_max(status, j.seq) FILTER (WHERE action = 'decide'), 'open') AS status, bool_or(action = 'retract') AS retracted FROM judged j LEFT JOIN texts t ON j.id = t.id AND j.seq = t.seq WHERE reason IS NULL GROUP BY j.id""")
Q.add("brd_04_board_filter", ["board_events"], lambda b: E.board_filter(E.board_current(b), "adopted", "u2").select("id", "who"), _BOARD + "SELECT id, who FROM b WHERE status = 'adopted' AND NOT retracted")
Q.add(
    "agg_11_board_counts",
    ["board_events"],
    lambda b: E.board_current(b).agg(*[F.count_if((F.col("status") == s) & ~F.col("retracted")).alias(s) for s in ("open", "adopted", "declined", "later")], F.count_if("retracted").alias("retracted"), F.count_if(F.col("who") == "u2").alias("mine")),
    _BOARD + "SELECT count(*) FILTER (WHERE status = 'open' AND NOT retracted) AS open, count(*) FILTER (WHERE status = 'adopted' AND NOT retracted) AS adopted, count(*) FILTER (WHERE status = 'declined' AND NOT retracted) AS declined, count(*) FILTER (WHERE status = 'later' AND NOT retracted) AS later, count(*) FILTER (WHERE retracted) AS retracted, count(*) FILTER (WHERE who = 'u2') AS mine FROM b",
)
Q.add("flt_02_exclude_voided", ["marks"], lambda m: E.exclude_voided(m.select("key").distinct(), E.void_current(m), "key", "house"), "SELECT key FROM marks GROUP BY key HAVING arg_max(action, seq) <> 'void'")
