"""Queries of ticket and master state, day ledgers, review gates and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import events as E
from tallyforge.operators import ledger as G
from tallyforge.operators import reconcile as R
from tallyforge.plans.register import Register

Q = Register()
_NO = "regexp_replace(upper({c}), '[^0-9A-Z]', '', 'g')"
_ERROR = "CASE WHEN status = 'P' AND model = '5-LOW' THEN 'OSError: disk' ELSE '' END"
_IN = ["finals", "ticket_events", "ledger", "marks"]
#: the inputs with a row or more for each ticket
_DEALT = ("finals", "ticket_events", "ledger")


def _state(f, e, l, m):  # noqa: E741
    """JN-01 over tickets: read as in ``finals``, staged by ``ticket_events``, sent by ``ledger``, voided by ``marks``."""
    qc = f.select("stem", "num", F.expr(_ERROR).alias("error"), F.concat("CREATE_TIME", F.lit("T08:00:00")).alias("processed_at"), F.concat("stem", F.lit(".pdf")).alias("source_name"), F.length("GOODS").alias("flags"))
    staged = E.fold_stage_events(e, ["mawb", "hawb", "who", "at"]).select("stem", "mawb", "hawb", F.col("who").alias("stager"), F.col("at").alias("staged_at"), "n_staged", "reviewed")
    voids = E.void_current(m).select(F.concat(F.lit("T"), F.substring("key", 2, 20)).alias("stem"), F.col("who").alias("void_by"))
    return G.ticket_state(qc, f.select("stem", F.col("MAWB_NO").alias("mawb"), F.col("HAWB_NO").alias("hawb")), staged, l, voids)


def _touched(e, l):  # noqa: E741
    return E.touched_days([(e, "stem", "who", "at"), (l, "stem", "reviewer", "submitted_at")])


_STATE = f""", g AS (SELECT stem, arg_max(mawb, seq) FILTER (WHERE kind <> 'review') AS mawb, arg_max(hawb, seq) FILTER (WHERE kind <> 'review') AS hawb, arg_max(who, seq) FILTER (WHERE kind <> 'review') AS stager,
  count(*) FILTER (WHERE kind <> 'review') AS n_staged, bool_or(role = 'inputter') AS reviewed FROM ticket_events GROUP BY stem),
vo AS (SELECT 'T' || substr(key, 2) AS stem, arg_max(who, seq) AS void_by FROM marks GROUP BY key HAVING arg_max(action, seq) = 'void'),
b AS (SELECT f.stem, f.num, {_ERROR} AS error, f.CREATE_TIME || 'T08:00:00' AS processed_at, f.stem || '.pdf' AS source_name, length(f.GOODS) AS flags,
  CASE WHEN {_ERROR} <> '' THEN 'failed' WHEN l.stem IS NOT NULL THEN 'submitted' WHEN coalesce(n_staged, 0) > 0 THEN 'staged' ELSE 'parsed' END AS state,
  coalesce(nullif(trim(l.mawb), ''), nullif(trim(g.mawb), ''), nullif(trim(f.MAWB_NO), ''), '') AS mawb, coalesce(nullif(trim(l.hawb), ''), nullif(trim(g.hawb), ''), nullif(trim(f.HAWB_NO), ''), '') AS hawb,
  g.stager, coalesce(g.reviewed, false) AS reviewed, l.reviewer, l.submitted_at, vo.stem IS NOT NULL AS voided
  FROM finals f LEFT JOIN g ON g.stem = f.stem LEFT JOIN ledger l ON l.stem = f.stem LEFT JOIN vo ON vo.stem = f.stem),
tc AS (SELECT stem, who, substr("at", 1, 10) AS day FROM ticket_events UNION SELECT stem, reviewer, substr(submitted_at, 1, 10) FROM ledger) """
Q.add("jn_01_ticket_state", _IN, lambda f, e, l, m: _state(f, e, l, m).select("stem", "state", "mawb", "hawb", "stager", "reviewed", "reviewer", "submitted_at", "voided"), _STATE + "SELECT stem, state, mawb, hawb, stager, reviewed, reviewer, submitted_at, voided FROM b", dealt=_DEALT)

# --- masters -------------------------------------------------------------------------


def _masters(m, t):
    """Masters with a log of one event for each of their tickets, and the ledger of those that were sent."""
    events = t.join(m.select("cust", "mawb"), "cust").select("mawb", F.col("num").alias("seq"), F.concat(F.lit("u"), F.col("num") % 5).alias("who"), F.when(F.col("model") == "1-URGENT", "inputter").otherwise("preparer").alias("role"), F.col("CREATE_TIME").alias("at"), (F.length("GOODS") % 4).alias("n_edits"))
    sent = m.where("sent = 1").select(F.upper(F.regexp_replace("mawb", "-", " ")).alias("mawb"), F.concat(F.lit("u"), F.col("kids") % 3).alias("reviewer"), F.concat("first_day", F.lit("T12:00:00")).alias("submitted_at"))
    return G.master_rows(m.select("mawb", "goods", "first_day", F.col("sent").cast("string").alias("sent"), F.when(F.col("kids") > 15, "timeout").otherwise("").alias("error")), events, sent, ["goods", "first_day", "sent"])


_MASTERS = """, me AS (SELECT cust, max(num) AS seq, arg_max('u' || CAST(num % 5 AS VARCHAR), num) AS stager, arg_max(CASE WHEN model = '1-URGENT' THEN 'inputter' ELSE 'preparer' END, num) AS stager_role, arg_max(length(GOODS) % 4, num) AS edited,
  sum(length(GOODS) % 4) AS edits, bool_or(model = '1-URGENT') AS reviewed, list(DISTINCT CREATE_TIME) AS days FROM tickets GROUP BY cust),
mr AS (SELECT m.mawb, CAST(1 + 1 + CASE WHEN sent IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS filled, stager, stager_role, CAST(edited AS BIGINT) AS edited, CASE WHEN kids > 15 THEN 'failed' WHEN sent = 1 THEN 'submitted' WHEN edits > 0 THEN 'staged' ELSE 'parsed' END AS state,
  reviewed, CASE WHEN sent = 1 THEN 'u' || CAST(kids % 3 AS VARCHAR) END AS reviewer, CASE WHEN sent = 1 THEN first_day || 'T12:00:00' END AS submitted_at, first_day, days FROM masters m JOIN me USING (cust)) """
Q.add("evt_10_master_rows", ["masters", "tickets"], lambda m, t: _masters(m, t).select("mawb", "filled", "stager", "stager_role", "edited", "state", "reviewed", "reviewer", "submitted_at"), _MASTERS + "SELECT mawb, filled, stager, stager_role, edited, state, reviewed, reviewer, submitted_at FROM mr")
_DAY = "1997-06-1"
_HIT = f"(starts_with(processed_at, '{_DAY}') OR starts_with(coalesce(submitted_at, ''), '{_DAY}'))"
Q.add(
    "evt_08_in_day",
    [*_IN, "masters", "tickets"],
    lambda f, e, l, m, ma, t: G.in_day(_state(f, e, l, m), _DAY, "processed_at", "submitted_at").select("stem").unionByName(G.in_day(_masters(ma, t), _DAY, "first_day", "event_days", "submitted_at").select(F.col("mawb").alias("stem"))),
    _STATE + _MASTERS + f"SELECT stem FROM b WHERE {_HIT} UNION ALL SELECT mawb FROM mr WHERE starts_with(first_day, '{_DAY}') OR starts_with(coalesce(submitted_at, ''), '{_DAY}') OR len(list_filter(days, lambda x: starts_with(x, '{_DAY}'))) > 0",
    dealt=_DEALT,
)
_SCOPES = [("mine", "preparer"), ("all", "reviewer"), ("toreview", "inputter"), ("reviewed", "admin"), ("reviewed", "preparer")]
_BY_DAY = "1997-06-10"


def _scopes(f, e, l, m):  # noqa: E741
    rows, touched, out = _state(f, e, l, m), _touched(e, l), None
    for scope, role in _SCOPES:
        part = G.day_scope(rows, touched, scope, "u3", role, _BY_DAY, "processed_at", "submitted_at").select(F.lit(f"{scope} {role}").alias("scope"), "stem")
        out = part if out is None else out.unionByName(part)
    return out


_TODAY = f"(starts_with(processed_at, '{_BY_DAY}') OR starts_with(coalesce(submitted_at, ''), '{_BY_DAY}'))"
_MINE = f"{_TODAY} AND stem IN (SELECT stem FROM tc WHERE who = 'u3' AND day = '{_BY_DAY}')"
Q.add(
    "evt_09_day_scope",
    _IN,
    _scopes,
    _STATE + " UNION ALL ".join(f"SELECT '{n}' AS scope, stem FROM b WHERE {w}" for n, w in (("mine preparer", _MINE), ("all reviewer", _TODAY), ("toreview inputter", "submitted_at IS NULL AND NOT voided AND NOT reviewed"), ("reviewed admin", "submitted_at IS NULL AND NOT voided AND reviewed"), ("reviewed preparer", _MINE))),
    dealt=_DEALT,
)


def _header(f, e, l, m):  # noqa: E741
    rows, touched = _state(f, e, l, m), _touched(e, l)
    day = G.in_day(rows, _DAY, "processed_at", "submitted_at")
    return G.day_header(day, day.where("reviewed"), rows, touched, "u3")


Q.add(
    "agg_15_day_header",
    _IN,
    _header,
    _STATE + f"""SELECT coalesce((SELECT string_agg(DISTINCT reviewer, ',' ORDER BY reviewer) FROM b WHERE {_HIT} AND reviewed), '') AS reviewers, (SELECT count(*) FROM b WHERE {_HIT} AND reviewed) AS shown, (SELECT count(*) FROM b WHERE {_HIT} AND NOT reviewed) AS others,
    (SELECT max(greatest(substr(processed_at, 1, 10), substr(coalesce(submitted_at, ''), 1, 10))) FROM b) AS machine_last_day, (SELECT max(day) FROM tc WHERE who = 'u3') AS last_day""",
    dealt=_DEALT,
)

# --- filters, searches, gates ------------------------------------------------------------
_MODES = {"unsent": "submitted_at IS NULL", "flag": "flags > 0", "done": "submitted_at IS NOT NULL", "other": "true"}
Q.add("flt_04_ledger_filter", _IN, lambda f, e, l, m: G.ledger_modes(_state(f, e, l, m), list(_MODES)).select("mode", "stem"), _STATE + " UNION ALL ".join(f"SELECT '{k}' AS mode, stem FROM b WHERE {w}" for k, w in _MODES.items()), dealt=_DEALT)
_FOUND = ("000012", "T12", "h-12", "12 5")


def _each_search(rows):
    out = None
    for query in _FOUND:
        part = G.number_search(rows, query).select(F.lit(query).alias("query"), "stem")
        out = part if out is None else out.unionByName(part)
    return out


_LIKE = lambda q: "(" + " OR ".join(f"contains({_NO.format(c=c)}, '{q}')" if len(q) >= 5 else f"{_NO.format(c=c)} = '{q}'" for c in ("mawb", "hawb", "stem", "source_name")) + ")"
Q.add("flt_07_number_search", _IN, lambda f, e, l, m: _each_search(_state(f, e, l, m)), _STATE + " UNION ALL ".join(f"SELECT '{q}' AS query, stem FROM b WHERE {_LIKE(''.join(x for x in q.upper() if x.isalnum()))}" for q in _FOUND), dealt=_DEALT)
_NOW = "2000-06-01"


def _aged(f, e, l, m):  # noqa: E741
    rows = _state(f, e, l, m).withColumn("touched", R.last_touched(F.coalesce("submitted_at", "processed_at"), F.lit("?")))
    return R.retention_candidates(rows, "touched", _NOW, 1000).select("*", F.col("stem").alias("key"), F.when(F.col("voided"), F.col("stager")).alias("void_by"), F.when(F.col("num") % 5 > 0, F.col("num")).alias("bytes"))


_AGED = f", c AS (SELECT *, date_diff('day', CAST(substr(coalesce(submitted_at, processed_at), 1, 10) AS DATE), DATE '{_NOW}') >= 1000 AS aged, CASE WHEN voided THEN stager END AS void_by, CASE WHEN num % 5 > 0 THEN num END AS bytes FROM b) "
_ASKED = (("", "early"), ("0-0000", "aged"), ("t-12", "all"), ("u3", "all"))
_TEXT = lambda q: " OR ".join(f"contains(upper(coalesce({c}, '')), '{q.upper()}') OR contains(regexp_replace(upper(coalesce({c}, '')), '[^0-9A-Z]', '', 'g'), '{''.join(x for x in q.upper() if x.isalnum())}')" for c in ("mawb", "hawb", "stem", "void_by"))


def _each_ask(rows):
    out = None
    for query, mode in _ASKED:
        part = G.retention_filter(rows, query, mode).select(F.lit(f"{query} {mode}").alias("asked"), "stem")
        out = part if out is None else out.unionByName(part)
    return out


Q.add(
    "flt_06_retention_filter",
    _IN,
    lambda f, e, l, m: _each_ask(_aged(f, e, l, m)),
    _STATE + _AGED.replace(", c AS", ", c AS", 1) + " UNION ALL ".join(f"SELECT '{q} {k}' AS asked, stem FROM c WHERE ({'true' if k == 'all' else 'aged' if k == 'aged' else 'NOT aged'}) AND ({_TEXT(q) if q else 'true'})" for q, k in _ASKED),
    dealt=_DEALT,
)
Q.add("agg_13_retention_totals", _IN, lambda f, e, l, m: G.retention_sum(_aged(f, e, l, m).where("aged")), _STATE + _AGED + "SELECT count(*) AS n, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes FROM c WHERE aged", dealt=_DEALT)
Q.add(
    "ret_06_run_state",
    ["qc"],
    lambda q: G.purge_run_state(q.select(F.col("stem").alias("key"), (F.col("error") == "").alias("ok"), "error")).select("checked", "removed", "failed", F.array_join("errors", "|").alias("errors")),
    "SELECT count(*) AS checked, count(*) FILTER (WHERE error = '') AS removed, count(*) FILTER (WHERE error <> '') AS failed, (SELECT string_agg(e, '|' ORDER BY stem) FROM (SELECT stem, stem || ': ' || error AS e FROM qc WHERE error <> '' ORDER BY stem LIMIT 8)) AS errors FROM qc",
)
Q.add(
    "rec_02_master_gate",
    ["masters"],
    lambda m: m.select("mawb", G.master_gate(F.when(F.col("kids") > 4, F.col("goods")).otherwise(" "), F.array(F.col("goods"), F.col("first_day")), F.when(F.col("sent") == 1, F.array(F.col("first_day"), F.col("goods"))).otherwise(F.array(F.col("goods")))).alias("verdict")),
    "SELECT mawb, CASE WHEN kids <= 4 THEN 'no signer' WHEN sent = 1 THEN 'pass' ELSE 'flags' END AS verdict FROM masters",
)
