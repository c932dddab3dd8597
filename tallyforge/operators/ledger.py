"""Ticket and master state, day ledgers, review gates and searches over them (JN-01, EVT-08 to EVT-10, FLT-04 to FLT-07, REC-02, REC-03).

Rows come from joins on the record's key; a log is folded before it is joined, so each join has one row a key on its right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import events as E


def _day(when: str) -> Column:
    return F.substring(F.coalesce(F.col(when), F.lit("")), 1, 10)


def ticket_state(qc: DataFrame, records: DataFrame, staged: DataFrame, ledger: DataFrame, voids: DataFrame) -> DataFrame:
    """JN-01: a row for each record read, with what is known of it from its values, staging, submission and voiding.

    ``records``: ``stem, mawb, hawb`` as read; ``staged``: ``stem, mawb, hawb, stager, staged_at, n_staged, reviewed``;
    ``ledger``: ``stem, mawb, hawb, reviewer, submitted_at``; ``voids``: ``stem, void_by``. Numbers are the ledger's, else
    the staged ones, else those read.
    """
    named = lambda df, tag, *cols: df.select("stem", *[F.col(c).alias(f"{tag}_{c}") for c in cols])
    rows = qc.join(named(records, "r", "mawb", "hawb"), "stem", "left").join(named(staged, "s", "mawb", "hawb", "stager", "staged_at", "n_staged", "reviewed"), "stem", "left")
    rows = rows.join(named(ledger, "l", "mawb", "hawb", "reviewer", "submitted_at"), "stem", "left").join(voids.select("stem", "void_by"), "stem", "left")
    filled = lambda c: F.nullif(T.strip(F.col(c)), F.lit(""))
    state = E.derive_state(F.col("error"), F.col("l_submitted_at").isNotNull(), F.coalesce(F.col("s_n_staged"), F.lit(0)) > 0)
    return rows.select(
        *qc.columns,
        state.alias("state"),
        *[F.coalesce(filled(f"l_{n}"), filled(f"s_{n}"), filled(f"r_{n}"), F.lit("")).alias(n) for n in ("mawb", "hawb")],
        F.col("s_stager").alias("stager"),
        F.col("s_staged_at").alias("staged_at"),
        F.coalesce("s_reviewed", F.lit(False)).alias("reviewed"),
        F.col("l_reviewer").alias("reviewer"),
        F.col("l_submitted_at").alias("submitted_at"),
        F.col("void_by").isNotNull().alias("voided"),
    )


def in_day(rows: DataFrame, day: str, *times: str) -> DataFrame:
    """EVT-08: rows for which one of ``times`` (texts, or arrays of them) falls on the day; no day passes everything.

    House rows take the times of reading and sending; master rows those of update, start, every event and sending.
    """
    if not day:
        return rows
    hits = [F.exists(c, lambda x: F.startswith(x, F.lit(day))) if dict(rows.dtypes)[c].startswith("array") else F.startswith(F.coalesce(F.col(c), F.lit("")), F.lit(day)) for c in times]
    found = hits[0]
    for h in hits[1:]:
        found = F.coalesce(found, F.lit(False)) | F.coalesce(h, F.lit(False))
    return rows.where(found)


def scope_of(scope: str, role: str, search: bool = False) -> str:
    """EVT-09: the scope a role gets: review lists are for admins and inputters, all rows for them and reviewers; others get their own."""
    all_ok, review_ok = role in ("admin", "inputter", "reviewer"), role in ("admin", "inputter")
    want = scope.strip().lower() or ("all" if all_ok and search else "mine")
    allowed = {"mine": True, "all": all_ok, "toreview": review_ok, "reviewed": review_ok}
    return want if allowed.get(want) else "mine"


def day_scope(rows: DataFrame, touched: DataFrame, scope: str, who: str, role: str, day: str | None, *times: str) -> DataFrame:
    """EVT-09: rows of a scope. Review scopes look at every day: not sent, not voided, and reviewed or not."""
    got = scope_of(scope, role)
    if got in ("toreview", "reviewed"):
        return rows.where(F.col("submitted_at").isNull() & ~F.col("voided") & (F.col("reviewed") == F.lit(got == "reviewed")))
    today = in_day(rows, day or "", *times)
    return today if got == "all" else E.owned(today, touched, who, day)


def day_header(day_rows: DataFrame, shown: DataFrame, everything: DataFrame, touched: DataFrame, who: str | None) -> DataFrame:
    """AGG-15: one row: reviewers of the shown rows, how many of the day's rows are others', latest active day of all and of a person."""
    reviewers = shown.agg(F.array_join(F.array_sort(F.collect_set(F.nullif("reviewer", F.lit("")))), ",").alias("reviewers"), F.count(F.lit(1)).alias("shown"))
    total = day_rows.agg(F.count(F.lit(1)).alias("day_rows"))
    last = everything.agg(F.max(F.greatest(_day("processed_at"), _day("submitted_at"))).alias("machine_last_day"))
    own = touched.where(F.col("who") == F.lit(who)).agg(F.max("day").alias("last_day"))
    # four aggregates of one row each
    one = reviewers.crossJoin(total).crossJoin(last).crossJoin(own)
    return one.select("reviewers", "shown", (F.col("day_rows") - F.col("shown")).alias("others"), "machine_last_day", "last_day")


def master_rows(masters: DataFrame, events: DataFrame, ledger: DataFrame, columns: list[str]) -> DataFrame:
    """EVT-10: a row for each master (``mawb``, its columns, ``error``): filled columns, the last event's actor and role, how
    many columns that event edited, state, review and the days it was touched.

    ``events``: ``mawb, seq, who, role, at, n_edits``; ``ledger``: ``mawb, reviewer, submitted_at``. Numbers meet in normal form.
    """
    last = F.max_by(F.struct("who", "role", "n_edits"), "seq")
    folded = events.groupBy(T.norm_no(F.col("mawb")).alias("_no")).agg(
        last.alias("e"), F.sum("n_edits").alias("_edits"), F.bool_or((F.col("role") == "inputter")).alias("_reviewed"), F.sort_array(F.collect_set(F.substring("at", 1, 10))).alias("event_days")
    )
    sent = ledger.groupBy(T.norm_no(F.col("mawb")).alias("_no")).agg(F.max_by("reviewer", "submitted_at").alias("reviewer"), F.max("submitted_at").alias("submitted_at"))
    filled = sum((T.text(F.col(c)).rlike(r"\S").cast("int") for c in columns), F.lit(0))
    rows = masters.withColumn("_no", T.norm_no(F.col("mawb"))).join(folded, "_no", "left").join(sent, "_no", "left")
    return rows.select(
        *masters.columns,
        filled.cast("long").alias("filled"),
        F.col("e.who").alias("stager"),
        F.col("e.role").alias("stager_role"),
        F.coalesce(F.col("e.n_edits").cast("long"), F.lit(0).cast("long")).alias("edited"),
        E.derive_state(F.col("error"), F.col("submitted_at").isNotNull(), F.coalesce("_edits", F.lit(0)) > 0).alias("state"),
        F.coalesce("_reviewed", F.lit(False)).alias("reviewed"),
        "event_days",
        "reviewer",
        "submitted_at",
    )


def _ledger_tests() -> dict[str, Column]:
    return {"unsent": F.col("submitted_at").isNull(), "flag": F.coalesce(F.col("flags"), F.lit(0)) > 0, "done": F.col("submitted_at").isNotNull()}


def ledger_filter(rows: DataFrame, mode: str) -> DataFrame:
    """FLT-04: not sent, flagged or sent rows; any other mode passes everything."""
    tests = _ledger_tests()
    return rows.where(tests[mode]) if mode in tests else rows


def ledger_modes(rows: DataFrame, modes: list[str]) -> DataFrame:
    """FLT-04 for several modes at once: ``mode`` and the rows it passes. ``rows`` are computed once for all modes."""
    tests = _ledger_tests()
    passed = F.array_compact(F.array(*[F.when(tests.get(m, F.lit(True)), F.lit(m)) for m in modes]))
    return rows.select(F.explode(passed).alias("mode"), "*")


def retention_filter(rows: DataFrame, query: str = "", mode: str = "all") -> DataFrame:
    """FLT-06: ``aged`` or ``early`` candidates (unknown ages only under all), then those with the query in one of five columns,
    as it is or by letters and digits alone."""
    if mode in ("aged", "early"):
        rows = rows.where(F.col("aged") == F.lit(mode == "aged"))
    wanted = query.strip().upper()
    if not wanted:
        return rows
    flat = "".join(c for c in wanted if c.isascii() and c.isalnum())
    shown = [F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("key", "mawb", "hawb", "stem", "void_by")]
    hit = F.lit(False)
    for t in shown:
        hit = hit | F.contains(t, F.lit(wanted))
        if flat:
            hit = hit | F.contains(F.regexp_replace(t, "[^0-9A-Z]", ""), F.lit(flat))
    return rows.where(hit)


def number_search(rows: DataFrame, query: str) -> DataFrame:
    """FLT-07: rows with the normal form of the query in one of four columns: as the whole value, from five characters on as a part of it."""
    wanted = "".join(c for c in query.upper() if c.isascii() and c.isalnum())
    if not wanted:
        return rows
    hit = F.lit(False)
    for c in ("mawb", "hawb", "stem", "source_name"):
        no = T.norm_no(F.col(c))
        hit = hit | (F.contains(no, F.lit(wanted)) if len(wanted) >= 5 else no == F.lit(wanted))
    return rows.where(F.coalesce(hit, F.lit(False)))


def retention_sum(candidates: DataFrame) -> DataFrame:
    """AGG-13: number and bytes; unknown sizes count as 0."""
    return candidates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("bytes"))


def purge_run_state(results: DataFrame, shown: int = 8) -> DataFrame:
    """RET-06: checked, removed and failed results (``key, ok, error``) and the first errors by key. Only ``shown`` texts are gathered."""
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    counts = results.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~bad).alias("removed"), F.count_if(bad).alias("failed"))
    first = results.where(bad).select("key", F.concat("key", F.lit(": "), F.coalesce("error", F.lit(""))).alias("e")).orderBy("key").limit(shown)
    errors = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "e"))), lambda x: x["e"]).alias("errors"))
    return counts.crossJoin(errors)


def master_gate(reviewer: Column, flags: Column, acked: Column) -> Column:
    """REC-02: a master needs a signer, then every flag acknowledged by its exact text."""
    left = F.array_except(F.coalesce(flags, F.array().cast("array<string>")), F.coalesce(acked, F.array().cast("array<string>")))
    return F.when(T.blank(reviewer), "no signer").when(F.size(left) > 0, "flags").otherwise("pass")


def review_provenance(reviewed: Column, submitter_role: Column) -> Column:
    """REC-03: ``inputter_self_submit`` if an inputter sends what no inputter has reviewed; ``no_inputter_review`` if another does."""
    mine = ~F.coalesce(reviewed, F.lit(False))
    own = F.coalesce(submitter_role == "inputter", F.lit(False))
    return F.struct((mine & ~own).alias("no_inputter_review"), (mine & own).alias("inputter_self_submit"))
