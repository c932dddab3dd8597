"""Folding of event logs into current state (EVT-*, WIN-*, BRD-*, REC-05)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.functions import text as T


def field_diff(old: str, new: str, kinds: dict[str, str]) -> Column:
    """EVT-02: map of changed fields to ``from``/``to``, from two structs or maps of the same names."""
    entries = [F.struct(F.lit(f).alias("k"), T.text(F.col(f"{old}.{f}")).alias("from"), T.text(F.col(f"{new}.{f}")).alias("to"), T.same_value(F.lit(k), F.col(f"{old}.{f}"), F.col(f"{new}.{f}")).alias("same")) for f, k in kinds.items()]
    changed = F.filter(F.array(*entries), lambda x: ~x["same"])
    return F.map_from_arrays(F.transform(changed, lambda x: x["k"]), F.transform(changed, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))))


def with_previous(events: DataFrame, columns: list[str], key: str = "stem", order: str = "seq") -> DataFrame:
    """WIN-01: ``prev_<c>``, the value in the record's event before; null at its first event."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def with_baseline(events: DataFrame, columns: list[str], key: str = "stem", order: str = "seq") -> DataFrame:
    """WIN-02: ``base_<c>``, the first non-null value of the record, untouched by later ones.

    An aggregate that each task combines before the shuffle, joined back: no task has to hold all events of a key.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"base_{c}")
    return events.join(events.groupBy(key).agg(*[first(c) for c in columns]), key, "left")


def fold_stage_events(events: DataFrame, columns: list[str], key: str = "stem", order: str = "seq") -> DataFrame:
    """EVT-03, EVT-04, WIN-05: current state per record from its log.

    The last staging event gives the values; review marks count as reviewed by their role but never stage a record.
    Every aggregate is partial on the map side, so a record with very many events costs one row per task.
    """
    staged = F.col("kind") != "review"
    last = lambda c: F.max_by(F.when(staged, F.col(c)), F.when(staged, F.col(order)))
    return events.groupBy(key).agg(
        *[last(c).alias(c) for c in columns],
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(staged).alias("n_staged"),
        (F.count_if(staged) > 0).alias("staged"),
        F.bool_or(F.col("role") == "inputter").alias("reviewed"),
        F.max_by("who", order).alias("last_who"),
        F.max("at").alias("last_at"),
    )


def event_diffs(events: DataFrame, model: DataFrame, kinds: dict[str, str], key: str = "stem", order: str = "seq") -> DataFrame:
    """EVT-03: ``key, order, role, field, from, to, rule``: what each staging event changed against the one before, the first
    against ``model`` (a row a key). ``rule`` is the event's ``rule_<field>``, kept on changed columns alone; null without one.
    """
    before = with_previous(events.where(F.col("kind") != "review"), list(kinds), key, order)
    base = model.select(key, F.struct(*kinds).alias("_base"))
    rows = before.join(base, key, "left").withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1)
    cells = [
        F.struct(
            F.lit(f).alias("field"),
            T.text(F.when(F.col("_first"), F.col(f"_base.{f}")).otherwise(F.col(f"prev_{f}"))).alias("from"),
            T.text(F.col(f)).alias("to"),
            (F.nullif(T.strip(F.col(f"rule_{f}")), F.lit("")) if f"rule_{f}" in events.columns else F.lit(None).cast("string")).alias("rule"),
            F.lit(k).alias("_kind"),
        )
        for f, k in kinds.items()
    ]
    long = rows.select(key, order, "role", F.inline(F.array(*cells)))
    return long.where(~T.same_value(F.col("_kind"), F.col("from"), F.col("to"))).drop("_kind")


def last_touchers(diffs: DataFrame, key: str = "stem", order: str = "seq") -> DataFrame:
    """WIN-05: per record and column: who touched it, by role, and the rule of the last event that did (null: a person's own change)."""
    return diffs.groupBy(key, "field").agg(
        F.max_by("rule", order).alias("rule"),
        F.bool_or(F.coalesce(F.col("role"), F.lit("")) == "inputter").alias("by_inputter"),
        F.bool_or(F.coalesce(F.col("role"), F.lit("")) != "inputter").alias("by_preparer"),
    )


def folded_touches(events: DataFrame, kinds: dict[str, str], key: str = "stem", order: str = "seq") -> DataFrame:
    """EVT-03, WIN-05 in one pass over the log: ``fold_stage_events``' values, ``staged`` and ``reviewed``, and what
    ``last_touchers`` needs of the changes. A row a record.

    ``first`` is the first staging event: its change is known once the record's model is (``touches``). ``later_<c>`` is what
    later ones changed: ``rule`` of the last change, ``inp`` and ``doc``; null ``rule`` without a change.
    """
    staged = F.col("kind") != "review"
    values = F.struct(*[T.text(F.col(c)).alias(c) for c in kinds])
    w = Window.partitionBy(key).orderBy(order)
    before = F.last(F.when(staged, values), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rule = lambda f: (F.nullif(T.strip(F.col(f"rule_{f}")), F.lit("")) if f"rule_{f}" in events.columns else F.lit(None).cast("string")).alias(f"rule_{f}")
    rows = events.withColumn("_before", before).withColumn("_inp", F.coalesce(F.col("role"), F.lit("")) == "inputter")
    rows = rows.withColumns({f"_d_{f}": staged & F.col("_before").isNotNull() & ~T.same_value(F.lit(k), F.col(f"_before.{f}"), F.col(f)) for f, k in kinds.items()})
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    last = lambda c: F.max_by(F.when(staged, F.col(c)), F.when(staged, F.col(order)))
    later = lambda f: F.struct(F.max_by(F.struct(rule(f)), F.when(F.col(f"_d_{f}"), F.col(order))).alias("rule"), some(F.col(f"_d_{f}") & F.col("_inp")).alias("inp"), some(F.col(f"_d_{f}") & ~F.col("_inp")).alias("doc"))
    first = F.min_by(F.struct(*[T.text(F.col(f)).alias(f) for f in kinds], *[rule(f) for f in kinds], F.col("_inp").alias("inp")), F.when(staged, F.col(order)))
    return rows.groupBy(key).agg(*[last(c).alias(c) for c in kinds], (F.count_if(staged) > 0).alias("staged"), F.bool_or(F.col("role") == "inputter").alias("reviewed"), first.alias("first"), *[later(f).alias(f"later_{f}") for f in kinds])


def touches(field: str, kind: str, model: Column) -> Column:
    """``rule, by_inputter, by_preparer`` of a column, as ``last_touchers`` has them, over the rows of ``folded_touches`` beside the
    record's ``model`` value."""
    changed = F.col("first").isNotNull() & ~T.same_value(F.lit(kind), model, F.col(f"first.{field}"))
    later = F.col(f"later_{field}")
    rule = F.when(later["rule"].isNotNull(), later["rule"][f"rule_{field}"]).when(changed, F.col(f"first.rule_{field}"))
    by = lambda inp: F.coalesce(later["inp" if inp else "doc"] | (changed & (F.col("first.inp") == inp)), F.lit(False))
    return F.struct(rule.alias("rule"), by(True).alias("by_inputter"), by(False).alias("by_preparer"))


def changed_counts(diffs: DataFrame, fields: list[str], key: str = "stem") -> DataFrame:
    """EVT-03: how often each column of a record changed."""
    return diffs.groupBy(key).agg(*[F.count_if(F.col("field") == f).alias(f"n_{f}") for f in fields])


def derive_state(error: Column, submitted: Column, staged: Column) -> Column:
    """EVT-05."""
    return F.when(~T.blank(error), "failed").when(F.coalesce(submitted, F.lit(False)), "submitted").when(F.coalesce(staged, F.lit(False)), "staged").otherwise("parsed")


def touched_days(logs: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """EVT-06: ``stem, who, day`` once each, from logs (frame, key, who, when); an unreadable time keeps the person, without a day."""
    out = None
    for frame, key, who, when in logs:
        day = F.when(F.col(when).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(when, 1, 10))
        part = frame.select(F.col(key).alias("stem"), F.col(who).alias("who"), day.alias("day"))
        out = part if out is None else out.unionByName(part)
    return out.where(~T.blank(F.col("who"))).distinct()


def owned(rows: DataFrame, touched: DataFrame, who: str | None, day: str | None) -> DataFrame:
    """EVT-07: rows that a person touched, on a day if given."""
    mine = touched.where((F.lit(who is None) | (F.col("who") == F.lit(who))) & (F.lit(day is None) | (F.col("day") == F.lit(day))))
    return rows.join(mine.select("stem").distinct(), "stem", "left_semi")


def void_current(marks: DataFrame) -> DataFrame:
    """EVT-11: keys that are void now, by the last mark of each (kind, key)."""
    last = marks.groupBy("kind", "key").agg(F.max_by(F.struct("action", "who"), "seq").alias("m"))
    return last.where(F.col("m.action") == "void").select("kind", "key", F.col("m.who").alias("who"))


def exclude_voided(rows: DataFrame, voids: DataFrame, key: str, kind: str) -> DataFrame:
    """FLT-02."""
    return rows.join(voids.where(F.col("kind") == kind).select(F.col("key").alias(key)), key, "left_anti")


def unlock_log(marks: DataFrame) -> DataFrame:
    """EVT-12: number of entries and the latest one per key."""
    return marks.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.max_by("who", "seq").alias("last_who"), F.max("seq").alias("last_seq"))


def apply_submissions(ledger: DataFrame, batch: DataFrame, key: str = "stem", order: str = "submitted_at") -> DataFrame:
    """EVT-13: the ledger with the batch's last row per key replacing its own."""
    last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in ledger.columns if c != key]), order).alias("r")).select(key, "r.*")
    return ledger.join(last.select(key), key, "left_anti").unionByName(last.select(*ledger.columns))


def stable_files(scans: DataFrame) -> DataFrame:
    """WIN-06: scans where a file has the size and time it had in the scan before."""
    w = Window.partitionBy("name").orderBy("scan")
    return scans.withColumn("stable", F.coalesce((F.lag("size").over(w) == F.col("size")) & (F.lag("mtime").over(w) == F.col("mtime")), F.lit(False)))


def retry_state(attempts: DataFrame, most: int = 3) -> DataFrame:
    """WIN-07: per file, failures since its last success, and whether it is given up. Two aggregates, joined: failures are
    counted where they lie, whatever the length of a file's log."""
    last_ok = attempts.groupBy("name").agg(F.max(F.when(F.col("ok") == 1, F.col("scan"))).alias("_ok"))
    open_ = (F.col("ok") == 0) & (F.col("scan") > F.coalesce("_ok", F.lit(-1)))
    return attempts.join(last_ok, "name").groupBy("name").agg(F.count_if(open_).alias("failures")).withColumn("given_up", F.col("failures") >= most)


def suppress_repeats(events: DataFrame, ttl: int, key: str = "key", order: str = "at", fp: str = "fp", ok: str = "ok") -> DataFrame:
    """REC-05: whether each write is accepted: unlike the last accepted one, or that one is ``ttl`` old. A suppressed
    repeat does not extend the time; a failed write clears the memory.

    A fold over each key's events in order, row by row: a task keeps one state, that of the key it reads, so memory does
    not depend on how many events a key has.
    """
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last_fp, last_at = (), None, None
        for batch in batches:
            accepted = []
            for k, at, print_, good in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if (k,) != now:
                    now, last_fp, last_at = (k,), None, None
                repeat = None not in (last_fp, last_at, at) and print_ == last_fp and at - last_at < ttl
                if not repeat:
                    last_fp, last_at = (print_, at) if good else (None, None)
                accepted.append(not repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(accepted, pa.bool_())], names=[key, order, fp, "accepted"])

    rows = events.select(key, order, fp, F.col(order).cast("long").alias("_at"), F.col(fp).cast("string").alias("_fp"), F.col(ok).alias("_ok"))
    rows = rows.repartition(key).sortWithinPartitions(key, order, fp, "_ok")
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{fp}` {kinds[fp]}, accepted boolean")


def board_current(events: DataFrame) -> DataFrame:
    """BRD-01: status of the last decision (default open), retracted apart, one row per comment."""
    decided = F.col("action") == "decide"
    return events.groupBy("id").agg(
        F.min_by("who", "seq").alias("who"),
        F.coalesce(F.max_by(F.when(decided, F.col("status")), F.when(decided, F.col("seq"))), F.lit("open")).alias("status"),
        F.bool_or(F.col("action") == "retract").alias("retracted"),
        F.count_if(F.col("action") == "edit").alias("edits"),
    )


#: What a comment and its decisions may hold.
BOARD_TEXT, BOARD_NOTE, BOARD_NAME, BOARD_REF = 2000, 200, 160, 60
BOARD_STATUS = ("open", "adopted", "declined", "later")


def _board_fault(action: str, text: str, column: str, status: str, note: str, ref: str, who: str, columns: frozenset[str], statuses: frozenset[str]) -> str | None:
    """What is wrong with an event in itself."""
    if action in ("add", "edit"):
        if not text:
            return "empty"
        if len(text) > BOARD_TEXT:
            return "too long"
    if action == "add":
        if column and column not in columns:
            return "unknown column"
        return None if who and len(who) <= BOARD_NAME else "unsigned"
    if action == "decide":
        if status not in statuses:
            return "unknown status"
        if not note:
            return "no reason"
        return "too long" if len(note) > BOARD_NOTE or len(ref) > BOARD_REF else None
    return None if action in ("edit", "retract") else "unknown action"


def board_apply(events: DataFrame, columns: list[str], statuses: tuple[str, ...] = BOARD_STATUS) -> DataFrame:
    """BRD-03: each event of comments (``id, seq, who, action, text, field, status, note, ref``) with ``accepted``, the ``reason``
    of a rejection, and ``old_text``, the text that an accepted edit replaced.

    An event is rejected for what is wrong in itself first (empty or too long a text, an unknown column or status, no signature,
    no reason for a decision), then if its comment is missing, there already, or retracted. A retraction may be repeated and
    changes nothing then; an edit to the same text is accepted and replaces nothing.

    Each comment's events pass in order through one task, row by row: what is kept is the present text of the comment at hand,
    whatever its history. Equal ``seq`` go by action.
    """
    known, allowed = frozenset(columns), frozenset(statuses)
    names = ["who", "action", "text", "field", "status", "note", "ref"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, gone = (), None, False
        for batch in batches:
            out: list[tuple[bool, str | None, str | None]] = []
            values = (batch.column(n).to_pylist() for n in ("id", *names))
            for i, who, action, body, column, status, note, ref in zip(*values, strict=True):
                if (i,) != now:
                    now, text, gone = (i,), None, False
                body = (body or "").strip()
                reason = _board_fault(action, body, (column or "").strip(), (status or "").strip(), (note or "").strip(), (ref or "").strip(), (who or "").strip(), known, allowed)
                if reason is None:
                    if action == "add":
                        reason = "there already" if text is not None else None
                    elif text is None:
                        reason = "missing"
                    elif gone and action != "retract":
                        reason = "retracted"
                old = None
                if reason is None:
                    if action == "edit" and body != text:
                        old = text
                    text = body if action in ("add", "edit") else text
                    gone = gone or action == "retract"
                out.append((reason is None, reason, old))
            accepted, reasons, olds = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(reasons, pa.string()), pa.array(olds, pa.string())], names=[*batch.schema.names, "accepted", "reason", "old_text"])

    rows = events.select("id", "seq", *[F.col(f"`{n}`").cast("string").alias(n) for n in names])
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.repartition("id").sortWithinPartitions("id", "seq", "action", "text").mapInArrow(run, f"{kinds}, accepted boolean, reason string, old_text string")


def board_state(applied: DataFrame) -> DataFrame:
    """BRD-03: comments as the accepted events leave them: text, old texts in order, status of the last decision, retracted."""
    good = applied.where("accepted")
    wrote, decided = F.col("action").isin("add", "edit"), F.col("action") == "decide"
    return good.groupBy("id").agg(
        F.trim(F.max_by(F.when(wrote, F.col("text")), F.when(wrote, F.col("seq")))).alias("text"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("old_text").isNotNull(), F.struct("seq", "old_text")))), lambda x: x["old_text"]).alias("revised"),
        F.coalesce(F.max_by(F.when(decided, F.col("status")), F.when(decided, F.col("seq"))), F.lit("open")).alias("status"),
        F.bool_or(F.col("action") == "retract").alias("retracted"),
    )


def board_filter(rows: DataFrame, name: str, viewer: str) -> DataFrame:
    """BRD-04: ``all`` leaves out retracted comments; unknown names pass everything."""
    tests = {"all": ~F.col("retracted"), "mine": (F.col("who") == viewer) & ~F.col("retracted"), "retracted": F.col("retracted")}
    tests |= {s: (F.col("status") == s) & ~F.col("retracted") for s in ("open", "adopted", "declined", "later")}
    return rows.where(tests[name]) if name in tests else rows


def cluster_order(rows: DataFrame, key: str, pos: str, is_master: Column) -> DataFrame:
    """WIN-04: ``rank_key`` columns for groups in the order of their first row, masters before children."""
    return rows.withColumn("first_pos", F.min(pos).over(Window.partitionBy(key))).withColumn("kind_rank", F.when(is_master, 0).otherwise(1))
