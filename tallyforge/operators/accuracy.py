"""Record-to-record comparison and accuracy statistics (ACC-*, AGG-04 to AGG-09, SET-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T


def to_cells(left: DataFrame, right: DataFrame, kinds: dict[str, str], key: str = "stem") -> DataFrame:
    """``stem, field, kind, model, final``: a row per column of two records with the same key."""
    both = left.select(key, F.struct(*kinds).alias("m")).join(right.select(key, F.struct(*kinds).alias("f")), key)
    cells = [F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), T.text(F.col(f"m.{f}")).alias("model"), T.text(F.col(f"f.{f}")).alias("final")) for f, k in kinds.items()]
    return both.select(key, F.inline(F.array(*cells)))


def compared(cells: DataFrame) -> DataFrame:
    """``comparable`` (one side is not blank) and ``changed`` for each cell."""
    some = ~(T.blank(F.col("model")) & T.blank(F.col("final")))
    return cells.withColumn("comparable", some).withColumn("changed", some & ~T.same_value(F.col("kind"), F.col("model"), F.col("final")))


def accuracy_rows(cells: DataFrame, touched: DataFrame | None = None, late: DataFrame | None = None, staged: DataFrame | None = None, key: str = "stem") -> DataFrame:
    """ACC-01 to ACC-03: comparable columns and edits per ticket, by who made them.

    ``touched`` (``events.last_touchers``): a changed column whose last event carries a rule was accepted, not corrected: it
    leaves numerator and denominator and counts as polished, unless it is in ``late`` (stem, field), the columns changed
    after the last staging. Columns that an inputter's event touched, and late ones, count as ``inp``; those another's event
    touched as ``doc``. A ticket without staging (not in ``staged``) has all its edits in ``doc``. Without ``touched`` late edits alone are ``inp``.
    """
    rows = compared(cells)
    flag = lambda df, name: df.select(key, "field").distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(late, "_late"), [key, "field"], "left") if late is not None else rows.withColumn("_late", F.lit(False))
    is_late = F.coalesce("_late", F.lit(False))
    if touched is None:
        rows = rows.select("*", F.lit(None).cast("string").alias("rule"), (F.col("changed") & ~is_late).alias("_doc"), (F.col("changed") & is_late).alias("_inp"))
    else:
        has_staging = (touched if staged is None else staged).select(key).distinct().withColumn("_staged", F.lit(True))
        rows = rows.join(touched.select(key, "field", "rule", "by_inputter", "by_preparer"), [key, "field"], "left").join(has_staging, key, "left")
        rows = rows.withColumn("rule", F.when(~is_late & F.col("changed"), F.col("rule")))
        staged_ = F.coalesce("_staged", F.lit(False))
        doc = F.when(staged_, F.coalesce("by_preparer", F.lit(False))).otherwise(F.col("changed"))
        inp = staged_ & (F.coalesce("by_inputter", F.lit(False)) | is_late)
        rows = rows.withColumns({"_doc": doc, "_inp": inp})
    own = F.col("rule").isNull()
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("field")))), ",")
    return rows.groupBy(key).agg(
        F.count_if(F.col("comparable") & own).alias("comparable"),
        F.count_if(F.col("changed") & own).alias("total"),
        F.count_if(F.col("_doc") & own).alias("doc"),
        F.count_if(F.col("_inp") & own).alias("inp"),
        listed(F.col("changed") & own).alias("fields"),
        F.count_if(~own).alias("polished"),
        F.array_sort(F.collect_list(F.when(~own, F.struct("field", "rule")))).alias("rules"),
    )


def attributed_rows(records: DataFrame, kinds: dict[str, str], keep: list[str]) -> DataFrame:
    """``accuracy_rows`` with events over records that have all they need in one row: nothing is shuffled again.

    ``records``: structs ``m`` (model), ``f`` (final) and ``s`` (as last staged) of the columns, ``staged``, and ``touched``, a struct of
    ``events.touches`` of each column. ``keep`` are columns that stay; ``cells`` are the compared columns.
    """
    same = lambda k, a, b: T.same_value(F.lit(k), F.col(a), F.col(b))
    some = lambda a, b: ~(T.blank(F.col(a)) & T.blank(F.col(b)))
    staged = F.coalesce("staged", F.lit(False))

    def cell(f: str, k: str) -> Column:
        late = staged & ~same(k, f"s.{f}", f"f.{f}")
        comparable = some(f"m.{f}", f"f.{f}")
        changed = comparable & ~same(k, f"m.{f}", f"f.{f}")
        by = lambda n: F.coalesce(F.col(f"touched.{f}.{n}"), F.lit(False))
        doc = F.when(staged, by("by_preparer")).otherwise(changed)
        inp = staged & (by("by_inputter") | late)
        rule = F.when(~late & changed, F.col(f"touched.{f}.rule"))
        return F.struct(F.lit(f).alias("field"), comparable.alias("comparable"), changed.alias("changed"), rule.alias("rule"), doc.alias("doc"), inp.alias("inp"))

    cells = records.select("stem", *keep, F.array(*[cell(f, k) for f, k in sorted(kinds.items())]).alias("cells"))
    own = lambda x: x["rule"].isNull()
    count = lambda n, c: F.size(F.filter("cells", lambda x: c(x) & own(x))).cast("long").alias(n)
    taken = F.filter("cells", lambda x: ~own(x))
    return cells.select(
        "stem",
        count("comparable", lambda x: x["comparable"]),
        count("total", lambda x: x["changed"]),
        count("doc", lambda x: x["doc"]),
        count("inp", lambda x: x["inp"]),
        F.array_join(F.transform(F.filter("cells", lambda x: x["changed"] & own(x)), lambda x: x["field"]), ",").alias("fields"),
        F.size(taken).cast("long").alias("polished"),
        F.transform(taken, lambda x: F.struct(x["field"].alias("field"), x["rule"].alias("rule"))).alias("rules"),
        *keep,
        "cells",
    )


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """AGG-04: one row; ratios are null where nothing could be compared.

    Optional columns of ``rows``: ``legacy`` (sent before values were kept: counted apart, in no ratio), ``submitted``,
    ``no_inputter_review``, ``inputter_self_submit``.
    """
    have = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    usable = ~have("legacy")
    total = lambda c: F.coalesce(F.sum(F.when(usable, F.col(c))), F.lit(0)) if c in rows.columns else F.lit(0).cast("long")
    sums = rows.agg(
        F.count_if(usable).alias("tickets"),
        F.count_if(~usable).alias("legacy"),
        *[total(c).alias(n) for c, n in (("comparable", "comparable"), ("total", "edits"), ("doc", "doc"), ("inp", "inp"), ("polished", "polished"))],
        F.count_if(usable & (F.col("total") == 0)).alias("clean"),
        F.count_if(usable & have("submitted") & have("no_inputter_review")).alias("unreviewed"),
        F.count_if(usable & have("submitted") & have("inputter_self_submit")).alias("self_submit"),
    )
    return sums.select("*", ratio(F.col("clean"), F.col("tickets")).alias("acc_ticket"), (1 - ratio(F.col("edits"), F.col("comparable"))).alias("acc_field"), (1 - ratio(F.col("inp"), F.col("comparable"))).alias("acc_after_review"))


def accepted_rules(rows: DataFrame) -> DataFrame:
    """AGG-07: how many columns each rule changed that a person accepted."""
    return rows.select(F.explode("rules.rule").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def closure(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """AGG-08: do a summary and its detail rows tell of the same tickets: usable and legacy ones are all rows, comparable columns add up."""
    detail = rows.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("comparable"), F.lit(0)).alias("_columns"))
    return summary.crossJoin(detail).select((F.col("tickets") + F.col("legacy") == F.col("_n")).alias("rows_match"), (F.col("comparable") == F.col("_columns")).alias("columns_match"))


def report_tables(rows: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """SRC-13: the accuracy report as three tables: ``summary`` (name, value), ``tickets`` and ``fields``. ``cells`` may be compared already."""
    one = accuracy_summary(rows)
    numbers = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one.columns]
    tickets = rows.select("stem", "comparable", "total", "doc", "inp", "polished", "fields")
    return {"summary": one.select(F.inline(F.array(*numbers))), "tickets": tickets, "fields": edits_by_field(cells)}


def edits_by_field(cells: DataFrame) -> DataFrame:
    """AGG-05, SRT-04: edits per field, most first, then by name."""
    return (cells if "changed" in cells.columns else compared(cells)).where("changed").groupBy("field").agg(F.count(F.lit(1)).alias("edits")).orderBy(F.desc("edits"), "field")


def accuracy_by(rows: DataFrame, axis: str) -> DataFrame:
    """AGG-06: tickets, comparable columns and edits by an axis; a blank one is "(not recorded)"."""
    name = F.coalesce(F.nullif(T.strip(F.col(axis)), F.lit("")), F.lit("(not recorded)"))
    return rows.groupBy(name.alias("axis")).agg(F.count(F.lit(1)).alias("tickets"), F.sum("comparable").alias("comparable"), F.sum("total").alias("edits"))


def reader_conflicts(cells: DataFrame) -> DataFrame:
    """ACC-04, ACC-05: number and count columns in which two readers differ, with a text that names both values."""
    differ = T.strip(F.col("model")) != T.strip(F.col("final"))
    shown = lambda c: F.when(T.blank(F.col(c)), "blank").otherwise(T.strip(F.col(c)))
    found = cells.where(F.col("kind").isin("no", "int", "num") & differ)
    return found.select("stem", "field", F.when(F.col("kind") == "no", "num").otherwise("count").alias("group"), F.concat("field", F.lit(": "), shown("model"), F.lit(" / "), shown("final")).alias("flag"))


def is_blank_record(columns: list[str]) -> Column:
    """ACC-06."""
    return F.forall(F.array(*[T.text(F.col(c)) for c in columns]), T.blank)


def cell_status(cells: DataFrame) -> DataFrame:
    """ACC-08: what people see of a cell, from ``flags`` (a count), ``acked``, ``raw``, ``air`` and ``skip`` (sent although empty).

    ``status``: flag or confirmed; empty, emptyok (confirmed) or skipped where both versions are blank; miss where only the
    normalised one is; else same. ``todo`` holds for flags and empty cells that nobody has looked at.
    """
    raw, air, acked = T.blank(F.col("raw")), T.blank(F.col("air")), F.coalesce("acked", F.lit(False))
    flagged = F.coalesce("flags", F.lit(0)) > 0
    empty = F.when(acked, "emptyok").when(F.coalesce("skip", F.lit(False)), "skipped").otherwise("empty")
    status = F.when(flagged, F.when(acked, "confirmed").otherwise("flag")).when(raw & air, empty).when(air, "miss").otherwise("same")
    return cells.withColumn("status", status).withColumn("todo", F.col("status").isin("flag", "empty"))


def segment(total: Column, comparable: Column) -> Column:
    """ACC-09, FLT-05."""
    return F.when(comparable.isNull() | (comparable == 0), "no trace").when(total > 0, "changed").otherwise("clean")


def reader_gain_loss(cells: DataFrame) -> DataFrame:
    """SET-02: per record, columns one reader gained, lost and changed."""
    m, f = T.blank(F.col("model")), T.blank(F.col("final"))
    return cells.groupBy("stem").agg(F.count_if(m & ~f).alias("gained"), F.count_if(~m & f).alias("lost"), F.count_if(~m & ~f & ~T.same_value(F.col("kind"), F.col("model"), F.col("final"))).alias("changed"))


def segment_state(cells: DataFrame, groups: dict[str, str], key: str = "stem") -> DataFrame:
    """AGG-12: progress per record and column group over the cells of ``cell_status``: ``hard`` (flags to confirm), ``soft`` (empty
    cells to confirm), ``todo`` columns, ``cleared`` ones; the state is hasflag, hasissue or clear."""
    group = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    rows = cell_status(cells).withColumn("grp", F.coalesce(F.try_element_at(group, F.col("field")), F.lit("other")))
    hard, soft = F.count_if(F.col("status") == "flag"), F.count_if(F.col("status") == "empty")
    out = rows.groupBy(key, "grp").agg(F.count(F.lit(1)).alias("total"), F.count_if("todo").alias("todo"), hard.alias("hard"), soft.alias("soft"))
    state = F.when(F.col("hard") > 0, "hasflag").when(F.col("soft") > 0, "hasissue").otherwise("clear")
    return out.withColumn("cleared", F.col("total") - F.col("todo")).withColumn("state", state)
