"""Usage, ledger and board reports (AGG-01 to AGG-03, AGG-09 to AGG-15, SRT-*, WIN-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.standardise import error_kind


TOKENS = ["calls", "prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens"]
STAGES = ["render", "l1", "l2", "l3"]


def usage_report(qc: DataFrame, usage: DataFrame, axes: list[str], stages: list[str] = STAGES) -> DataFrame:
    """AGG-01, AGG-02: totals by each axis and over all, in one pass over tickets and one over their stages.

    Tickets are counted before the stages are joined, so a ticket with several stages counts once. ``sec_<stage>`` are seconds.
    """
    millis = [F.sum(F.when(F.col("stage") == s, F.col("millis"))).alias(f"sec_{s}") for s in stages]
    per = usage.groupBy("stem").agg(*[F.sum(c).alias(c) for c in TOKENS], *millis)
    sums = [*TOKENS, *[f"sec_{s}" for s in stages]]
    rows = qc.join(per, "stem", "left").select(*axes, "error", "needs_review", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    sets = rows.groupingSets([[F.col(a)] for a in axes] + [[]], *[F.col(a) for a in axes])
    total = [F.sum(c).alias(c) for c in TOKENS] + [(F.sum(f"sec_{s}").cast("double") / 1000.0).alias(f"sec_{s}") for s in stages]
    return sets.agg(F.count(F.lit(1)).alias("tickets"), F.count_if(~T.blank(F.col("error"))).alias("failed"), F.count_if(F.col("needs_review") == 1).alias("flagged"), *total)


def usage_by_stage(qc: DataFrame, usage: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """AGG-02, the stage axis: calls and tokens of each stage over the tickets of a closed window of days. Stages that only
    have a time (no calls, no tokens) count as zero."""
    tickets = qc.where(T.in_window(F.col("processed_at"), first, last)).select("stem")
    return usage.join(tickets, "stem", "left_semi").groupBy("stage").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS])


def failure_kinds(qc: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """AGG-03, UDX-02."""
    named = error_kind(qc, "error", kinds).where("error_kind <> ''")
    return named.groupBy("error_kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_kind")


def day_counts(rows: DataFrame) -> DataFrame:
    """AGG-09."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "submitted").alias("submitted"), F.count_if(F.col("state") == "parsed").alias("pending"), F.count_if(F.col("state") == "failed").alias("failed"), F.sum("flags").alias("flags"), F.count_if(F.col("flags") > 0).alias("flagged"))


def child_counts(masters: DataFrame, children: DataFrame, on: str) -> DataFrame:
    """AGG-10: children of each master, those without any kept."""
    n = children.groupBy(on).agg(F.count(F.lit(1)).alias("children"))
    return masters.join(n, on, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long")))


def share_of_max(df: DataFrame, column: str) -> DataFrame:
    """WIN-08: value over the largest, 0 where that is 0. The one row of the maximum is joined, so no row moves to one task."""
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top)).withColumn("share", F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(0.0)).drop("_top")


def flag_first(flags: str, sent: Column, pos: str) -> list[Column]:
    """SRT-02: order by flags, unsent first, then the original place."""
    return [F.desc(flags), sent.cast("int").asc(), F.col(pos).asc()]


def keep_newest(df: DataFrame, time: str, k: int, tie: str) -> DataFrame:
    """SRT-05: the newest k rows; a missing time is the oldest."""
    return df.orderBy(F.col(time).desc_nulls_last(), tie).limit(k)
