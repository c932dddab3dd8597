"""Reconciliation joins, submission gates, registry and retention (JN-*, REC-*, REG-*, RET-*, SET-*)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T


def number_index(ledger: DataFrame, order: str) -> DataFrame:
    """JN-03: the latest submitted stem for each number pair; rows without any number are left out."""
    rows = ledger.withColumn("number_key", T.number_key(F.col("mawb"), F.col("hawb"))).where("number_key <> '|'")
    return rows.groupBy("number_key").agg(F.max_by("stem", order).alias("stem"))


def enrich_remote(remote: DataFrame, index: DataFrame) -> DataFrame:
    """JN-02: remote rows with the stem of their number pair, or a dash."""
    keyed = remote.withColumn("number_key", T.number_key(F.col("MAWB"), F.col("HAWB")))
    return keyed.join(index, "number_key", "left").withColumn("stem", F.coalesce("stem", F.lit("—")))


def lookup_stem(keys: DataFrame, index: DataFrame, archive: DataFrame) -> DataFrame:
    """JN-04: stem per key, only where the archive still holds the original."""
    live = index.join(archive.select("stem").distinct(), "stem", "left_semi")
    return keys.join(live, "number_key", "left")


def children_of(rows: DataFrame, masters: DataFrame, column: str = "MAWB_NO") -> DataFrame:
    """JN-05: rows under one of the masters, by normalised number."""
    wanted = masters.select(T.norm_no(F.col("mawb")).alias("_no")).distinct()
    return rows.withColumn("_no", T.norm_no(F.col(column))).join(wanted, "_no", "left_semi").drop("_no")


def merge_remote_local(remote: DataFrame, local: DataFrame, number: str) -> DataFrame:
    """JN-07: one row per normalised number (numberless rows apart): the remote row first, else the latest local; copies counted."""
    tag = lambda df, side, rank: df.select(T.norm_no(F.col(number)).alias("no"), F.lit(side).alias("side"), F.lit(rank).alias("rank"), F.col("num"))
    both = tag(remote, "remote", 1).unionByName(tag(local, "local", 0))
    named = both.where("no <> ''").groupBy("no").agg(F.max_by(F.struct("side", "num"), F.struct("rank", "num")).alias("r"), F.count(F.lit(1)).alias("copies")).select("no", "r.side", "r.num", "copies")
    return named.unionByName(both.where("no = ''").select("no", "side", "num", F.lit(1).cast("long").alias("copies")))


def backfill_plan(children: DataFrame, parents: DataFrame, on: str, columns: dict[str, str]) -> DataFrame:
    """JN-12: ``stem, field, to`` for child cells that are blank where the parent's column is not; nothing is overwritten."""
    p = parents.select(on, *[F.col(src).alias(f"_p_{c}") for c, src in columns.items()])
    joined = children.join(p, on)
    cells = F.array(*[F.when(T.blank(F.col(c)) & ~T.blank(F.col(f"_p_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_p_{c}").cast("string").alias("to"))) for c in columns])
    return joined.select("stem", F.inline(F.array_compact(cells)))


def backfill_apply(children: DataFrame, plan: DataFrame) -> DataFrame:
    fills = plan.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("field", "to"))).alias("_f"))
    joined = children.join(fills, "stem", "left")
    return joined.select(*[F.coalesce(F.try_element_at("_f", F.lit(c)), F.col(c)).alias(c) if c != "stem" and dict(children.dtypes)[c] == "string" else F.col(c) for c in children.columns])


def backfill_flags(plan: DataFrame, current: DataFrame) -> DataFrame:
    """REC-10: filled cells that are still empty or still equal to the filled value."""
    joined = plan.join(current, ["stem", "field"], "left")
    return joined.where(T.blank(F.col("value")) | (T.fold_ws(F.col("value")) == T.fold_ws(F.col("to")))).select("stem", "field", "to")


def whole_row_merge(existing: DataFrame, ours: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN-13: the remote row as a base, our values over it; our blank values leave null."""
    e = existing.select(key, *[F.col(c).alias(f"_e_{c}") for c in columns])
    joined = ours.join(e, key, "left")
    return joined.select(key, *[F.nullif(T.strip(F.col(c)), F.lit("")).alias(c) if c in ours.columns else F.col(f"_e_{c}").alias(c) for c in columns])


def overlay(existing: Column, given: Column, columns: list[str]) -> Column:
    """JN-13, a partial record over a stored one, both maps: of ``columns`` those that ``given`` names, null included, else the
    stored value; the result names all of them, so that nothing is left out when the whole row is written."""
    value = lambda c: F.when(F.coalesce(F.map_contains_key(given, F.lit(c)), F.lit(False)), F.try_element_at(given, F.lit(c))).otherwise(F.try_element_at(existing, F.lit(c)))
    return F.create_map(*[x for c in columns for x in (F.lit(c), value(c))])


def whole_row(existing: Column, ours: Column, columns: list[str], numbers: list[str], parties: list[str]) -> Column:
    """JN-13, a house record as it is written: ours over the stored one, blank numbers null, and each party's ids, of both
    versions and both cells, dealt out anew to ``_EORI`` and ``_TAX`` (null if none)."""
    merged = overlay(existing, ours, columns)
    none = F.array().cast("array<string>")

    def pool(m: Column, party: str) -> dict[str, Column]:
        cells = [F.try_element_at(x, F.lit(f"{party}_{k}")) for k in ("EORI", "TAX") for x in (m, ours)] + [F.try_element_at(ours, F.lit(f"{party}_TAX_ID"))]
        ids = F.array_distinct(F.flatten(F.array(*[F.coalesce(T.split_ids(c), none) for c in cells])))
        of = lambda kind: F.array_join(F.array_distinct(F.transform(F.filter(ids, lambda x: T.let(x, T.classify_id) == kind), lambda x: T.let(x, T.id_cell))), " / ")
        return {f"{party}_EORI": F.nullif(of("eori"), F.lit("")), f"{party}_TAX": F.nullif(of("tax"), F.lit(""))}

    def written(m: Column) -> Column:
        value = lambda c: F.try_element_at(m, F.lit(c))
        cells = {c: F.when(~T.blank(value(c)), value(c)) if c in numbers else value(c) for c in columns}
        for party in parties:
            cells |= pool(m, party)
        return F.create_map(*[x for c, v in cells.items() for x in (F.lit(c), v)])

    return T.let(merged, written)


def three_way_merge(base: Column, local: Column, server: Column) -> Column:
    """JN-14: maps of values: a side that left the base wins; both changed differently is a conflict (local value kept, marked)."""
    keys = F.array_distinct(F.concat(F.map_keys(base), F.map_keys(local), F.map_keys(server)))

    def entry(k: Column) -> Column:
        b, x, y = F.try_element_at(base, k), F.try_element_at(local, k), F.try_element_at(server, k)
        conflict = ~x.eqNullSafe(b) & ~y.eqNullSafe(b) & ~x.eqNullSafe(y)
        return F.struct(k.alias("k"), F.when(x.eqNullSafe(b), y).otherwise(x).alias("v"), conflict.alias("conflict"))

    return F.transform(keys, entry)


def authoritative(ledger: DataFrame, staged: DataFrame) -> DataFrame:
    """JN-15: the later version of each record; of equal times the submitted one."""
    a = ledger.select("stem", F.col("submitted_at").alias("_l"))
    b = staged.select("stem", F.col("staged_at").alias("_s"))
    return a.join(b, "stem", "full").select("stem", F.when(F.col("_s").isNull() | (F.col("_l") >= F.col("_s")), "submitted").otherwise("staged").alias("version"))


def parent_gate(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """JN-16: whether a child's parent was sent: yes, no, or unknown (no parent, or its state is not known)."""
    joined = children.join(parents.select(on, F.col("sent").alias("_sent")), on, "left")
    return joined.withColumn("parent", F.when(F.col("_sent") == 1, "sent").when(F.col("_sent") == 0, "not sent").otherwise("unknown")).drop("_sent")


def fresh_status(numbers: DataFrame, cache: DataFrame, now: int, ttl: dict[str, int]) -> DataFrame:
    """JN-18: cached status while it is fresh for its kind, else null."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv]), F.col("status"))
    joined = numbers.join(cache, "num", "left")
    return joined.withColumn("status", F.when(F.lit(now) - F.col("checked_at") < limit, F.col("status"))).drop("checked_at")


def submission_gate(rows: DataFrame) -> DataFrame:
    """REC-01: the first reason that holds a row back: sent before, number missing, open flags, parent not sent."""
    reason = F.when(F.col("already_sent"), "sent").when(T.blank(F.col("mawb")) | T.blank(F.col("hawb")), "number").when(F.size(F.array_except("flags", "acked")) > 0, "flags").when(F.col("parent") == "not sent", "parent").otherwise("pass")
    return rows.withColumn("verdict", reason)


def blank_tiers(raw: Column, sent: Column, claimed: Column) -> Column:
    """SET-05: blank columns of what is sent: acknowledged (claimed) and skipped."""
    names = F.map_keys(F.map_filter(sent, lambda k, v: T.blank(v)))
    return F.struct(F.array_sort(F.array_intersect(names, claimed)).alias("acked"), F.array_sort(F.array_except(names, claimed)).alias("skipped"))


def fingerprint(values: dict[str, Column]) -> Column:
    """REC-04: SHA-256 of the record as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)])), 256)


def status_gate(status: Column) -> Column:
    """REC-06."""
    return F.when(status.isNull() | (status == 0), "write").otherwise("locked")


def preread_guard(sent: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """REC-07: rows we sent that the other system does not have are errors and never overwritten."""
    there = remote.select(key).distinct().withColumn("_there", F.lit(True))
    return sent.join(there, key, "left").withColumn("guard", F.when(F.col("_there"), "ok").otherwise("error")).drop("_there")


def exclude_self_echo(lines: DataFrame, baseline: DataFrame, sent: DataFrame) -> DataFrame:
    """REC-08: lines we wrote ourselves go: label unknown to the baseline and value equal to what we sent; a record
    without a baseline keeps all of its lines, marked unknown."""
    have = baseline.select("stem").distinct().withColumn("_has", F.lit(True))
    known = baseline.select("stem", "label").distinct().withColumn("_known", F.lit(True))
    own = sent.select("stem", "label", T.sym_to_space(F.col("value")).alias("_sent"))
    joined = lines.join(have, "stem", "left").join(known, ["stem", "label"], "left").join(own, ["stem", "label"], "left")
    echo = F.col("_known").isNull() & (T.sym_to_space(F.col("value")) == F.col("_sent"))
    verdict = F.when(F.col("_has").isNull(), "unknown").when(F.coalesce(echo, F.lit(False)), "echo").otherwise("kept")
    return joined.select("stem", "label", "value", verdict.alias("verdict"))


def missed_columns(record: DataFrame, lines: DataFrame) -> DataFrame:
    """REC-09: labels with a value in the lines (the first one) whose record column is blank. ``record``: ``stem, field, value``."""
    label = F.regexp_extract("text", r"^([A-Z_0-9]+):\s*(.+)$", 1)
    found = lines.select("stem", "i", label.alias("field"), F.regexp_extract("text", r"^([A-Z_0-9]+):\s*(.+)$", 2).alias("seen")).where("field <> ''")
    first = found.groupBy("stem", "field").agg(F.min_by("seen", "i").alias("seen"))
    return first.join(record, ["stem", "field"], "left").where(T.blank(F.col("value"))).select("stem", "field", "seen")


def local_pending(states: DataFrame, masters: DataFrame, master: str, columns: list[str], key: str = "stem") -> DataFrame:
    """JN-06: rows under one of the masters that are parsed or staged only, so that nobody else knows them yet."""
    mine = states.where(F.col("state").isin("parsed", "staged")).join(masters.select(master).distinct(), master, "left_semi")
    return mine.select(key, "state", *columns)


#: countries whose numbers the registry doesn't hold
SKIPPED = ("GB",)


def registry_numbers(df: DataFrame, key: str, cell: str, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """REG-01: distinct customs-id-shaped numbers of a cell, each once, without those of countries to skip."""
    parts = F.array_distinct(F.transform(T.split_ids(F.col(cell)), T.id_body))
    shaped = lambda x: x.rlike("^[A-Z]{2}[A-Z0-9]{6,15}$") & x.rlike("[0-9]") & ~F.substring(x, 1, 2).isin(*skip)
    return df.select(key, F.explode(F.filter(parts, shaped)).alias("num"))


def page_verdict(html: Column) -> Column:
    """REG-03: by the full verdict sentence; a page without one is unreachable."""
    t = F.lower(T.text(html))
    return F.when(F.contains(t, F.lit("number is not valid.")), "invalid").when(F.contains(t, F.lit("number is valid.")), "valid").otherwise("unreachable")


def last_touched(*times: Column) -> Column:
    """RET-01: the latest readable of several time texts."""
    return F.greatest(*[F.try_to_timestamp(F.substring(t, 1, 19)) for t in times]) if len(times) > 1 else F.try_to_timestamp(F.substring(times[0], 1, 19))


def retention_candidates(df: DataFrame, touched: str, now: str, days: int) -> DataFrame:
    """RET-02: idle days, aged, days until due. An unreadable time is never aged."""
    idle = F.datediff(F.to_date(F.lit(now)), F.to_date(touched))
    return df.withColumn("idle", idle).withColumn("aged", F.coalesce(F.col("idle") >= days, F.lit(False))).withColumn("due_in", F.greatest(F.lit(0), F.lit(days) - F.col("idle")))


def oldest_first(candidates: DataFrame, key: str, touched: str = "touched") -> DataFrame:
    """SRT-03: the ones last touched longest ago come first, those without a time before them, then by key."""
    return candidates.orderBy(F.to_date(touched).asc_nulls_first(), key)


def protect_parents(candidates: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """RET-03: parents with submitted children are no candidates."""
    return candidates.join(children.select(key).distinct(), key, "left_anti")


def retention_refusals(requested: DataFrame, candidates: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """RET-04: why a requested key is refused; null if it is not."""
    c = candidates.select(key, F.col("aged").alias("_aged"))
    p = protected.select(key).distinct().withColumn("_kept", F.lit(True))
    joined = requested.join(c, key, "left").join(p, key, "left")
    return joined.select(key, F.when(F.col("_aged").isNull(), "missing").when(F.col("_kept"), "has children").when(~F.col("_aged"), "not aged").alias("reason"))


def purge(tables: list[DataFrame], items: DataFrame, key: str, days: int) -> tuple[DataFrame, list[DataFrame]]:
    """RET-05: tombstones (early is computed from the idle days) and the tables without the purged keys, in their given order."""
    stones = items.select(key, "idle", (F.coalesce(F.col("idle"), F.lit(0)) < days).alias("early"))
    return stones, [t.join(items.select(key).distinct(), key, "left_anti") for t in tables]


def purge_run(tables: list[tuple[str, DataFrame]], items: DataFrame, key: str, days: int, target: str, before: Callable[[str], None] = lambda step: None) -> None:
    """RET-05 on disk: tombstones first, then each table without the purged keys, in the given order (derived ones, sources, ledger).

    Each step is written whole and then noted in ``target``'s log; a run that broke off goes on with the first step that isn't
    noted. What is purged is read from the tombstones, so a run that goes on purges what it set out to, whatever
    ``items`` is by then. ``before`` is called with the name of each step that is about to run.
    """
    spark = items.sparkSession
    spark.createDataFrame([], "step string").coalesce(1).write.mode("ignore").parquet(f"{target}/log")
    done = {r["step"] for r in spark.read.schema("step string").parquet(f"{target}/log").collect()}

    def step(name: str, df: DataFrame) -> None:
        if name in done:
            return
        before(name)
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        spark.createDataFrame([(name,)], "step string").coalesce(1).write.mode("append").parquet(f"{target}/log")

    stones, _ = purge([], items, key, days)
    step("tombstones", stones)
    gone = spark.read.schema(stones.schema).parquet(f"{target}/tombstones").select(key).distinct()
    for name, table in tables:
        step(name, table.join(gone, key, "left_anti"))
