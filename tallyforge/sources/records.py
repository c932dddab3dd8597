"""Sources and sinks of records (SRC-*, PRJ-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions import text as T


def settle(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a new folder and read from there: what several reports use is computed once and outlives lost executors."""
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def read_records(spark: SparkSession, folder: str, schema: StructType, extension: str = "json") -> DataFrame:
    """SRC-01: one-object JSON files with their stem; snapshots (``all_*``) are skipped, broken files keep a row with ``_corrupt_record``."""
    wide = StructType(list(schema.fields)).add("_corrupt_record", "string")
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", f"*.{extension}").json(folder)
    name = F.col("_metadata.file_name")
    return rows.select("*", F.regexp_replace(name, rf"\.{extension}$", "").alias("stem")).where(~F.col("stem").startswith("all_"))


def list_inputs(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """SRC-02: input files by extension, lock files left out; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin([e.lower() for e in extensions])
    return files.withColumn("name", name).where(wanted & ~F.col("name").startswith("~$"))


def manifest(files: DataFrame, old: DataFrame) -> DataFrame:
    """SRC-03: ``stem, name, md5, size, archived_at``; unchanged files keep their old time."""
    before = old.select("stem", "name", F.col("md5").alias("_md5"), F.col("archived_at").alias("_at"))
    joined = files.join(before, ["stem", "name"], "left")
    return joined.select("stem", "name", "md5", "size", F.when(F.col("md5") == F.col("_md5"), F.col("_at")).otherwise(F.col("archived_at")).alias("archived_at"))


def pending_inputs(files: DataFrame, done: DataFrame, raw: DataFrame) -> DataFrame:
    """SRC-04: inputs without a finished record of the same hash."""
    finished = done.join(raw.select("stem").distinct(), "stem", "left_semi")
    return files.join(finished.select("stem", "md5"), ["stem", "md5"], "left_anti")


def reuse_cached(requests: DataFrame, cache: DataFrame, key: str, parts: list[str], value: str) -> DataFrame:
    """SRC-05: the cached value where every part of the fingerprint agrees (null equals null), else null."""
    stored = cache.select(key, F.struct(*parts).alias("_fp"), F.col(value).alias("_v"))
    joined = requests.join(stored, key, "left")
    same = F.struct(*[F.col(p) for p in parts]).eqNullSafe(F.col("_fp"))
    return joined.withColumn(value, F.when(same, F.col("_v"))).drop("_fp", "_v")


def compact(df: DataFrame, out: str, rows_per_file: int = 1_000_000) -> None:
    """SRC-06: many small files into few, without a shuffle to one task."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(out)


def write_records(records: DataFrame, folder: str) -> None:
    """A file for each record, as text as it is: what a folder of records looks like before ``compact``.

    Making files takes long and their records are short, so all cores write, and each task puts its own files in place.
    """
    spread = records.repartition(4 * records.sparkSession.sparkContext.defaultParallelism)
    spread.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", 2).option("maxRecordsPerFile", 1).text(folder)


def normalise_lines(raw: Column) -> Column:
    """SRC-07: numbered lines (``i, text, bbox, page``) of a transcript printed as JSON, with a fence around it or without.

    ``lines`` holds objects or bare texts, mixed; empty texts go, the others are numbered from 1. A box that isn't four numbers is
    null. Text that is no JSON, and JSON without lines, gives none.
    """
    unfenced = F.array_join(F.filter(F.split(T.strip(raw), "\n"), lambda x: ~F.trim(x).startswith("```")), "\n")
    body = F.try_parse_json(F.when(T.strip(raw).startswith("```"), unfenced).otherwise(T.strip(raw)))
    lines = F.coalesce(F.try_variant_get(body, "$.lines", "array<variant>"), F.array().cast("array<variant>"))

    def line(v: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        text = F.when(is_object, T.text(F.try_variant_get(v, "$.text", "string"))).otherwise(T.text(F.try_variant_get(v, "$", "string")))
        box = F.when(is_object, F.try_variant_get(v, "$.bbox", "array<double>"))
        good = (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull())
        return F.struct(text.alias("text"), F.when(good, box).alias("bbox"), F.when(is_object, F.try_variant_get(v, "$.page", "int")).alias("page"))

    kept = F.filter(F.transform(lines, line), lambda x: x["text"] != "")
    return F.transform(kept, lambda x, i: F.struct((i + 1).alias("i"), x["text"].alias("text"), x["bbox"].alias("bbox"), x["page"].alias("page")))


def full_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def record_to_lines(df: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """SRC-08: ``i, text`` lines ``label: value`` of the non-empty columns, in the order of ``labels``."""
    cells = F.array(*[F.struct(F.lit(label).alias("label"), T.strip(F.col(c)).alias("value")) for c, label in labels.items()])
    kept = F.filter(cells, lambda x: x["value"] != "")
    return df.select(key, F.posexplode(kept).alias("i", "c")).select(key, (F.col("i") + 1).alias("i"), F.concat("c.label", F.lit(": "), "c.value").alias("text"))


def upsert(target: DataFrame, source: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """SRC-10, STR-07: target with the valid source rows in place of those with their keys; the rest is rejected."""
    good = source.where(valid)
    merged = target.join(good.select(key).distinct(), key, "left_anti").unionByName(good.select(*target.columns))
    return merged, source.where(~F.coalesce(valid, F.lit(False)))


def delete_keys(tables: list[DataFrame], keys: DataFrame, key: str) -> list[DataFrame]:
    """SRC-11."""
    return [t.join(keys.select(key).distinct(), key, "left_anti") for t in tables]


def export_view(records: DataFrame, qc: DataFrame, columns: list[str], separator: str = "；") -> DataFrame:
    """SRC-12: stem, columns in contract order, whether the record needs review (``none`` without a check), its flags joined."""
    label = F.when(F.col("_qc").isNull(), "none").when(F.col("_qc"), "yes").otherwise("no")
    checks = qc.select("stem", F.coalesce(F.col("needs_review").cast("boolean"), F.lit(False)).alias("_qc"), "flags")
    flags = F.when(F.col("_qc").isNotNull(), F.array_join(F.coalesce("flags", F.array().cast("array<string>")), separator)).otherwise("")
    return records.select("stem", *columns).join(checks, "stem", "left").select("stem", *columns, label.alias("needs_review"), flags.alias("flags"))


def to_long(summary: DataFrame) -> DataFrame:
    """SRC-13: a one-row summary as ``name, value`` rows."""
    return summary.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in summary.columns])))


def run_report(inputs: DataFrame, qc: DataFrame) -> DataFrame:
    """SRC-14: a row per channel and one for all (``channel`` null): inputs, ok, failed, skipped (inputs without a check of this
    run), how many need review, and the evidence totals (``checked``, ``passed``)."""
    joined = inputs.select("stem", "channel").join(qc.select("stem", "error", "needs_review", "checked", "passed", F.lit(True).alias("_ran")), "stem", "left")
    failed = F.col("_ran") & ~T.blank(F.col("error"))
    return joined.groupingSets([[F.col("channel")], []], F.col("channel")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("_ran") & T.blank(F.col("error"))).alias("ok"), F.count_if(failed).alias("failed"),
        F.count_if(F.col("_ran").isNull()).alias("skipped"), F.count_if(F.col("needs_review") == 1).alias("review"),
        F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"),
    )


def review_list(qc: DataFrame) -> DataFrame:
    """SRC-14: the records to review, with what failed in them."""
    return qc.where("needs_review = 1").select("stem", "channel", "flags")


def recheck(records: DataFrame, flags: DataFrame, evidence: DataFrame, old: DataFrame, history: list[str], key: str = "stem") -> DataFrame:
    """ACC-10: new check records from stored versions: ``flags`` (``key, message``) and ``evidence`` (counts per record, with
    ``failed``) are computed anew, ``history`` columns (when and by whom a record was parsed) are carried over where they are
    not blank. A record without evidence is flagged. Run on its own result it changes nothing.
    """
    raised = flags.groupBy(key).agg(F.array_sort(F.collect_set("message")).alias("_f"))
    found = evidence.select(key, "checked", "passed", F.filter(F.split("failed", ","), lambda x: x != "").alias("_e"))
    kept = old.select(key, *[F.when(~T.blank(F.col(c)), F.col(c)).alias(c) for c in history])
    none = F.array().cast("array<string>")
    missing = F.when(F.col("_e").isNull(), F.array(F.lit("no transcript"))).otherwise(F.transform("_e", lambda x: F.concat(F.lit("evidence: "), x)))
    joined = records.select(key).join(raised, key, "left").join(found, key, "left").join(kept, key, "left")
    all_flags = F.concat(F.coalesce("_f", none), missing)
    return joined.select(key, *history, F.lit("").alias("error"), all_flags.alias("flags"), (F.size(all_flags) > 0).alias("needs_review"), F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("passed", F.lit(0)).alias("passed"))


def to_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-01: exactly these columns in this order; missing ones are empty texts, nulls too."""
    return df.select(*[T.text(F.col(c)).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def submit_projection(df: DataFrame, renames: dict[str, str], skip: list[str]) -> DataFrame:
    """PRJ-02."""
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in df.columns if c not in skip])


def actionable(spec: DataFrame, suffixes: list[str]) -> DataFrame:
    """PRJ-04: fields of a party whose suffix is actionable."""
    return spec.where(F.col("field").rlike("^(SHIPPER|CONSIGNEE|NOTIFY)_INFO_(" + "|".join(suffixes) + ")$"))


def valid_key(c: Column, kind: str) -> Column:
    """FLT-03: a path segment of at most 120 characters, or a number of 6 to 20 letters and digits."""
    if kind == "path":
        return (F.length(c) <= 120) & ~T.blank(c) & ~c.rlike(r"[/\\\x00-\x1f|'\"]") & ~c.isin(".", "..")
    return T.norm_no(c).rlike("^[0-9A-Z]{6,20}$")
