"""Queries of sources, projections, filters, reconciliation, registry and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.functions import dictionaries as D
from tallyforge.functions import text as T
from tallyforge.operators import reconcile as R
from tallyforge.operators import standardise as S
from tallyforge.plans.bindings import bind, prelude
from tallyforge.plans.register import Register
from tallyforge.sources import records as X
from tallyforge.streaming.streams import shared_folder

Q = Register()
_NO = "regexp_replace(upper({c}), '[^0-9A-Z]', '', 'g')"
_FILES = ", f AS (SELECT stem, stem || '.txt' AS name, md5(model || channel) AS md5, chars AS size, processed_at AS archived_at FROM qc), o AS (SELECT stem, name, CASE WHEN size % 3 = 0 THEN 'x' ELSE md5 END AS md5, '2026-01-01' AS archived_at FROM f WHERE size % 2 = 0) "


def _files(q):
    return q.select("stem", F.concat("stem", F.lit(".txt")).alias("name"), F.md5(F.concat("model", "channel")).alias("md5"), F.col("chars").alias("size"), F.col("processed_at").alias("archived_at"))


def _old(q):
    return _files(q).where("size % 2 = 0").withColumn("md5", F.when(F.col("size") % 3 == 0, "x").otherwise(F.col("md5"))).withColumn("archived_at", F.lit("2026-01-01"))


Q.add("src_03_manifest", ["qc"], lambda q: X.manifest(_files(q), _old(q)), _FILES + "SELECT f.stem, f.name, f.md5, f.size, CASE WHEN f.md5 = o.md5 THEN o.archived_at ELSE f.archived_at END AS archived_at FROM f LEFT JOIN o USING (stem, name)")
Q.add("src_04_pending_inputs", ["qc"], lambda q: X.pending_inputs(_files(q), _old(q), q.where("num % 5 <> 0")).select("stem", "md5"), _FILES + "SELECT f.stem, f.md5 FROM f WHERE NOT EXISTS (SELECT 1 FROM o JOIN qc ON qc.stem = o.stem AND qc.num % 5 <> 0 WHERE o.stem = f.stem AND o.md5 = f.md5)")
Q.add(
    "src_05_reuse_cached",
    ["qc"],
    lambda q: X.reuse_cached(q.select("stem", "model", "channel"), q.select("stem", F.when(F.col("num") % 2 == 0, F.col("model")).alias("model"), "channel", F.col("chars").cast("string").alias("value")), "stem", ["model", "channel"], "value"),
    "SELECT stem, model, channel, CASE WHEN num % 2 = 0 THEN CAST(chars AS STRING) END AS value FROM qc",
)
Q.add(
    "src_07_normalise_lines",
    ["transcripts"],
    lambda t: t.select("stem", X.normalise_lines(F.col("raw")).alias("l")).select("stem", X.full_text(F.col("l")).alias("full"), F.explode("l").alias("l"))
    .select("stem", "full", "l.i", "l.text", F.array_join(F.transform("l.bbox", lambda x: x.cast("int").cast("string")), ",").alias("bbox"), F.coalesce("l.page", F.lit(0)).cast("long").alias("page")),
    """, body AS (SELECT stem, num, trim(replace(replace(raw, '```json' || chr(10), ''), chr(10) || '```', ''))::JSON AS j FROM transcripts),
    items AS (SELECT stem, unnest(list_transform(range(0, json_array_length(j, '$.lines')::BIGINT), lambda k: {'k': k, 'v': json_extract(j, '$.lines[' || k || ']')})) AS it FROM body),
    parts AS (SELECT stem, it.k AS k, CASE WHEN json_type(it.v) = 'OBJECT' THEN coalesce(it.v ->> '$.text', '') ELSE it.v ->> '$' END AS text,
      CASE WHEN json_type(it.v, '$.bbox') = 'ARRAY' AND json_array_length(it.v, '$.bbox') = 4 THEN array_to_string(CAST(json_extract(it.v, '$.bbox') AS INTEGER[]), ',') END AS bbox, coalesce(CAST(it.v ->> '$.page' AS BIGINT), 0) AS page, json_type(it.v) AS kind FROM items),
    kept AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY k) AS i FROM parts WHERE text <> '')
    SELECT stem, string_agg(text, chr(10)) OVER (PARTITION BY stem ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS "full", i, text, bbox, page FROM kept""",
)
_FILE = "'{\"s_suppkey\": ' || s_suppkey || ', \"s_name\": \"' || s_name || CASE WHEN s_acctbal < 0 THEN '' ELSE '\"}' END"


def _folder(spark, sf_dir):
    """A folder with a file for each supplier; those with a debt are cut off."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    X.write_records(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr(_FILE).alias("value")), folder)
    return folder


_SUPPLIER = StructType().add("s_suppkey", "long").add("s_name", "string")
_read = lambda spark, d: X.read_records(spark, _folder(spark, d), _SUPPLIER, "txt")
Q.queries["src_01_read_records"] = lambda spark, d: _read(spark, d).select(F.when(F.col("_corrupt_record").isNull(), F.col("s_suppkey")).alias("s_suppkey"), F.when(F.col("_corrupt_record").isNull(), F.col("s_name")).alias("s_name"), F.col("_corrupt_record").isNotNull().alias("corrupt"))
Q.oracles["src_01_read_records"] = "SELECT CASE WHEN s_acctbal >= 0 THEN s_suppkey END AS s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_name END AS s_name, s_acctbal < 0 AS corrupt FROM supplier"
Q.queries["src_02_list_inputs"] = lambda spark, d: X.list_inputs(spark, _folder(spark, d), ["TXT"]).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
Q.oracles["src_02_list_inputs"] = f"SELECT count(*) AS files, CAST(sum(strlen({_FILE}) + 1) AS BIGINT) AS bytes FROM supplier"


def _compacted(spark, sf_dir):
    out = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    good = _read(spark, sf_dir).where("_corrupt_record IS NULL").select("s_suppkey", "s_name")
    X.compact(good, out)
    return spark.read.schema(_SUPPLIER).parquet(out)


Q.queries["src_06_compact"] = _compacted
Q.oracles["src_06_compact"] = "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 0"
Q.add(
    "src_08_record_to_lines",
    ["finals"],
    lambda f: X.record_to_lines(f, "stem", {"SHIPPER": "SHIPPER", "GOODS": "CARGO"}).select("stem", F.col("i").cast("long").alias("i"), "text"),
    "SELECT stem, CAST(1 AS BIGINT) AS i, 'SHIPPER: ' || trim(SHIPPER) AS text FROM finals WHERE trim(SHIPPER) <> '' UNION ALL SELECT stem, CASE WHEN trim(SHIPPER) <> '' THEN 2 ELSE 1 END, 'CARGO: ' || GOODS FROM finals",
)
Q.add(
    "src_10_upsert",
    ["tickets", "finals"],
    lambda t, f: X.upsert(t.select("stem", "SHIPPER"), f.where("num % 2 = 0").select("stem", "SHIPPER"), "stem", ~T.blank(F.col("SHIPPER")))[0],
    "SELECT t.stem, CASE WHEN t.num % 2 = 0 AND trim(f.SHIPPER) <> '' THEN f.SHIPPER ELSE t.SHIPPER END AS SHIPPER FROM tickets t JOIN finals f ON f.stem = t.stem",
)
Q.add("src_11_delete_keys", ["tickets", "ledger"], lambda t, l: X.delete_keys([t.select("stem", "num")], l, "stem")[0], "SELECT stem, num FROM tickets WHERE stem NOT IN (SELECT stem FROM ledger)")
_CHECKS = lambda q: q.withColumn("flags", F.transform(F.sequence(F.lit(0), F.col("flags")), lambda i: F.concat(F.lit("f"), i)))
Q.add(
    "src_12_export_view",
    ["finals", "qc"],
    lambda f, q: X.export_view(f.withColumn("stem", F.concat(F.lit("D"), F.col("num"))), _CHECKS(q), ["MAWB_NO", "GOODS"]),
    "SELECT 'D' || f.num AS stem, f.MAWB_NO, f.GOODS, CASE WHEN q.stem IS NULL THEN 'none' WHEN q.needs_review = 1 THEN 'yes' ELSE 'no' END AS needs_review, CASE WHEN q.stem IS NULL THEN '' ELSE array_to_string(list_transform(range(0, q.flags + 1), lambda i: 'f' || i), '；') END AS flags FROM finals f LEFT JOIN qc q ON q.stem = 'D' || f.num",
)
_RUN = lambda q: q.where("num % 4 <> 0").withColumn("checked", F.col("chars") % 40).withColumn("passed", F.col("chars") % 30)
Q.add("src_14_run_report", ["qc"], lambda q: X.run_report(q, _RUN(q)).withColumn("channel", F.coalesce("channel", F.lit("all"))),
      """, r AS (SELECT * FROM qc WHERE num % 4 <> 0)
      SELECT coalesce(q.channel, 'all') AS channel, count(*) AS files, count(*) FILTER (WHERE r.stem IS NOT NULL AND trim(r.error) = '') AS ok, count(*) FILTER (WHERE trim(r.error) <> '') AS failed, count(*) FILTER (WHERE r.stem IS NULL) AS skipped,
      count(*) FILTER (WHERE r.needs_review = 1) AS review, CAST(coalesce(sum(r.chars % 40), 0) AS BIGINT) AS checked, CAST(coalesce(sum(r.chars % 30), 0) AS BIGINT) AS passed FROM qc q LEFT JOIN r ON q.stem = r.stem GROUP BY GROUPING SETS ((q.channel), ())""")
Q.add("src_14_review_list", ["qc"], lambda q: X.review_list(_CHECKS(q)).select("stem", "channel", F.size("flags").cast("long").alias("n")), "SELECT stem, channel, flags + 1 AS n FROM qc WHERE needs_review = 1")
Q.add("prj_01_contract", ["finals"], lambda f: X.to_contract(f, ["stem", "SHIPPER", "TAX"]), "SELECT stem, SHIPPER, '' AS TAX FROM finals")
Q.add("prj_02_submit_projection", ["finals"], lambda f: X.submit_projection(f.select("stem", "GOODS", "SHIPPER"), {"GOODS": "CARGO"}, ["SHIPPER"]), "SELECT stem, GOODS AS CARGO FROM finals")
Q.add(
    "prj_03_clean_partial",
    ["finals"],
    lambda f: f.select("stem", S.clean_partial(F.create_map(F.lit("MAWB_NO"), "MAWB_NO", F.lit("A_TEL"), "SHIPPER")).alias("m")).select("stem", F.col("m")["MAWB_NO"].alias("mawb"), F.col("m")["A_TEL"].alias("tel"), F.expr("map_contains_key(m, 'A_FAX')").alias("fax_given")),
    "SELECT stem, substr(replace(MAWB_NO, '-', ''), 1, 3) || '-' || substr(replace(MAWB_NO, '-', ''), 4) AS mawb, CASE WHEN trim(SHIPPER) <> '' THEN regexp_replace(SHIPPER, '[^0-9A-Za-z]', '', 'g') END AS tel, false AS fax_given FROM finals",
)
_SPEC = "concat(CASE k % 3 WHEN 0 THEN 'SHIPPER' WHEN 1 THEN 'CONSIGNEE' ELSE 'AGENT' END, '_INFO_', CASE k % 2 WHEN 0 THEN 'POSTAL' ELSE 'ADDRESS' END)"
Q.add("prj_04_actionable_cells", ["id_cells"], lambda d: X.actionable(d.select("k", F.expr(_SPEC).alias("field")), ["POSTAL", "STATE", "TEL"]), f"SELECT k, {_SPEC} AS field FROM id_cells WHERE k % 3 < 2 AND k % 2 = 0")
Q.add("flt_01_day_window", ["qc"], lambda q: q.where(T.in_window(F.col("processed_at"), "2026-09-05", "2026-09-09")).select("stem"), "SELECT stem FROM qc WHERE substr(processed_at, 1, 10) BETWEEN '2026-09-05' AND '2026-09-09'")
Q.add("flt_03_valid_keys", ["finals"], lambda f: f.select("stem", X.valid_key(F.col("HAWB_NO"), "number").alias("number_ok"), X.valid_key(F.concat("SHIPPER", F.when(F.col("num") % 4 == 0, "/x").otherwise("")), "path").alias("path_ok")), f"SELECT stem, regexp_matches({_NO.format(c='HAWB_NO')}, '^[0-9A-Z]{{6,20}}$') AS number_ok, num % 4 <> 0 AND trim(SHIPPER) <> '' AS path_ok FROM finals")
_IDX = f", i AS (SELECT {_NO.format(c='mawb')} || '|' || {_NO.format(c='hawb')} AS number_key, arg_max(stem, submitted_at) AS stem FROM ledger GROUP BY 1) "
Q.add("jn_02_enrich_remote", ["remote", "ledger"], lambda r, l: R.enrich_remote(r, R.number_index(l, "submitted_at")).select("num", "state", "stem"), _IDX + f"SELECT num, state, coalesce(i.stem, '—') AS stem FROM remote LEFT JOIN i ON i.number_key = {_NO.format(c='MAWB')} || '|' || {_NO.format(c='HAWB')}")
Q.add("jn_03_number_index", ["ledger"], lambda l: R.number_index(l, "submitted_at"), _IDX + "SELECT * FROM i")
Q.add("jn_04_existence_checked_lookup", ["ledger", "qc"], lambda l, q: R.lookup_stem(R.number_index(l, "submitted_at").select("number_key"), R.number_index(l, "submitted_at"), l.where("num % 3 = 0")), _IDX + "SELECT number_key, CASE WHEN CAST(substr(stem, 2) AS BIGINT) % 3 = 0 THEN stem END AS stem FROM i")
Q.add("jn_05_children_of_master", ["finals", "masters"], lambda f, m: R.children_of(f, f.where("num % 50 = 0").select(F.col("MAWB_NO").alias("mawb"))).select("stem"), f"SELECT stem FROM finals WHERE {_NO.format(c='MAWB_NO')} IN (SELECT {_NO.format(c='MAWB_NO')} FROM finals WHERE num % 50 = 0)")
Q.add("jn_06_local_pending", ["qc", "masters"], lambda q, m: R.local_pending(q.select("stem", F.col("num").alias("cust"), F.when(F.col("error") != "", "failed").when(F.col("num") % 3 == 0, "submitted").when(F.col("num") % 3 == 1, "staged").otherwise("parsed").alias("state"), "processed_at", "uploader"), m, "cust", ["processed_at", "uploader"]),
      "SELECT stem, CASE num % 3 WHEN 1 THEN 'staged' ELSE 'parsed' END AS state, processed_at, uploader FROM qc WHERE error = '' AND num % 3 <> 0 AND num IN (SELECT cust FROM masters)")
Q.add(
    "jn_07_merge_remote_local",
    ["remote", "finals"],
    lambda r, f: R.merge_remote_local(r.withColumnRenamed("MAWB", "n"), f.select(F.col("MAWB_NO").alias("n"), "num"), "n"),
    f", b AS (SELECT {_NO.format(c='MAWB')} AS no, 'remote' AS side, 1 AS rank, num FROM remote UNION ALL SELECT {_NO.format(c='MAWB_NO')}, 'local', 0, num FROM finals) SELECT no, arg_max(side, rank * 1000000000 + num) AS side, arg_max(num, rank * 1000000000 + num) AS num, count(*) AS copies FROM b GROUP BY no",
)
Q.add("jn_08_dictionary_join", ["id_cells"], lambda d: S.standardise(d.select("k", F.when(F.col("k") % 2 == 0, "Brazil.").otherwise("Atlantis").alias("c")), "c", D.countries(d.sparkSession), "iso2").select("k", "iso2"), "SELECT k, CASE WHEN k % 2 = 0 THEN 'BR' END AS iso2 FROM id_cells")
Q.add("jn_09_rightmost_phrase", ["id_cells"], lambda d: S.rightmost_phrase(d.select("k", F.when(F.col("k") % 2 == 0, "Road 1, New York, United States").otherwise("Paris France 7").alias("t")), "k", "t", D.countries(d.sparkSession)).select("k", "phrase"), "SELECT k, CASE WHEN k % 2 = 0 THEN 'UNITED STATES' ELSE 'FRANCE' END AS phrase FROM id_cells")
Q.add("jn_10_longest_prefix", ["id_cells"], lambda d: S.longest_prefix(d, "tel", D.dial_codes(d.sparkSession)).select("k", F.col("prefix_iso2").alias("dialled")), "SELECT k, CASE k % 4 WHEN 0 THEN 'CN' WHEN 1 THEN 'SE' WHEN 2 THEN 'FI' ELSE 'IE' END AS dialled FROM id_cells")
Q.add("jn_12_backfill", ["finals", "masters"], lambda f, m: R.backfill_plan(f, m, "cust", {"SHIPPER": "goods", "GOODS": "goods"}), "SELECT stem, 'SHIPPER' AS field, m.goods AS \"to\" FROM finals f JOIN masters m USING (cust) WHERE trim(SHIPPER) = ''")
Q.add("jn_13_whole_row_merge", ["remote", "finals"], lambda r, f: R.whole_row_merge(r.select("num", F.col("SHIPPER_NAME").alias("SHIPPER"), F.col("state").cast("string").alias("STATE")), f.select("num", "SHIPPER"), "num", ["SHIPPER", "STATE"]), "SELECT f.num, nullif(trim(f.SHIPPER), '') AS SHIPPER, CAST(r.state AS STRING) AS STATE FROM finals f LEFT JOIN remote r ON r.num = f.num")
_STORED = {"GOODS": "COALESCE(air_DEST_NAME, '')", "PIECES": "WEIGHT", "P_EORI": "'SE5563646560 / CNPJ: 1234567'", "P_TAX": "''", "NOTE": "'kept'"}
_map = lambda cells: F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), F.expr(v))])


def _ours(p):
    given = _map({"P_EORI": "SHIPPER_INFO_EORI", "PIECES": "CASE num % 3 WHEN 0 THEN ' ' ELSE air_WEIGHT END"})
    return F.when(F.col("num") % 2 == 0, F.map_concat(given, _map({"GOODS": "CASE num % 4 WHEN 0 THEN NULL ELSE '' END"}))).otherwise(given)


_long = lambda c: lambda p: p.select("stem", F.explode(c(p)).alias("k", "v")).withColumn("v", F.coalesce("v", F.lit("(null)")))
_GIVEN = "CASE WHEN num % 2 = 0 THEN CASE num % 4 WHEN 0 THEN '(null)' ELSE '' END ELSE air_DEST_NAME END"
Q.add("jn_13_overlay", ["pairs"], _long(lambda p: R.overlay(_map({k: v for k, v in _STORED.items() if k != "NOTE"}), _ours(p), ["GOODS", "PIECES", "NOTE"])),
      f"SELECT stem, 'GOODS' AS k, {_GIVEN} AS v FROM pairs UNION ALL SELECT stem, 'PIECES', CASE num % 3 WHEN 0 THEN ' ' ELSE air_WEIGHT END FROM pairs UNION ALL SELECT stem, 'NOTE', '(null)' FROM pairs")
Q.add("jn_13_house_row", ["pairs"], _long(lambda p: R.whole_row(_map(_STORED), _ours(p), list(_STORED), ["PIECES"], ["P"])),
      f"""SELECT stem, 'GOODS' AS k, {_GIVEN} AS v FROM pairs UNION ALL SELECT stem, 'PIECES', CASE num % 3 WHEN 0 THEN '(null)' ELSE air_WEIGHT END FROM pairs UNION ALL SELECT stem, 'NOTE', 'kept' FROM pairs
      UNION ALL SELECT stem, 'P_EORI', CASE num % 5 WHEN 0 THEN 'SE' || right(SHIPPER_INFO_POSTAL, 6) WHEN 1 THEN '(null)' WHEN 2 THEN '(null)' ELSE 'IT03268900267' END FROM pairs
      UNION ALL SELECT stem, 'P_TAX', CASE num % 5 WHEN 0 THEN '(null)' WHEN 1 THEN 'VATNO' || num WHEN 2 THEN '(null)' ELSE CAST(num AS VARCHAR) END FROM pairs""")
Q.add(
    "jn_14_three_way_merge",
    ["tickets", "finals"],
    lambda t, f: t.select("stem", "num", F.create_map(F.lit("G"), "GOODS").alias("b")).join(f.select("stem", F.create_map(F.lit("G"), "GOODS").alias("x")), "stem").select("stem", F.inline(R.three_way_merge(F.col("b"), F.col("x"), F.when(F.col("num") % 2 == 0, F.create_map(F.lit("G"), F.lit("new"))).otherwise(F.col("b"))))).select("stem", "v", "conflict"),
    "SELECT f.stem, CASE WHEN f.num % 13 = 5 THEN f.GOODS WHEN f.num % 2 = 0 THEN 'new' ELSE t.GOODS END AS v, f.num % 13 = 5 AND f.num % 2 = 0 AND f.GOODS <> t.GOODS AS conflict FROM finals f JOIN tickets t ON t.stem = f.stem",
)
Q.add("jn_15_authoritative_version", ["ledger", "tickets"], lambda l, t: R.authoritative(l, t.where("num % 2 = 0").select("stem", F.concat("CREATE_TIME", F.when(F.col("num") % 4 == 0, "T11:00:00").otherwise("T10:00:00")).alias("staged_at"))), ", s AS (SELECT stem, CREATE_TIME || CASE WHEN num % 4 = 0 THEN 'T11:00:00' ELSE 'T10:00:00' END AS staged_at FROM tickets WHERE num % 2 = 0) SELECT coalesce(l.stem, s.stem) AS stem, CASE WHEN s.staged_at IS NULL OR l.submitted_at >= s.staged_at THEN 'submitted' ELSE 'staged' END AS version FROM ledger l FULL JOIN s ON s.stem = l.stem")
Q.add("jn_16_parent_gate", ["finals", "masters"], lambda f, m: R.parent_gate(f.select("stem", "cust"), m, "cust").select("stem", "parent"), "SELECT stem, CASE WHEN m.sent = 1 THEN 'sent' WHEN m.sent = 0 THEN 'not sent' ELSE 'unknown' END AS parent FROM finals f LEFT JOIN masters m ON m.cust = f.cust")
_TTL = {"valid": 20, "invalid": 7}
for _n in ("jn_18_fresh_status", "reg_02_registry_flags"):
    _only = _n.startswith("reg")
    Q.add(
        _n,
        ["qc"],
        lambda q, only=_only: R.fresh_status(q.select("num"), q.select("num", F.when(F.col("num") % 2 == 0, "valid").otherwise("invalid").alias("status"), (F.col("num") % 30).alias("checked_at")), 30, _TTL).where(F.lit(not only) | (F.col("status") == "invalid")),
        "SELECT * FROM (SELECT num, CASE WHEN num % 2 = 0 AND 30 - num % 30 < 20 THEN 'valid' WHEN num % 2 = 1 AND 30 - num % 30 < 7 THEN 'invalid' END AS status FROM qc)" + (" WHERE status = 'invalid'" if _only else ""),
    )
_GATE = lambda f, l, m: R.submission_gate(R.parent_gate(f.join(l.select("stem", F.lit(True).alias("s")), "stem", "left"), m, "cust").select("stem", F.coalesce("s", F.lit(False)).alias("already_sent"), F.col("MAWB_NO").alias("mawb"), F.when(F.col("num") % 19 > 0, F.col("HAWB_NO")).alias("hawb"), F.array(F.lit("a"), F.lit("b")).alias("flags"), F.when(F.col("num") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("acked"), "parent"))
Q.add("rec_01_submission_gate", ["finals", "ledger", "masters"], lambda f, l, m: _GATE(f, l, m).select("stem", "verdict"), "SELECT f.stem, CASE WHEN l.stem IS NOT NULL THEN 'sent' WHEN f.num % 19 = 0 THEN 'number' WHEN f.num % 3 = 0 THEN 'flags' WHEN m.sent = 0 THEN 'parent' ELSE 'pass' END AS verdict FROM finals f LEFT JOIN ledger l ON l.stem = f.stem LEFT JOIN masters m ON m.cust = f.cust")
Q.add("rec_04_fingerprints", ["finals"], lambda f: f.select("stem", R.fingerprint({"g": F.col("GOODS"), "a": F.col("MAWB_NO")}).alias("sha"), F.md5("GOODS").alias("md5"), F.sha1("MAWB_NO").alias("sha1")), """SELECT stem, sha256('{"a":"' || MAWB_NO || '","g":"' || GOODS || '"}') AS sha, md5(GOODS) AS md5, sha1(MAWB_NO) AS sha1 FROM finals""")
Q.add("rec_06_status_gate", ["remote", "finals"], lambda r, f: f.join(r.select("num", "state"), "num", "left").select("stem", R.status_gate(F.col("state")).alias("gate")), "SELECT f.stem, CASE WHEN r.state IS NULL OR r.state = 0 THEN 'write' ELSE 'locked' END AS gate FROM finals f LEFT JOIN remote r ON r.num = f.num")
Q.add("rec_07_preread_guard", ["ledger", "remote"], lambda l, r: R.preread_guard(l.select("stem", "num"), r, "num").select("stem", "guard"), "SELECT stem, CASE WHEN num IN (SELECT num FROM remote) THEN 'ok' ELSE 'error' END AS guard FROM ledger")
Q.add(
    "rec_08_self_echo",
    ["finals"],
    lambda f: R.exclude_self_echo(f.select("stem", F.lit("GOODS").alias("label"), F.concat("GOODS", F.lit("-")).alias("value")), f.where("num % 3 > 0").select("stem", F.when(F.col("num") % 3 == 1, "GOODS").otherwise("OTHER").alias("label")), f.select("stem", F.lit("GOODS").alias("label"), F.col("GOODS").alias("value"))).select("stem", "verdict"),
    "SELECT stem, CASE num % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'kept' ELSE 'echo' END AS verdict FROM finals",
)
Q.add("rec_09_missed_columns", ["finals"], lambda f: R.missed_columns(f.select("stem", F.lit("SHIPPER").alias("field"), F.col("SHIPPER").alias("value")), f.select("stem", F.lit(1).alias("i"), F.concat(F.lit("SHIPPER: "), "GOODS").alias("text"))), "SELECT stem, 'SHIPPER' AS field, GOODS AS seen FROM finals WHERE trim(SHIPPER) = ''")
Q.add("rec_10_backfill_flags", ["finals", "masters"], lambda f, m: R.backfill_flags(R.backfill_plan(f, m, "cust", {"SHIPPER": "goods"}), f.select("stem", F.lit("SHIPPER").alias("field"), F.when(F.col("num") % 2 == 0, "by hand").otherwise("").alias("value"))), "SELECT stem, 'SHIPPER' AS field, m.goods AS \"to\" FROM finals f JOIN masters m USING (cust) WHERE trim(SHIPPER) = '' AND f.num % 2 = 1")
Q.add("reg_01_skipped_prefixes", ["id_cells"], lambda d: R.registry_numbers(d, "k", "cell", skip=("GB", "SE")), "SELECT k, regexp_extract(cell, 'IT[0-9]+') AS num FROM id_cells WHERE k % 8 = 3")
Q.add("reg_01_registry_numbers", ["id_cells"], lambda d: R.registry_numbers(d, "k", "cell"), "SELECT k, CASE k % 8 WHEN 2 THEN cell ELSE regexp_extract(cell, 'IT[0-9]+') END AS num FROM id_cells WHERE k % 8 IN (2, 3)")
Q.add("reg_03_page_verdict", ["finals"], lambda f: f.select("stem", R.page_verdict(F.concat(F.lit("<p>This number is "), F.when(F.col("num") % 3 == 0, "not valid.").when(F.col("num") % 3 == 1, "Valid.").otherwise("unknown"), F.lit("</p>"))).alias("verdict")), "SELECT stem, CASE num % 3 WHEN 0 THEN 'invalid' WHEN 1 THEN 'valid' ELSE 'unreachable' END AS verdict FROM finals")
_TOUCH = "CASE WHEN num % 9 = 0 THEN 'soon' ELSE processed_at END"
_NOW = "2026-10-20"


def _cands(q):
    return R.retention_candidates(q.withColumn("touched", R.last_touched(F.expr(_TOUCH), F.lit("?"))), "touched", _NOW, 30)


_AGED = f", c AS (SELECT *, CASE WHEN num % 9 > 0 THEN date_diff('day', CAST(substr(processed_at, 1, 10) AS DATE), DATE '{_NOW}') END AS idle FROM qc), d AS (SELECT *, coalesce(idle >= 30, false) AS aged FROM c) "
Q.add("ret_01_last_touched", ["qc"], lambda q: q.select("stem", F.date_format(R.last_touched(F.expr(_TOUCH), F.lit("?")), "yyyy-MM-dd").alias("day")), "SELECT stem, CASE WHEN num % 9 > 0 THEN substr(processed_at, 1, 10) END AS day FROM qc")
Q.add("ret_02_retention_candidates", ["qc"], lambda q: _cands(q).select("stem", "aged", F.col("due_in").cast("long").alias("due_in")), _AGED + "SELECT stem, aged, CAST(CASE WHEN idle IS NULL THEN 0 ELSE greatest(0, 30 - idle) END AS BIGINT) AS due_in FROM d")
Q.add("srt_03_oldest_first", ["qc"], lambda q: R.oldest_first(_cands(q), "stem").limit(50).withColumn("place", F.monotonically_increasing_id()).select("stem", "place"),
      _AGED + "SELECT stem, row_number() OVER (ORDER BY CASE WHEN num % 9 > 0 THEN substr(processed_at, 1, 10) END NULLS FIRST, stem) - 1 AS place FROM d QUALIFY place < 50")
Q.add("ret_03_parent_protection", ["masters", "ledger", "tickets"], lambda m, l, t: R.protect_parents(m, t.join(l.select("stem"), "stem", "left_semi"), "cust").select("mawb"), "SELECT mawb FROM masters WHERE cust NOT IN (SELECT cust FROM tickets WHERE stem IN (SELECT stem FROM ledger))")
Q.add("ret_04_refusals", ["qc"], lambda q: R.retention_refusals(q.select("stem"), _cands(q).where("num % 7 > 0"), q.where("num % 5 = 0"), "stem"), _AGED + "SELECT stem, CASE WHEN num % 7 = 0 THEN 'missing' WHEN num % 5 = 0 THEN 'has children' WHEN NOT aged THEN 'not aged' END AS reason FROM d")
Q.add("ret_05_purge", ["qc"], lambda q: R.purge([q], _cands(q).where("aged OR num % 2 = 0"), "stem", 30)[0].select("stem", "early"), _AGED + "SELECT stem, coalesce(idle, 0) < 30 AS early FROM d WHERE aged OR num % 2 = 0")
def _purged(spark, sf_dir):
    """What a purge leaves of three tables, and its tombstones."""
    q, u, e = (bind(spark, sf_dir, n) for n in ("qc", "usage", "stage_events"))
    target = f"{shared_folder(spark)}/purge-{uuid.uuid4().hex}"
    tables = [("usage", u.select("stem", "stage")), ("qc", q.select("stem", "num")), ("stage_events", e.select("stem", "seq"))]
    R.purge_run(tables, _cands(q).where("aged OR num % 2 = 0"), "stem", 30, target)
    out = None
    for name in ("tombstones", *[n for n, _ in tables]):
        part = spark.read.parquet(f"{target}/{name}").groupBy("stem").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "stem", "n")
        out = part if out is None else out.unionByName(part)
    return out


Q.queries["ret_05_purge_tables"] = _purged
Q.oracles["ret_05_purge_tables"] = prelude("qc", "usage", "stage_events") + _AGED.lstrip() + """, g AS (SELECT stem FROM d WHERE aged OR num % 2 = 0)
SELECT 'tombstones' AS kind, stem, count(*) AS n FROM g GROUP BY stem UNION ALL SELECT 'usage', stem, count(*) FROM usage WHERE stem NOT IN (SELECT stem FROM g) GROUP BY stem
UNION ALL SELECT 'qc', stem, count(*) FROM qc WHERE stem NOT IN (SELECT stem FROM g) GROUP BY stem UNION ALL SELECT 'stage_events', stem, count(*) FROM stage_events WHERE stem NOT IN (SELECT stem FROM g) GROUP BY stem"""
Q.add("set_01_all_keys", ["qc", "ledger", "stage_events"], lambda q, l, e: q.select("stem").union(l.select("stem")).union(e.select("stem")).distinct(), "SELECT stem FROM qc UNION SELECT stem FROM ledger UNION SELECT stem FROM stage_events")
_FLAGS = lambda q: q.select("stem", F.transform(F.sequence(F.lit(1), F.col("flags") + 1), lambda i: F.concat(F.lit("f"), i)).alias("flags"), F.array(F.lit("f1"), F.lit("f3")).alias("acked"))
Q.add("set_03_open_flags", ["qc"], lambda q: _FLAGS(q).select("stem", F.array_join(F.array_except("flags", "acked"), ",").alias("open")), "SELECT stem, array_to_string(list_filter(list_transform(range(1, flags + 2), lambda i: 'f' || i), lambda x: x NOT IN ('f1', 'f3')), ',') AS open FROM qc")
Q.add("set_04_flag_union", ["qc"], lambda q: _FLAGS(q).select("stem", F.array_join(F.concat("acked", F.array_except("flags", "acked")), ",").alias("merged")), "SELECT stem, array_to_string(list_concat(['f1', 'f3'], list_filter(list_transform(range(1, flags + 2), lambda i: 'f' || i), lambda x: x NOT IN ('f1', 'f3'))), ',') AS merged FROM qc")
Q.add("set_05_blank_tiers", ["finals"], lambda f: f.select("stem", R.blank_tiers(F.lit(None), F.create_map(F.lit("SHIPPER"), "SHIPPER", F.lit("TAX"), F.lit("")), F.array(F.lit("TAX"))).alias("t")).select("stem", F.array_join("t.acked", ",").alias("acked"), F.array_join("t.skipped", ",").alias("skipped")), "SELECT stem, 'TAX' AS acked, CASE WHEN trim(SHIPPER) = '' THEN 'SHIPPER' ELSE '' END AS skipped FROM finals")
