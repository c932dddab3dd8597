"""Queries of validation, evidence, usage, ledgers, standardisation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import dictionaries as D
from tallyforge.functions import text as T
from tallyforge.operators import events as E
from tallyforge.operators import evidence as V
from tallyforge.operators import reports as P
from tallyforge.operators import standardise as S
from tallyforge.operators import validate as L
from tallyforge.plans.bindings import prelude
from tallyforge.plans.register import Register
from tallyforge.streaming import streams as ST

Q = Register()

# --- validation -----------------------------------------------------------------


def _records(f):
    """Records with every kind of fault, by the ticket's number."""
    n = F.col("num")
    df = f.select(
        "stem",
        F.when(n % 5 == 0, "").when(n % 5 == 1, F.regexp_replace("MAWB_NO", "-", "")).otherwise(F.col("MAWB_NO")).alias("MAWB_NO"),
        F.when(n % 6 == 0, "").when(n % 6 == 1, "131-3306253").otherwise(F.col("HAWB_NO")).alias("HAWB_NO"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "LH").when(n % 4 == 2, "CA949").otherwise("FRA").alias("TO1"),
        F.when(n % 3 == 0, "Frankfurt").when(n % 3 == 1, "FRA").otherwise("").alias("DEST_NAME"),
        F.when(n % 7 == 0, "0").when(n % 7 == 1, "1.5").when(n % 7 == 2, "x").otherwise(F.col("PIECES")).alias("PIECES"),
        F.when(n % 8 == 0, "").otherwise(F.col("WEIGHT")).alias("WEIGHT"),
        F.when(n % 9 == 0, "").when(n % 9 == 1, "26-09-01").otherwise(F.col("CREATE_TIME")).alias("CREATE_TIME"),
        F.when(n % 10 == 0, "Atlantis").when(n % 10 == 1, "").otherwise("brazil").alias("COUNTRY"),
        F.when(n % 4 == 0, "HS 1234").when(n % 4 == 1, "123456, 1234").otherwise("none").alias("GOODS"),
        F.when(n % 11 == 0, F.repeat(F.lit("x"), 51)).otherwise("s").alias("SHIPPER"),
    )
    return S.country_iso2(df, "COUNTRY", D.countries(f.sparkSession))


_M = "CASE num % 5 WHEN 0 THEN '' WHEN 1 THEN replace(MAWB_NO, '-', '') ELSE MAWB_NO END"
_DIGITS = f"replace({_M}, '-', '')"
_RULES = {
    "VAL-01a": "num % 4 = 1", "VAL-01b": "num % 4 = 2", "VAL-02": "num % 4 = 0 AND num % 3 <> 2", "VAL-03a": "num % 30 = 0", "VAL-03b": "num % 5 = 0 AND num % 6 <> 0", "VAL-03c": "num % 6 = 0 AND num % 5 <> 0",
    "VAL-04": "num % 6 = 1", "VAL-05a": "num % 7 = 0", "VAL-05b": "num % 8 = 0", "VAL-06a": "num % 9 = 0", "VAL-06b": "num % 9 = 1", "VAL-10": "num % 10 = 0", "VAL-13": "num % 3 = 0", "VAL-14": "num % 5 <> 0 AND (num % 5 = 1 OR num % 7 = 2)",
    "VAL-15": "num % 7 = 2", "VAL-16": "num % 4 <> 1", "VAL-17": "num % 11 = 0", "VAL-21a": "num % 5 = 0", "VAL-21b": f"num % 5 <> 0 AND TRY_CAST(substr({_DIGITS}, 4, 7) AS INT) % 7 <> TRY_CAST(substr({_DIGITS}, 11, 1) AS INT)",
    "VAL-22": "num % 10 = 0", "VAL-25": "num % 9 = 1", "VAL-26": "num % 7 = 1",
}
_FLAGGED = " UNION ALL ".join(f"SELECT stem, '{k}' AS rule_id FROM finals WHERE {v}" for k, v in _RULES.items())
Q.add("val_flags", ["finals"], lambda f: L.validate(_records(f), L.record_rules()).select("stem", "rule_id"), _FLAGGED)
for _k in ("01", "02", "03", "04", "05", "06", "10", "13", "14", "15", "16", "17", "21", "22", "25", "26"):
    _own = " UNION ALL ".join(f"SELECT stem, '{k}' AS rule_id FROM finals WHERE {v}" for k, v in _RULES.items() if k.startswith(f"VAL-{_k}"))
    Q.add(f"val_{_k}_rule", ["finals"], lambda f, k=_k: L.validate(_records(f), [r for r in L.record_rules() if r.rule_id.startswith(f"VAL-{k}")]).select("stem", "rule_id"), _own)
_BODY = "CASE k % 8 WHEN 0 THEN 14 WHEN 1 THEN 9 WHEN 2 THEN 12 WHEN 5 THEN 18 END"
_POSTAL = "((iso2 = 'CN' AND length(postal) <> 6) OR (iso2 = 'SE' AND length(postal) <> 5) OR (iso2 = 'BR' AND length(postal) <> 8) OR (iso2 = 'US' AND length(postal) NOT IN (5, 9)))"
_SHAPES = {
    "07": ("VAL-07", "iso2 <> CASE k % 4 WHEN 0 THEN 'CN' WHEN 1 THEN 'SE' WHEN 2 THEN 'FI' ELSE 'IE' END"),
    "08": ("VAL-08", "k % 8 <> 2"),
    "11": ("VAL-11", _POSTAL),
    "12": ("VAL-12", "length(postal) < 6"),
    "23": ("VAL-23", "contains(tel, ' / ')"),
    "09_phone": ("VAL-09a", "contains(tel, ' / ')"),
}


def _shaped(d):
    """Cells that break the rules: an HS cell that begins with the postal code, the second number of a phone cell, a phone for an id."""
    first, second = F.substring_index("tel", " / ", 1), F.substring_index("tel", " / ", -1)
    two = F.contains("tel", F.lit(" / "))
    return {
        "VAL-12": d.withColumn("goods", F.concat("postal", F.lit(","), F.regexp_extract("goods", r"(\d{7})", 1))),
        "VAL-23": d.withColumn("tel", second),
        "VAL-09a": d.withColumn("cell", F.when(two, first).otherwise(F.col("cell"))).withColumn("tel", first),
    }
for _k, (_id, _sql) in _SHAPES.items():
    Q.add(f"val_{_k}_rule", ["id_cells"], lambda d, i=_id: L.validate(_shaped(d).get(i, d), [r for r in L.shape_rules() if r.rule_id == i], "k").select("k", "rule_id"), f"SELECT k, '{_id}' AS rule_id FROM id_cells WHERE {_sql}")
Q.add(
    "val_09_rule",
    ["id_cells"],
    lambda d: L.validate(d, [r for r in L.shape_rules() if r.rule_id in ("VAL-09b", "VAL-09c")], "k").select("k", "rule_id"),
    "SELECT k, 'VAL-09b' AS rule_id FROM id_cells WHERE iso2 = 'CN' AND k % 8 IN (0, 1, 2, 3, 5, 6, 7) AND NOT (k % 8 = 5 AND length(CAST(k + 911100000000 AS STRING)) = 12) UNION ALL SELECT k, 'VAL-09c' FROM id_cells WHERE iso2 <> 'CN' AND k % 8 = 6",
)
Q.add("val_24_rule", ["id_cells"], lambda d: L.validate(d, [r for r in L.shape_rules() if r.rule_id == "VAL-24"], "k").select("k", "severity"), "SELECT k, 'hint' AS severity FROM id_cells WHERE iso2 <> 'CN' AND k % 8 = 6")
for _n in ("val_18_ids_in_text", "evd_08_labelled_ids"):
    Q.add(_n, ["id_cells"], lambda d: d.select("k", F.array_join(L.number_in_text("cell", "rec"), ",").alias("missing")) if "rec" in d.columns else d.withColumn("rec", F.when(F.col("k") % 16 < 8, F.col("cell")).otherwise("")).select("k", F.array_join(L.number_in_text("cell", "rec"), ",").alias("missing")),
          "SELECT k, CASE WHEN k % 16 < 8 THEN '' WHEN k % 8 = 0 THEN substr(cell, 7) WHEN k % 8 = 1 THEN substr(cell, 5) WHEN k % 8 = 3 THEN 'IT' || CAST(k + 3268000000 AS STRING) || ',' || CAST(k + 20000000 AS STRING) WHEN k % 8 = 5 THEN substr(cell, 6) ELSE '' END AS missing FROM id_cells")
Q.add("val_19_recompute", ["finals"], lambda f: L.recompute_at_submission(L.validate(_records(f), L.record_rules()), f.where("num % 2 = 0").select("stem", F.lit("VAL-05a").alias("rule_id"), F.lit("PIECES").alias("field"))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")),
      f", v AS ({_FLAGGED}) SELECT rule_id, count(*) AS n FROM v WHERE rule_id NOT IN ('VAL-21a', 'VAL-21b', 'VAL-22', 'VAL-25', 'VAL-26') AND NOT (rule_id = 'VAL-05a' AND CAST(substr(stem, 2) AS BIGINT) % 2 = 0) GROUP BY rule_id")
Q.add("val_20_qc_record", ["finals"], lambda f: L.qc_record(f, L.validate(_records(f), L.record_rules()), f.select("stem", F.when(F.col("num") % 6 == 5, "OSError: disk").alias("error"))).select("stem", F.size("flags").cast("long").alias("n"), "needs_review"),
      f", v AS ({_FLAGGED}), g AS (SELECT stem, count(*) AS n FROM v WHERE rule_id NOT IN ('VAL-21a', 'VAL-21b', 'VAL-22', 'VAL-25', 'VAL-26') GROUP BY stem) SELECT f.stem, coalesce(g.n, 0) + CASE WHEN f.num % 6 = 5 THEN 1 ELSE 0 END AS n, coalesce(g.n, 0) + CASE WHEN f.num % 6 = 5 THEN 1 ELSE 0 END > 0 AS needs_review FROM finals f LEFT JOIN g USING (stem)")
Q.add("udx_01_user_rules", ["finals"], lambda f: L.validate(f, [L.Rule("USER-1", "GOODS", F.col("GOODS").rlike("^[a-z]"), "lower case")]).select("stem", "rule_id"), "SELECT stem, 'USER-1' AS rule_id FROM finals WHERE num % 13 = 5")

# --- evidence -------------------------------------------------------------------


def _lines(t):
    """Three lines for a ticket; the second value runs over two lines."""
    rows = F.array(F.concat(F.lit("SHIPPER "), "SHIPPER"), F.concat(F.lit("CARGO "), F.lit("STEEL")), F.concat(F.lit("PARTS "), F.col("GOODS"), F.lit(" MAWB "), F.col("MAWB_NO"), F.lit(" HS CODE:852610")))
    return t.select("stem", F.posexplode(rows).alias("p", "text")).select("stem", (F.col("p") + 1).alias("i"), "text")


def _fields(t):
    rows = [("SHIPPER", "text", F.col("SHIPPER")), ("CARGO", "text", F.lit("STEEL PARTS")), ("OTHER", "text", F.when(F.col("num") % 2 == 0, F.lit("absent")).otherwise(F.lit(""))), ("MAWB_NO", "master", F.col("MAWB_NO")), ("GOODS", "alnum", F.col("GOODS")), ("LONG", "long", F.concat(F.lit("cargo steel parts "), F.col("GOODS"))), ("IDS", "ids", F.lit("852610 / CODE:852610"))]
    return t.select("stem", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), v.alias("value")) for f, k, v in rows])))


Q.add("evd_07_missed_masters", ["tickets"], lambda t: t.select("stem", F.array_join(V.missed_masters(F.concat(F.lit("MAWB "), "MAWB_NO"), F.when(F.col("num") % 2 == 0, F.col("MAWB_NO"))), ",").alias("missed")), "SELECT stem, CASE WHEN num % 2 = 1 AND CAST(substr(MAWB_NO, 5, 7) AS INT) % 7 = CAST(substr(MAWB_NO, 12, 1) AS INT) THEN replace(MAWB_NO, '-', '') ELSE '' END AS missed FROM tickets")
Q.add("evd_11_ranked_lines", ["tickets"], lambda t: V.ranked_lines(_fields(t).where("field IN ('GOODS', 'SHIPPER')"), _lines(t)).select("stem", "field", "i", "score"), "SELECT stem, 'GOODS' AS field, 3 AS i, 2 AS score FROM tickets UNION ALL SELECT stem, 'SHIPPER', 1, 2 FROM tickets")
Q.add("fn_23_anchor_lines", ["tickets"], lambda t: V.anchor_lines(_fields(t).where("field IN ('GOODS', 'MAWB_NO')").select("stem", "field", "value"), t.where("num % 2 = 0").select("stem", F.lit("MAWB_NO").alias("field"), F.array(F.lit(1), F.lit(2)).alias("sources")), _lines(t)).select("stem", "field", F.array_join("lines", ",").alias("lines")), "SELECT stem, 'GOODS' AS field, '3' AS lines FROM tickets UNION ALL SELECT stem, 'MAWB_NO', CASE WHEN num % 2 = 0 THEN '1,2' ELSE '3' END FROM tickets")

# --- usage, ledgers -----------------------------------------------------------------
_TOK = ["calls", "prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens"]
_STAGES = ["render", "l1", "l2", "l3"]
_U = f", p AS (SELECT stem, {', '.join(f'sum({c}) AS {c}' for c in _TOK)}, {', '.join(f"sum(CASE WHEN stage = '{s}' THEN millis END) AS sec_{s}" for s in _STAGES)} FROM usage GROUP BY stem) "
_SUMS = "count(*) AS tickets, count(*) FILTER (WHERE trim(error) <> '') AS failed, count(*) FILTER (WHERE needs_review = 1) AS flagged, " + ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in _TOK) + ", " + ", ".join(f"CAST(sum(coalesce(sec_{s}, 0)) AS DOUBLE) / 1000.0 AS sec_{s}" for s in _STAGES) + " FROM qc LEFT JOIN p USING (stem)"
Q.add("agg_01_usage_totals", ["qc", "usage"], lambda q, u: P.usage_report(q, u, []), _U + f"SELECT {_SUMS}")
Q.add("agg_02_usage_report", ["qc", "usage"], lambda q, u: P.usage_report(q.withColumn("day", F.substring("processed_at", 1, 10)), u, ["day", "model"]).withColumns({c: F.coalesce(c, F.lit("all")) for c in ("day", "model")}),
      _U + f"SELECT coalesce(day, 'all') AS day, coalesce(model, 'all') AS model, * EXCLUDE (day, model) FROM (SELECT substr(processed_at, 1, 10) AS day, model, {_SUMS} GROUP BY GROUPING SETS ((substr(processed_at, 1, 10)), (model), ()))")
Q.add("agg_02_usage_by_stage", ["qc", "usage"], lambda q, u: P.usage_by_stage(q, u, "2026-09-05", "2026-09-20"), "SELECT stage, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _TOK) + " FROM usage JOIN qc USING (stem) WHERE substr(processed_at, 1, 10) BETWEEN '2026-09-05' AND '2026-09-20' GROUP BY stage")
_KIND = "CASE WHEN error LIKE '%imeout%' THEN 'timeout' WHEN error LIKE '%转录失败%' THEN 'transcription' ELSE 'OSError' END"
Q.add("agg_03_failure_kinds", ["qc"], P.failure_kinds, f"SELECT {_KIND} AS error_kind, count(*) AS n FROM qc WHERE error <> '' GROUP BY 1")
Q.add("udx_02_user_kinds", ["qc"], lambda q: P.failure_kinds(q, q.sparkSession.createDataFrame([("disk trouble", "disk", 0), ("rest", "Error", 1)], "kind string, keyword string, precedence int")), "SELECT CASE WHEN error LIKE '%disk%' THEN 'disk trouble' WHEN error LIKE '%Error%' THEN 'rest' ELSE error END AS error_kind, count(*) AS n FROM qc WHERE error <> '' GROUP BY 1")
Q.add("agg_09_day_counts", ["qc"], lambda q: P.day_counts(q.withColumn("state", E.derive_state(F.col("error"), F.col("num") % 3 == 0, F.lit(False)))), "SELECT count(*) AS total, count(*) FILTER (WHERE error = '' AND num % 3 = 0) AS submitted, count(*) FILTER (WHERE error = '' AND num % 3 <> 0) AS pending, count(*) FILTER (WHERE error <> '') AS failed, CAST(sum(flags) AS BIGINT) AS flags, count(*) FILTER (WHERE flags > 0) AS flagged FROM qc")
Q.add("agg_10_child_counts", ["masters", "tickets"], lambda m, t: P.child_counts(m, t.where("num % 3 = 0"), "cust").select("mawb", "children"), "SELECT m.mawb, count(t.stem) AS children FROM masters m LEFT JOIN tickets t ON t.cust = m.cust AND t.num % 3 = 0 GROUP BY m.mawb")
Q.add("win_08_share_of_max", ["qc"], lambda q: P.share_of_max(q.select("stem", "chars"), "chars").select("stem", F.round("share", 9).alias("share")), "SELECT stem, round(chars / max(chars) OVER (), 9) AS share FROM qc")
Q.add("srt_01_ledger_order", ["qc", "masters"], lambda q, m: q.select("stem", F.col("processed_at").alias("at")).unionByName(m.select(F.col("mawb").alias("stem"), F.col("first_day").alias("at"))).orderBy("at", "stem"), "SELECT stem, processed_at AS \"at\" FROM qc UNION ALL SELECT mawb, first_day FROM masters")
Q.add("srt_02_flag_first", ["qc"], lambda q: q.orderBy(*P.flag_first("flags", F.col("num") % 2 == 0, "num")).select("stem", "flags"), "SELECT stem, flags FROM qc")
Q.add("srt_05_keep_newest", ["qc"], lambda q: P.keep_newest(q, "processed_at", 20, "num").select("stem", "processed_at"), "SELECT stem, processed_at FROM qc ORDER BY processed_at DESC NULLS LAST, num LIMIT 20")

# --- standardisation jobs ------------------------------------------------------------


def _house(f):
    n = F.col("num")
    return f.select("stem", "MAWB_NO", F.when(n % 2 == 0, "Tokyo").otherwise("Frankfurt").alias("TO1"), F.when(n % 3 == 0, "Peking").otherwise("Paris").alias("ORIGIN_NAME"), F.when(n % 2 == 0, "Germany").otherwise("Slovak Republic (SK)").alias("CONSIGNEE_INFO_COUNTRY"), F.lit("+49 (30) 11-22 / 5").alias("CONSIGNEE_INFO_TEL"), F.concat("SHIPPER", F.lit(", Ltd.")).alias("SHIPPER"), F.lit("x").alias("SHIPPER_INFO_CITY"))


def _std(f):
    s = f.sparkSession
    return S.standardise_house(_house(f), D.countries(s), D.cities(s), {"SHIPPER_INFO_CITY": "BEIJING"})


_STD = "SELECT stem, CASE WHEN contains(MAWB_NO, '-') THEN MAWB_NO ELSE MAWB_NO END AS MAWB_NO, CASE WHEN num % 2 = 0 THEN 'TYO' ELSE 'FRA' END AS TO1, CASE WHEN num % 3 = 0 THEN 'BEIJING' ELSE 'PAR' END AS ORIGIN_NAME, CASE WHEN num % 2 = 0 THEN 'DE' ELSE 'SK' END AS CONSIGNEE_INFO_COUNTRY, '49301122' AS CONSIGNEE_INFO_TEL, trim(regexp_replace(regexp_replace(SHIPPER || ', Ltd.', '[^0-9A-Za-z\\s]', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS SHIPPER, 'BEIJING' AS SHIPPER_INFO_CITY FROM finals"
Q.add("std_01_house_job", ["finals"], _std, _STD)
_AMS = lambda m: m.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("ams"))
_SYM = "trim(regexp_replace(regexp_replace({0}, '[^0-9A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NONE = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in D.MASTER_COLUMNS if c not in ("MAWB_NO", "GOODS_INFO_HSCODE", "SLAC", "SHIPPER_INFO_COMP_NAME", "SHIPPER_INFO_COUNTRY", "CONSIGNEE_INFO_COUNTRY", "CONSIGNEE_INFO_POSTAL", "CONSIGNEE_INFO_TEL", "CONSIGNEE_INFO_EORI", "NOTIFY_INFO_AEO", "NOTIFY_INFO_EMAIL"))
_CELL = "max(CASE WHEN col = '{0}' THEN cell END)"
Q.add(
    "std_02_master_job",
    ["master_cells"],
    lambda m: S.master_body(_AMS(m).withColumn("ams", S.standardise_master(F.col("ams"))).withColumn("given", F.array_join(F.array_sort(F.map_keys("ams")), ",")), "ams", ["stem", "given"]).withColumn("SLAC", F.col("SLAC").cast("string")),
    f""", c AS (SELECT stem, string_agg(CASE WHEN col <> 'SEND_STATUS' THEN col END, ',' ORDER BY col) AS given, {', '.join(f"{_CELL.format(c)} AS {c}" for c in ("MAWB_NO", "GOODS_INFO_HSCODE", "SLAC", "SHIPPER_INFO_COMP_NAME", "SHIPPER_INFO_COUNTRY", "CONSIGNEE_INFO_COUNTRY", "CONSIGNEE_INFO_POSTAL", "CONSIGNEE_INFO_TEL", "CONSIGNEE_INFO_EORI", "NOTIFY_INFO_AEO", "NOTIFY_INFO_EMAIL"))} FROM master_cells GROUP BY stem),
    d AS (SELECT *, regexp_replace(MAWB_NO, '[^0-9]', '', 'g') AS no, list_transform(regexp_extract_all(GOODS_INFO_HSCODE, '[0-9]{{4,}}'), lambda x: substr(x, 1, 6)) AS hs FROM c)
    SELECT stem, given, CASE WHEN length(no) = 11 THEN substr(no, 1, 3) || '-' || substr(no, 4) ELSE trim(MAWB_NO) END AS MAWB_NO, CASE WHEN len(hs) > 0 THEN array_to_string(hs, ',') WHEN trim(GOODS_INFO_HSCODE) <> '' THEN trim(GOODS_INFO_HSCODE) END AS GOODS_INFO_HSCODE,
    CAST(CAST(TRY_CAST(SLAC AS DOUBLE) AS BIGINT) AS VARCHAR) AS SLAC, {_SYM.format('SHIPPER_INFO_COMP_NAME')} AS SHIPPER_INFO_COMP_NAME, CASE WHEN contains(given, 'SHIPPER_INFO_COUNTRY') THEN 'CN' END AS SHIPPER_INFO_COUNTRY, {_SYM.format('upper(CONSIGNEE_INFO_COUNTRY)')} AS CONSIGNEE_INFO_COUNTRY, CONSIGNEE_INFO_POSTAL,
    regexp_replace(string_split(CONSIGNEE_INFO_TEL, ' / ')[1], '[^0-9A-Za-z]', '', 'g') AS CONSIGNEE_INFO_TEL, replace(replace(upper(replace(CONSIGNEE_INFO_EORI, ' / ', '|')), ' ', ''), '|', ' / ') AS CONSIGNEE_INFO_EORI, {_SYM.format("replace(upper(NOTIFY_INFO_AEO), ' ', '')")} AS NOTIFY_INFO_AEO, {_SYM.format('NOTIFY_INFO_EMAIL')} AS NOTIFY_INFO_EMAIL, {_NONE} FROM d""",
)
Q.add("std_03_address_residual", ["finals"], lambda f: S.address_residual(f.select("stem", F.concat(F.lit("Road 1, TEL +49 301122334, "), "COUNTRY", F.lit(", VAT 123456789")).alias("address"), "COUNTRY"), "stem", "address", ["COUNTRY"]).select("stem", "street"), "SELECT stem, 'Road 1' AS street FROM finals")
_STATES = "CASE iso2 WHEN 'BR' THEN 'São Paulo' WHEN 'US' THEN 'new  york' ELSE 'X' END"


def _cells_of(d):
    """A party with a postal code, with a zero width space in some, and a state."""
    return d.select("k", F.concat("postal", F.when(F.col("iso2") == "SE", F.lit("\u200b")).otherwise("")).alias("A_POSTAL"), F.expr(_STATES).alias("A_STATE"), F.col("iso2").alias("A_COUNTRY"))


_FORM = "CASE WHEN iso2 = 'BR' AND length(postal) = 8 THEN substr(postal, 1, 5) || '-' || substr(postal, 6) WHEN iso2 = 'SE' AND length(postal) = 5 THEN substr(postal, 1, 3) || ' ' || substr(postal, 4) WHEN iso2 = 'US' AND length(postal) = 9 THEN substr(postal, 1, 5) || '-' || substr(postal, 6) END"
Q.add(
    "acc_07_change_preview",
    ["id_cells"],
    lambda d: S.change_preview(_cells_of(d), "k", ["A"], D.countries(d.sparkSession), D.states(d.sparkSession)).select("k", "field", "to", "rule", "why"),
    f"""SELECT k, 'A_POSTAL' AS field, coalesce({_FORM}, postal) AS "to", CASE WHEN iso2 = 'SE' THEN 'CHARS' || CASE WHEN {_FORM} IS NULL THEN '' ELSE '+POSTAL' END ELSE 'POSTAL' END AS rule,
    CASE WHEN iso2 = 'SE' THEN 'characters of the print' || CASE WHEN {_FORM} IS NULL THEN '' ELSE '; form of SE' END ELSE 'form of ' || iso2 END AS why FROM id_cells WHERE iso2 = 'SE' OR {_FORM} IS NOT NULL
    UNION ALL SELECT k, 'A_STATE', CASE iso2 WHEN 'BR' THEN 'SP' ELSE 'NY' END, CASE iso2 WHEN 'BR' THEN 'STATE' ELSE 'CHARS+STATE' END, CASE iso2 WHEN 'BR' THEN 'form of BR' ELSE 'characters of the print; form of US' END FROM id_cells WHERE iso2 IN ('BR', 'US')""",
)


def _parties(f):
    """A house party whose address repeats its postal code, city and country, with commas or without."""
    parts = {"A_POSTAL": F.substring("MAWB_NO", 5, 5), "A_STATE": F.lit(""), "A_CITY": F.upper("GOODS"), "A_COUNTRY": F.col("COUNTRY")}
    rows = f.where("trim(SHIPPER) <> ''").select("stem", "num", T.fold_ws(F.col("SHIPPER")).alias("street"), *[c.alias(k) for k, c in parts.items()])
    with_commas = F.concat_ws(", ", "street", "A_POSTAL", "A_CITY", "A_COUNTRY")
    plain = F.concat_ws(" ", "street", "A_POSTAL", "A_CITY", "A_COUNTRY")
    return rows.select("stem", F.when(F.col("num") % 2 == 0, with_commas).otherwise(plain).alias("A_COMP_ADDRESS"), *parts)


_ADDRESSES = """num || ' Long Road, Unit ' || CAST(num % 9 AS STRING) || ', ' || CASE num % 4 WHEN 0 THEN 'Hangzhou, Zhejiang 310000, China' WHEN 1 THEN '10115 Berlin, DE' WHEN 2 THEN 'London SW1A 1AA, United Kingdom' ELSE 'Tel: +55 11 2222, 04546-040 Sao Paulo, Brazil' END"""
_PARTY = {
    "P_COMP_ADDRESS": f"CASE num % 3 WHEN 0 THEN 'VAT NO DE' || CAST(num + 100000000 AS STRING) || ', ' WHEN 1 THEN 'EORI NO IT' || CAST(num + 3268000000 AS STRING) || ', ' ELSE '' END || {_ADDRESSES}",
    "P_EORI": "SHIPPER_INFO_EORI", "P_TAX": "SHIPPER_INFO_TAX", "P_POSTAL": "''", "P_STATE": "''", "P_CITY": "''", "P_COUNTRY": "CASE num % 4 WHEN 0 THEN 'CN' WHEN 1 THEN 'Germany' WHEN 2 THEN 'GB' ELSE 'BRAZIL' END",
}
_join = lambda a, b: f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} ELSE {a} || ' / ' || {b} END"
Q.add(
    "std_03_comma_addresses",
    ["pairs"],
    lambda p: S.streets(S.spread(p.select("stem", F.expr(_ADDRESSES).alias("address"), F.expr(_PARTY["P_COUNTRY"]).alias("country"))).withColumn("country", F.when(F.col("country") == "Germany", "GERMANY").otherwise("")), "address", "country", D.countries(p.sparkSession)).select("stem", "street"),
    "SELECT stem, num || ' LONG ROAD, UNIT ' || (num % 9) AS street FROM pairs",
)
Q.add(
    "std_01_routed_ids",
    ["pairs"],
    lambda p: S.standardise_house(p.select("stem", *[F.expr(v).alias(k) for k, v in _PARTY.items()]), D.countries(p.sparkSession), D.cities(p.sparkSession)).select("stem", "P_EORI", "P_TAX", "P_COMP_ADDRESS"),
    f""", c AS (SELECT stem, num, CASE num % 5 WHEN 0 THEN 'SE' || right(SHIPPER_INFO_POSTAL, 6) WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'IT03268900267' END AS e,
      CASE num % 5 WHEN 0 THEN 'USCI' || substr(SHIPPER_INFO_TAX, 6) WHEN 1 THEN 'VATNO' || num WHEN 2 THEN 'CNPJ112223330001' || (num % 90 + 10) ELSE num || ' / TAXID123456789' END AS t,
      CASE num % 3 WHEN 1 THEN 'EORINOIT' || (num + 3268000000) ELSE '' END AS e2, CASE num % 3 WHEN 0 THEN 'VATNODE' || (num + 100000000) ELSE '' END AS t2 FROM pairs)
    SELECT stem, {_join('e', 'e2')} AS P_EORI, {_join('t', 't2')} AS P_TAX, num || ' LONG ROAD UNIT ' || (num % 9) AS P_COMP_ADDRESS FROM c""",
)
Q.add(
    "std_01_house_addresses",
    ["finals"],
    lambda f: S.standardise_house(_parties(f), D.countries(f.sparkSession), D.cities(f.sparkSession)).select("stem", "A_COMP_ADDRESS"),
    "SELECT stem, trim(regexp_replace(regexp_replace(SHIPPER, '[^0-9A-Za-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS A_COMP_ADDRESS FROM finals WHERE trim(SHIPPER) <> ''",
)
Q.add(
    "udx_01_user_dictionary",
    ["tickets"],
    lambda t: S.standardise(t.select("stem", "COUNTRY"), "COUNTRY", t.select(F.col("COUNTRY").alias("name"), F.substring("COUNTRY", -2, 2).alias("iso2"), F.length("COUNTRY").alias("ord")).distinct(), "code").select("stem", "code"),
    "SELECT stem, right(COUNTRY, 2) AS code FROM tickets",
)

# --- streams, drained to tables ---------------------------------------------------------
Q.queries["str_01_ingest"] = lambda spark, d: ST.drain(ST.ingest(spark, d, "events"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
Q.oracles["str_01_ingest"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
Q.queries["str_02_ingest_dedup"] = lambda spark, d: ST.drain(ST.dedup(ST.ingest(spark, d, "events").select(F.concat("user_id", F.lit("|"), "event_type").alias("key"), "ts"), "key"), "append").select("key")
Q.oracles["str_02_ingest_dedup"] = "SELECT DISTINCT user_id || '|' || event_type AS key FROM events"
Q.queries["str_03_suppress_repeats"] = lambda spark, d: ST.suppress_repeats(ST.ingest(spark, d, "events").select(F.concat(F.lit("F"), "user_id").alias("key"), F.col("event_id").alias("at"), F.floor(F.col("value") / 40).cast("string").alias("fp"), (~F.col("event_type").isin("error", "signup")).alias("ok")), 500)
#: the fold, one event of every key at a time
SUPPRESSED = """, e AS (SELECT name AS key, scan AS "at", CAST(size AS VARCHAR) AS fp, ok = 1 AS ok, row_number() OVER (PARTITION BY name ORDER BY scan, size, ok) AS rn FROM scans),
f AS (SELECT key, rn, "at", fp, true AS accepted, CASE WHEN ok THEN fp END AS mf, CASE WHEN ok THEN "at" END AS ma FROM e WHERE rn = 1
  UNION ALL SELECT e.key, e.rn, e."at", e.fp, NOT coalesce(e.fp = f.mf AND e."at" - f.ma < 500, false), CASE WHEN coalesce(e.fp = f.mf AND e."at" - f.ma < 500, false) THEN f.mf WHEN e.ok THEN e.fp END,
    CASE WHEN coalesce(e.fp = f.mf AND e."at" - f.ma < 500, false) THEN f.ma WHEN e.ok THEN e."at" END FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT key, "at", fp, accepted FROM f"""
Q.oracles["str_03_suppress_repeats"] = prelude("scans").replace("WITH ", "WITH RECURSIVE ", 1) + SUPPRESSED
_STAGE = [
    "'S' || user_id AS stem", "event_id AS seq", "CAST(ts AS STRING) AS at", "'u' || event_id % 7 AS who", "CASE WHEN event_id % 3 = 0 THEN 'inputter' ELSE 'preparer' END AS role",
    "CASE WHEN event_type = 'view' THEN 'review' ELSE 'stage' END AS kind", "CAST(floor(value) AS STRING) AS weight", "event_type AS goods",
]
Q.queries["str_04_fold_events"] = lambda spark, d: ST.drain_latest(ST.fold(ST.ingest(spark, d, "events").selectExpr(*_STAGE), ["weight", "goods"]), "stem", "n_events").select("stem", "weight", "goods", "n_events", "n_staged", "reviewed", "last_who")
_ARG = "arg_max({c}, event_id) FILTER (WHERE event_type <> 'view')"
Q.oracles["str_04_fold_events"] = f"SELECT 'S' || user_id AS stem, {_ARG.format(c='CAST(CAST(floor(value) AS BIGINT) AS STRING)')} AS weight, {_ARG.format(c='event_type')} AS goods, count(*) AS n_events, count(*) FILTER (WHERE event_type <> 'view') AS n_staged, bool_or(event_id % 3 = 0) AS reviewed, arg_max('u' || event_id % 7, event_id) AS last_who FROM events GROUP BY user_id"
Q.queries["str_05_usage_by_day"] = lambda spark, d: ST.drain(ST.usage_by_day(ST.ingest(spark, d, "events")), "complete")
Q.oracles["str_05_usage_by_day"] = "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS amount FROM events GROUP BY 1"
Q.queries["str_06_validation"] = lambda spark, d: ST.drain(L.validate(ST.ingest(spark, d, "events").select("event_id", "event_type", "value"), [L.Rule("S-1", "value", F.col("value") > 100, "large"), L.Rule("S-2", "event_type", F.col("event_type") == "error", "error")], "event_id"), "append").select("event_id", "rule_id")
Q.oracles["str_06_validation"] = "SELECT event_id, 'S-1' AS rule_id FROM events WHERE value > 100 UNION ALL SELECT event_id, 'S-2' FROM events WHERE event_type = 'error'"
Q.queries["str_07_upsert_sink"] = lambda spark, d: ST.upsert_stream(ST.ingest(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type"), "key", "seq")
Q.oracles["str_07_upsert_sink"] = "SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"
_TRIES = ["'F' || user_id AS name", "event_id AS scan", "CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END AS ok"]
Q.queries["str_08_retry_cap"] = lambda spark, d: ST.drain_latest(ST.failures(ST.ingest(spark, d, "events").selectExpr(*_TRIES)), "name", "last").select("name", "failures", "given_up")
Q.oracles["str_08_retry_cap"] = "WITH g AS (SELECT user_id, max(event_id) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS last_ok FROM events GROUP BY user_id) SELECT 'F' || e.user_id AS name, count(*) FILTER (WHERE event_type IN ('error', 'signup') AND event_id > coalesce(last_ok, -1)) AS failures, count(*) FILTER (WHERE event_type IN ('error', 'signup') AND event_id > coalesce(last_ok, -1)) >= 3 AS given_up FROM events e JOIN g ON g.user_id = e.user_id GROUP BY e.user_id"
