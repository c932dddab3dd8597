"""Queries of the scalar functions (FN-*, SRC-09, EVT-01) over their bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import dictionaries as D
from tallyforge.functions import text as T
from tallyforge.operators import standardise as S
from tallyforge.plans.register import Register

Q = Register()


def _select(columns):
    """A query that selects ``columns()``; columns are built inside it, since they need a session."""
    return lambda df: df.select(*columns())


Q.add(
    "fn_01_norm_no",
    ["finals"],
    _select(lambda: ["stem", T.norm_no(F.col("MAWB_NO")).alias("mawb"), T.number_key(F.col("MAWB_NO"), F.col("HAWB_NO")).alias("number_key")]),
    "SELECT stem, regexp_replace(upper(MAWB_NO), '[^0-9A-Z]', '', 'g') AS mawb, regexp_replace(upper(MAWB_NO), '[^0-9A-Z]', '', 'g') || '|' || regexp_replace(upper(HAWB_NO), '[^0-9A-Z]', '', 'g') AS number_key FROM finals",
)
Q.add(
    "fn_02_whitespace_fold",
    ["finals"],
    _select(lambda: ["stem", T.fold_ws(F.col("SHIPPER")).alias("folded"), T.clean_chars(F.concat(F.col("SHIPPER"), F.lit(" ‐​X"))).alias("cleaned"), T.half_width(F.concat(F.col("GOODS"), F.lit("（1，2）"))).alias("half")]),
    "SELECT stem, trim(regexp_replace(SHIPPER, '\\s+', ' ', 'g')) AS folded, trim(regexp_replace(SHIPPER, '\\s+', ' ', 'g') || ' -X') AS cleaned, GOODS || '(1,2)' AS half FROM finals",
)
Q.add(
    "fn_03_accent_fold",
    ["qc"],
    _select(lambda: ["stem", T.bare(F.concat(F.lit("São "), F.col("channel"), F.lit("-Paulo."))).alias("bare"), T.fold_ascii(F.concat(F.lit("Ößø"), F.col("model"))).alias("folded")]),
    "SELECT stem, 'SAO ' || upper(channel) || ' PAULO' AS bare, 'O' || model AS folded FROM qc",
)
Q.add("fn_04_symbols_to_space", ["id_cells"], _select(lambda: ["k", T.sym_to_space(F.col("cell")).alias("plain")]), "SELECT k, trim(regexp_replace(regexp_replace(cell, '[^0-9A-Za-z\\s]', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS plain FROM id_cells")
Q.add("fn_05_alnum", ["id_cells"], _select(lambda: ["k", T.alnum(F.col("cell")).alias("a"), T.alnum_upper(F.col("cell")).alias("u")]), "SELECT k, regexp_replace(cell, '[^0-9A-Za-z]', '', 'g') AS a, upper(regexp_replace(cell, '[^0-9A-Za-z]', '', 'g')) AS u FROM id_cells")
Q.add(
    "fn_06_master_number",
    ["finals"],
    _select(lambda: ["stem", T.hyphenate11(F.col("MAWB_NO")).alias("hyphenated"), T.fmt_mawb(F.concat(F.substring("MAWB_NO", 1, 3), F.lit("-PEK"), F.substring("stem", 2, 9))).alias("formatted")]),
    "SELECT stem, substr(replace(MAWB_NO, '-', ''), 1, 3) || '-' || substr(replace(MAWB_NO, '-', ''), 4) AS hyphenated, substr(MAWB_NO, 1, 3) || CASE WHEN length(substr(stem, 2, 9)) = 8 THEN '-' ELSE '-PEK ' END || substr(stem, 2, 9) AS formatted FROM finals",
)
Q.add(
    "fn_07_check_digit",
    ["tickets"],
    _select(lambda: ["stem", T.awb_check_digit(F.substring("MAWB_NO", 5, 8)).alias("ok")]),
    "SELECT stem, CAST(substr(MAWB_NO, 5, 7) AS INT) % 7 = CAST(substr(MAWB_NO, 12, 1) AS INT) AS ok FROM tickets",
)
Q.add(
    "fn_08_hs_codes",
    ["id_cells"],
    _select(lambda: ["k", T.hs6(F.col("goods")).alias("hs6"), T.hs_from_text(F.col("goods")).alias("labelled")]),
    "SELECT k, substr(CAST(k + 8526109 AS STRING), 1, 6) || CASE WHEN k % 4 = 0 THEN ',' || substr(CAST(k + 841000 AS STRING), 1, 6) ELSE '' END AS hs6, CAST(k + 8526109 AS STRING) || CASE WHEN k % 4 = 0 THEN ',' || CAST(k + 841000 AS STRING) ELSE '' END AS labelled FROM id_cells",
)
Q.add(
    "fn_09_phones",
    ["id_cells"],
    _select(lambda: ["k", T.phone_cell(F.col("tel")).alias("cell"), T.clean_phone(F.col("tel")).alias("clean")]),
    "SELECT k, regexp_replace(split_part(tel, ' / ', 1), '[^0-9A-Za-z]', '', 'g') AS cell, regexp_replace(replace(split_part(tel, ' / ', 1), '(0)', ''), '[^0-9+]', '', 'g') AS clean FROM id_cells",
)
_LABEL = "(USCI|CNPJ|CPF|RFC|GST|TAX\\s*ID|TAX\\s*NO|TAX|EORI\\s*(NO|NR|NUMBER)?|EOI\\s*(NO|NR|NUMBER)?|VAT\\s*(NO|NR|NUMBER|ID)|VAT)[#.:\\s]*"
Q.add(
    "fn_10_id_labels",
    ["id_cells"],
    _select(lambda: ["k", T.clean_tax(F.col("cell")).alias("clean"), T.id_cell(F.col("cell")).alias("id_cell")]),
    f"""SELECT k, regexp_replace(regexp_replace(upper(replace(cell, ' ', '')), '^{_LABEL}', ''), '^{_LABEL}', '') AS clean,
    CASE WHEN regexp_matches(upper(cell), '^{_LABEL}') AND NOT regexp_matches(regexp_replace(upper(cell), '^{_LABEL}', ''), '[0-9]') THEN ''
    ELSE regexp_replace(regexp_extract(upper(cell), '^{_LABEL}'), '[^A-Z]', '', 'g') || regexp_replace(regexp_replace(upper(cell), '^{_LABEL}', ''), '[^0-9A-Z]', '', 'g') END AS id_cell FROM id_cells""",
)
Q.add(
    "fn_11_multi_id_cells",
    ["id_cells"],
    _select(lambda: ["k", T.merge_ids(F.col("cell"), F.col("cell")).alias("merged"), F.size(T.split_ids(F.col("cell"))).cast("long").alias("n"), T.classify_id(F.col("cell")).alias("kind"), T.id_join(F.lower("cell")).alias("joined")]),
    f"""SELECT k, CASE WHEN k % 8 = 6 THEN CAST(k AS STRING) ELSE cell END AS merged, len(string_split(cell, ' / ')) AS n,
    CASE WHEN NOT regexp_matches(regexp_replace(upper(cell), '^{_LABEL}', ''), '[0-9]') THEN NULL WHEN k % 8 IN (2, 3) THEN 'eori' ELSE 'tax' END AS kind,
    array_to_string(list_transform(string_split(upper(cell), ' / '), lambda x: replace(x, ' ', '')), ' / ') AS joined FROM id_cells""",
)
Q.add(
    "fn_12_labelled_ids",
    ["id_cells"],
    _select(lambda: ["k", F.array_join(T.labelled_ids(F.col("cell")), ",").alias("all_ids"), T.first_labelled_id(F.col("cell")).alias("first_id")]),
    """SELECT k, array_to_string(list_transform(regexp_extract_all(cell, '(?i)\\b(USCI|CNPJ|CPF|EORI\\s*NO|EORI|VAT\\s*NO|VAT)\\b[^0-9A-Za-z]{0,4}([A-Z]{0,3}[0-9][0-9A-Za-z./-]{5,})', 2), lambda x: upper(x)), ',') AS all_ids,
    upper(coalesce(regexp_extract_all(cell, '(?i)\\b(USCI|CNPJ|CPF|EORI\\s*NO|EORI|VAT\\s*NO|VAT)\\b[^0-9A-Za-z]{0,4}([A-Z]{0,3}[0-9][0-9A-Za-z./-]{5,})', 2)[1], '')) AS first_id FROM id_cells""",
)
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.COUNTRIES.items())
_PICK = "CASE k % 5 WHEN 0 THEN 'China' WHEN 1 THEN 'Slovak Republic (SK)' WHEN 2 THEN 'Vietnam (VNM)' WHEN 3 THEN 'br' ELSE 'Nowhere' END"
Q.add(
    "fn_13_country_codes",
    ["id_cells"],
    lambda df: S.country_iso2(df.select("k", F.expr(_PICK).alias("country")), "country", D.countries(df.sparkSession)).select("k", "country_iso2"),
    "SELECT k, CASE k % 5 WHEN 0 THEN 'CN' WHEN 1 THEN 'SK' WHEN 2 THEN 'VIETNAM (VNM)' WHEN 3 THEN 'BR' ELSE 'NOWHERE' END AS country_iso2 FROM id_cells",
)
_CITY = "CASE k % 6 WHEN 0 THEN 'Manaus' WHEN 1 THEN 'FRA' WHEN 2 THEN 'Beijing Capital International Apt' WHEN 3 THEN 'PEK-PEKING' WHEN 4 THEN 'São Paulo' ELSE 'XXX' END"
for _name in ("fn_14_city_codes", "jn_11_city_lookup"):
    Q.add(
        _name,
        ["id_cells"],
        lambda df: S.city_code(df.select("k", F.expr(_CITY).alias("city")), "city", D.cities(df.sparkSession)).select("k", "city_code", S.origin_place(F.col("city_code")).alias("origin")),
        "SELECT k, CASE k % 6 WHEN 0 THEN 'MAO' WHEN 1 THEN 'FRA' WHEN 2 THEN 'BJS' WHEN 3 THEN 'BJS' WHEN 4 THEN 'SAO' ELSE 'XXX' END AS city_code, CASE k % 6 WHEN 0 THEN 'MAO' WHEN 1 THEN 'FRA' WHEN 2 THEN 'BEIJING' WHEN 3 THEN 'BEIJING' WHEN 4 THEN 'SAO' ELSE 'XXX' END AS origin FROM id_cells",
    )
Q.add(
    "fn_15_postal_format",
    ["id_cells"],
    _select(lambda: ["k", T.postal_format(F.col("postal"), F.col("iso2")).alias("postal")]),
    """SELECT k, CASE WHEN iso2 = 'BR' AND length(postal) = 8 THEN substr(postal, 1, 5) || '-' || substr(postal, 6) WHEN iso2 = 'SE' AND length(postal) = 5 THEN substr(postal, 1, 3) || ' ' || substr(postal, 4)
    WHEN iso2 = 'US' AND length(postal) = 9 THEN substr(postal, 1, 5) || '-' || substr(postal, 6) END AS postal FROM id_cells""",
)
Q.add(
    "fn_16_state_codes",
    ["id_cells"],
    lambda df: S.state_code(df.select("k", "iso2", F.expr("CASE k % 3 WHEN 0 THEN 'são paulo' WHEN 1 THEN 'New York' ELSE 'BAVARIA' END").alias("state")), "state", "iso2", D.states(df.sparkSession)).select("k", "state_code"),
    "SELECT k, CASE WHEN k % 3 = 0 AND iso2 = 'BR' THEN 'SP' WHEN k % 3 = 1 AND iso2 = 'US' THEN 'NY' END AS state_code FROM id_cells",
)
Q.add("fn_17_date_candidates", ["qc"], lambda df: df.select("stem", F.array_join(S.date_candidates(F.concat(F.lit("Issued 20-Sep-26 or 2026年9月22日, flight "), F.substring("processed_at", 1, 10))), ",").alias("dates")), "SELECT stem, array_to_string(list_sort(list_distinct(['2026-09-20', '2026-09-22', substr(processed_at, 1, 10)])), ',') AS dates FROM qc")
# every printed form of a ticket's day; the SQL starts from the day: years of two figures are of this century, days before months may be read either way
Q.add(
    "fn_17_printed_forms",
    ["printed_days"],
    lambda p: p.select("stem", F.array_join(S.date_candidates(F.col("text")), ",").alias("dates")),
    """SELECT stem, CASE WHEN form = 7 THEN '--' || substr(day, 6) WHEN form IN (2, 5) THEN '20' || substr(day, 3)
    WHEN form = 1 AND CAST(substr(day, 9, 2) AS INT) <= 12 THEN array_to_string(list_sort(list_distinct([day, substr(day, 1, 4) || '-' || substr(day, 9, 2) || '-' || substr(day, 6, 2)])), ',') ELSE day END AS dates FROM printed_days""",
)
Q.add(
    "fn_18_tokens",
    ["id_cells"],
    _select(lambda: ["k", F.array_join(T.tokens(F.concat("goods", F.lit(" A&B"))), "|").alias("tokens")]),
    "SELECT k, array_to_string(list_filter(regexp_split_to_array(goods || ' A&B', '[^0-9A-Za-z&]+'), lambda x: x <> ''), '|') AS tokens FROM id_cells",
)
Q.add(
    "fn_19_error_kind",
    ["qc"],
    lambda df: S.error_kind(df, "error").select("stem", "error_kind"),
    "SELECT stem, CASE WHEN error = '' THEN '' WHEN error LIKE '%超时%' OR error LIKE '%imeout%' THEN 'timeout' WHEN error LIKE '%转录失败%' THEN 'transcription' WHEN error LIKE '%提取失败%' THEN 'extraction' ELSE substr(trim(split_part(error, ':', 1)), 1, 40) END AS error_kind FROM qc",
)
Q.add(
    "fn_20_unrepr",
    ["qc"],
    _select(lambda: ["stem", T.unrepr(F.concat(F.lit("['"), F.col("channel"), F.lit("', '"), F.col("model"), F.lit("']"))).alias("listed"), T.unrepr(F.col("model")).alias("kept")]),
    "SELECT stem, channel || ' | ' || model AS listed, model AS kept FROM qc",
)
Q.add(
    "fn_21_loose_numbers",
    ["finals"],
    _select(lambda: ["stem", T.as_num(F.concat(F.lit("1,"), F.col("PIECES"))).alias("num"), T.int_or_none(F.col("WEIGHT")).alias("whole"), T.as_num(F.concat("PIECES", F.lit("d"))).alias("no_num")]),
    "SELECT stem, CAST('1' || PIECES AS DOUBLE) AS num, CAST(CAST(WEIGHT AS DOUBLE) AS BIGINT) AS whole, CAST(NULL AS DOUBLE) AS no_num FROM finals",
)
Q.add("fn_22_flag_column", ["finals"], lambda f: f.select("stem", S.flag_column(F.concat(F.lit("no "), "SHIPPER", F.lit(" in "), "GOODS", F.lit("_INFO"))).alias("column")), """SELECT stem, regexp_extract('no ' || SHIPPER || ' in ' || GOODS || '_INFO', '[A-Z][A-Z0-9]{2,}(_[A-Z0-9]+)*') AS "column" FROM finals""")
Q.add("fn_13_country_full", ["id_cells"], lambda df: S.country_full(df.select("k", "iso2", F.expr(_PICK).alias("country")).withColumn("country", F.when(F.col("k") % 2 == 0, F.col("country")).otherwise(F.col("iso2"))), "country", D.countries(df.sparkSession)).select("k", "country_full"),
      f"SELECT k, CASE WHEN k % 2 = 1 THEN CASE iso2 {' '.join(f"WHEN '{c}' THEN '{n}'" for c, n in {v: k for k, v in D.COUNTRIES.items()}.items())} ELSE '' END ELSE CASE k % 5 WHEN 0 THEN 'CHINA' WHEN 1 THEN 'SLOVAK REPUBLIC' WHEN 2 THEN 'VIETNAM (VNM)' WHEN 3 THEN '{({v: k for k, v in D.COUNTRIES.items()})['BR']}' ELSE 'NOWHERE' END END AS country_full FROM id_cells")
Q.add(
    "fn_22_flag_columns",
    ["cells"],
    lambda df: S.flag_columns(df.select("stem", "field", F.concat("field", F.lit(" missing, see GOODS_X")).alias("flag")), "flag", sorted({"MAWB_NO", "HAWB_NO", "SHIPPER", "COUNTRY", "PIECES", "WEIGHT", "CREATE_TIME", "GOODS"})).select("stem", "field", F.array_join("columns", ",").alias("columns")),
    "SELECT stem, field, field AS columns FROM cells",
)
Q.add(
    "src_09_numeric_coercion",
    ["finals"],
    _select(lambda: ["stem", T.coerce_num(F.concat("PIECES", F.lit(" KGM")), True).alias("whole"), T.coerce_num(F.concat(F.lit("1,"), F.col("PIECES"), F.lit(".5"))).alias("num"), T.coerce_num(F.concat("PIECES", F.lit(".5")), True).cast("string").alias("no_int"), T.coerce_num(F.lit("abc")).alias("no_num")]),
    "SELECT stem, CAST(PIECES AS BIGINT) AS whole, CAST('1' || PIECES || '.5' AS DOUBLE) AS num, CAST(NULL AS STRING) AS no_int, CAST(NULL AS DOUBLE) AS no_num FROM finals",
)
KINDS = "CASE field WHEN 'MAWB_NO' THEN 'no' WHEN 'HAWB_NO' THEN 'no' WHEN 'PIECES' THEN 'int' WHEN 'WEIGHT' THEN 'num' ELSE 'text' END"
#: DuckDB's form of the value comparison, for the oracles
SAME = f"""(CASE WHEN trim(model) = '' AND trim(final) = '' THEN true WHEN trim(model) = '' OR trim(final) = '' THEN false
 WHEN {KINDS} = 'no' THEN regexp_replace(upper(model), '[^0-9A-Z]', '', 'g') = regexp_replace(upper(final), '[^0-9A-Z]', '', 'g')
 WHEN {KINDS} IN ('int', 'num') THEN CAST(model AS DOUBLE) = CAST(final AS DOUBLE) ELSE trim(regexp_replace(model, '\\s+', ' ', 'g')) = trim(regexp_replace(final, '\\s+', ' ', 'g')) END)"""
Q.add("evt_01_same_value", ["cells"], _select(lambda: ["stem", "field", T.same_value(F.expr(KINDS), F.col("model"), F.col("final")).alias("same")]), f"SELECT stem, field, {SAME} AS same FROM cells")
