"""Queries of the rules that look at both versions of a record, as printed and as normalised. The DuckDB texts read the cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.dictionaries import LIMIT_50
from tallyforge.operators import evidence as V
from tallyforge.operators import standardise as S
from tallyforge.operators import validate as L
from tallyforge.plans.register import Register

Q = Register()

_flags = lambda rules: lambda p: L.validate(p, rules()).select("stem", "rule_id", "field")


def _union(rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT stem, '{rule}' AS rule_id, '{field}' AS field FROM pairs WHERE {when}" for rule, field, when in rows)


_held = lambda n: f"trim({n}) || trim(coalesce(sent_{n}, '')) <> ''"
Q.add("val_03_sent_version", ["pairs"], _flags(lambda: L.number_rules(("sent_MAWB_NO", "sent_HAWB_NO"))), _union([
    ("VAL-03a", "MAWB_NO", f"NOT ({_held('MAWB_NO')}) AND NOT ({_held('HAWB_NO')})"),
    ("VAL-03b", "MAWB_NO", f"NOT ({_held('MAWB_NO')}) AND {_held('HAWB_NO')}"),
    ("VAL-03c", "HAWB_NO", f"{_held('MAWB_NO')} AND NOT ({_held('HAWB_NO')})"),
]))
_PLACES = ["air_TO1", "air_TO2", "air_DEST_NAME"]
_ORIGINS = sorted(set(S.ORIGIN_NAMES.values()))
_off = lambda n: f"trim({n}) <> '' AND NOT regexp_full_match(trim({n}), '[A-Z]{{3}}')"
Q.add("val_13_places", ["pairs"], _flags(lambda: L.place_rules(_PLACES, "air_ORIGIN_NAME", _ORIGINS)), _union([("VAL-13", n, _off(n)) for n in _PLACES] + [("VAL-13", "air_ORIGIN_NAME", _off("air_ORIGIN_NAME") + f" AND trim(air_ORIGIN_NAME) NOT IN ({', '.join(repr(x) for x in _ORIGINS)})")]))
_LONG = ["SHIPPER_INFO_COUNTRY", "SHIPPER_INFO_STATE", "SHIPPER_INFO_POSTAL", "NOTIFY_INFO_CITY"]
Q.add("val_17_lengths", ["pairs"], _flags(lambda: L.length_rules([n for n in LIMIT_50 if n in _LONG])), _union([("VAL-17", n, f"length({n}) > 50") for n in _LONG]))
Q.add("val_16_codes_only", ["pairs"], lambda p: p.where(~L.codes_only("GOODS_INFO_HSCODE")).select("stem", F.col("GOODS_INFO_HSCODE").alias("cell")), "SELECT stem, GOODS_INFO_HSCODE AS cell FROM pairs WHERE trim(GOODS_INFO_HSCODE) <> '' AND NOT regexp_full_match(trim(GOODS_INFO_HSCODE), '[0-9]{4,}( *, *[0-9]{4,})*')")
_MADE = {"TO1": "air_TO1", "TO2": "air_TO2", "DEST_NAME": "air_DEST_NAME", "ORIGIN_NAME": "air_ORIGIN_NAME", "SHIPPER_INFO_COUNTRY": "air_SHIPPER_INFO_COUNTRY"}
Q.add("val_22_dictionary_gaps", ["pairs"], _flags(lambda: L.gap_rules(_MADE)), _union([("VAL-22", b, f"trim({b}) = '' AND trim({a}) <> ''") for a, b in _MADE.items()]))
_SEG = "list_filter(string_split(trim({n}), ' / '), lambda x: trim(x) <> '')"
_CORE = "length(regexp_replace(regexp_replace(regexp_replace(upper(x), '\\s', '', 'g'), '^(USCI|CNPJ|VATNO|VAT|TAXID)[#.:]*', ''), '[^0-9A-Z]', '', 'g'))"
_CN = "(list_contains(regexp_split_to_array(upper(SHIPPER_INFO_COUNTRY || ' ' || air_SHIPPER_INFO_COUNTRY), '[^A-Z]+'), 'CN') OR contains(upper(SHIPPER_INFO_COUNTRY), 'CHINA'))"
_some = lambda n, test: f"len(list_filter({_SEG.format(n=n)}, lambda x: {test})) > 0"
Q.add("val_24_id_lengths", ["pairs"], _flags(lambda: L.id_length_rules("SHIPPER_INFO_EORI", "SHIPPER_INFO_TAX", ["SHIPPER_INFO_COUNTRY", "air_SHIPPER_INFO_COUNTRY"])), _union([
    ("VAL-24a", "SHIPPER_INFO_EORI", _some("SHIPPER_INFO_EORI", f"{_CORE} < 8")),
    ("VAL-24b", "SHIPPER_INFO_TAX", f"{_CN} AND " + _some("SHIPPER_INFO_TAX", f"{_CORE} > 0 AND {_CORE} <> 18")),
    ("VAL-24c", "SHIPPER_INFO_TAX", f"NOT {_CN} AND " + _some("SHIPPER_INFO_TAX", f"{_CORE} BETWEEN 1 AND 7")),
]))
_KG = "TRY_CAST(regexp_replace({0}, '[^0-9.]', '', 'g') AS DOUBLE)"
Q.add("val_26_number_forms", ["pairs"], _flags(lambda: L.number_form_rules(["air_PIECES"], ["air_WEIGHT"], ("WEIGHT", "air_WEIGHT"))), _union([
    ("VAL-26", "air_PIECES", "trim(air_PIECES) <> '' AND (TRY_CAST(air_PIECES AS DOUBLE) IS NULL OR contains(air_PIECES, '.'))"),
    ("VAL-26", "air_WEIGHT", "trim(air_WEIGHT) <> '' AND TRY_CAST(air_WEIGHT AS DOUBLE) IS NULL"),
    ("VAL-26w", "air_WEIGHT", f"{_KG.format('WEIGHT')} <> 0 AND {_KG.format('air_WEIGHT')} <> 0 AND abs({_KG.format('air_WEIGHT')} - 2 * {_KG.format('WEIGHT')}) < 1e-6"),
]))
Q.add(
    "val_18_routed_ids", ["prints", "print_fields"],
    # with num the prints have the columns that the fields read of them, so both read one shuffle
    lambda p, f: V.whole_print(p, "stem", "num").join(f.groupBy("stem").agg(F.array_join(F.collect_list("value"), " ").alias("held")), "stem").select("stem", F.inline(V.missed_ids(F.col("whole"), F.col("held")))),
    """, i AS (SELECT stem, CASE WHEN contains(upper(text), 'EORI NO') THEN 'EORI' ELSE 'TAX' END AS "column", regexp_extract(upper(text), '(?:VAT|EORI) NO:? ([A-Z]{0,3}[0-9][0-9A-Z./-]{5,})', 1) AS number FROM prints),
    h AS (SELECT stem, string_agg(regexp_replace(value, '[^0-9A-Za-z]', '', 'g'), '') AS held FROM print_fields GROUP BY stem)
    SELECT i.stem, "column", number FROM i JOIN h ON i.stem = h.stem WHERE length(number) >= 8 AND NOT contains(held, number)""",
)
