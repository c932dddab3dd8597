"""Validation rules as data: an array of conditional structs, exploded to a flags table (VAL-*, UDX-01)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.dictionaries import DIAL_CODES, LIMIT_50, MASTER_PREFIXES


@dataclass(frozen=True)
class Rule:
    """A flag is raised where ``when`` holds. ``severity`` is ``flag`` or ``hint`` (hints never hold a record back)."""

    rule_id: str
    field: str
    when: Column
    message: str
    severity: str = "flag"


def validate(df: DataFrame, rules: list[Rule], key: str = "stem", layer: str = "raw") -> DataFrame:
    """``stem, layer, rule_id, field, severity, message``, a row per raised flag. Stateless, so it also runs on streams."""
    flags = [F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.field).alias("field"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules]
    return df.select(key, F.lit(layer).alias("layer"), F.inline(F.array_compact(F.array(*flags)))) if flags else df.select(key).limit(0)


def dial_mismatch(tel: str, country: str) -> Column:
    """VAL-07: the country of the longest dial code that the number starts with is not the cell's two-letter country."""
    digits = F.regexp_replace(F.regexp_replace(T.text(F.col(tel)), r"\D", ""), "^00", "")
    iso = F.lit(None).cast("string")
    for prefix in sorted(DIAL_CODES, key=len):  # the longest is tried first
        iso = F.when(digits.startswith(prefix), DIAL_CODES[prefix]).otherwise(iso)
    own = F.upper(T.strip(F.col(country)))
    return (F.length(own) == 2) & (digits != "") & (iso != own)


def customs_shape(cell: str) -> Column:
    """VAL-08: some segment of a non-empty customs-id cell is not two letters and 6 to 15 letters or digits, one digit at least."""
    parts = F.filter(F.transform(T.split_ids(F.col(cell)), T.clean_tax), lambda x: x != "")
    good = (F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike("^[A-Z]{2}[A-Z0-9]{6,15}$") & x.rlike(r"\d"))
    return ~T.blank(F.col(cell)) & ~good


def id_body_rule(cell: str, tel: str, country: str, kind: str) -> Column:
    """VAL-09: the first rule a segment breaks: ``phone`` (equal to the phone), ``cn`` (not 18 in China), ``short`` (under 8)."""
    phone = T.alnum_upper(F.col(tel))
    bodies = F.filter(F.transform(T.split_ids(F.col(cell)), lambda s: T.alnum_upper(T.clean_tax(s))), lambda b: b != "")
    is_phone = lambda b: (b == phone) & (phone != "")
    is_cn = lambda b: ~is_phone(b) & F.upper(T.strip(F.col(country))).isin("CN", "CHINA") & (F.length(b) != 18)
    is_short = lambda b: ~is_phone(b) & ~is_cn(b) & (F.length(b) < 8)
    return F.exists(bodies, {"phone": is_phone, "cn": is_cn, "short": is_short}[kind])


def hs_short(cell: str) -> Column:
    """VAL-12."""
    parts = F.split(T.text(F.col(cell)), "[,;]")
    return F.exists(parts, lambda p: ~T.blank(p) & (F.length(F.regexp_replace(p, r"\D", "")) < 6))


def is_master_like(cell: str) -> Column:
    """VAL-04."""
    return F.regexp_replace(T.strip(F.col(cell)), " ", "").rlike("^(" + "|".join(MASTER_PREFIXES) + r")\D?\d{7,8}")


def number_in_text(text_column: str, record: str) -> Column:
    """VAL-18, EVD-08: labelled ids of a text, each once, of 8 characters or more, that the record's text does not hold."""
    return F.array_distinct(F.filter(T.labelled_ids(F.col(text_column)), lambda x: (F.length(T.alnum(x)) >= 8) & ~F.contains(T.alnum_upper(F.col(record)), T.alnum_upper(x))))


def shape_rules(country: str = "iso2", tel: str = "tel", cell: str = "cell", postal: str = "postal", goods: str = "goods") -> list[Rule]:
    """The rules for party cells of one record, by column name."""
    return [
        Rule("VAL-07", tel, dial_mismatch(tel, country), "dial code and country differ"),
        Rule("VAL-08", cell, customs_shape(cell), "not a customs id"),
        Rule("VAL-09a", cell, id_body_rule(cell, tel, country, "phone"), "id equals the phone"),
        Rule("VAL-09b", cell, id_body_rule(cell, tel, country, "cn"), "tax id should be 18"),
        Rule("VAL-09c", cell, id_body_rule(cell, tel, country, "short"), "id too short"),
        Rule("VAL-11", postal, T.postal_wrong(F.col(postal), F.col(country)), "postal code length"),
        Rule("VAL-12", goods, hs_short(goods), "HS code under 6 digits"),
        Rule("VAL-23", tel, ~T.blank(F.col(tel)) & (F.length(F.regexp_replace(F.col(tel), r"\D", "")) < 6), "no number", "hint"),
        Rule("VAL-24", cell, id_body_rule(cell, tel, country, "short"), "segment shorter than 8", "hint"),
    ]


def codes_only(cell: str) -> Column:
    """VAL-16: an empty cell, or codes of four digits or more between commas."""
    parts = F.transform(F.split(T.text(F.col(cell)), ","), T.strip)
    return T.blank(F.col(cell)) | F.forall(parts, lambda x: (F.length(x) >= 4) & ~x.rlike("[^0-9]"))


def number_rules(sent: tuple[str, str] | None = None) -> list[Rule]:
    """VAL-03: numbers that are missing; ``sent`` names the columns of the version to be sent, in which a person may have
    filled them in."""
    held = [~T.blank(F.col(n)) for n in ("MAWB_NO", "HAWB_NO")]
    if sent:
        held = [a | ~T.blank(F.col(n)) for a, n in zip(held, sent, strict=True)]
    master, house = held
    return [
        Rule("VAL-03a", "MAWB_NO", ~master & ~house, "both numbers missing"),
        Rule("VAL-03b", "MAWB_NO", ~master & house, "master number missing"),
        Rule("VAL-03c", "HAWB_NO", ~house & master, "house number missing"),
    ]


def place_rules(columns: list[str], origin: str | None = None, origins: list[str] | None = None) -> list[Rule]:
    """VAL-13: hops and destination are three capital letters; the origin may also be one of ``origins``, city names sent in full."""
    v = lambda n: T.strip(F.col(n))
    rules = [Rule("VAL-13", n, (v(n) != "") & ~v(n).rlike("^[A-Z]{3}$"), "not a three-letter place") for n in columns]
    if origin:
        rules.append(Rule("VAL-13", origin, (v(origin) != "") & ~v(origin).rlike("^[A-Z]{3}$") & ~v(origin).isin(origins or []), "neither a three-letter place nor a city"))
    return rules


def length_rules(columns: list[str] = LIMIT_50, most: int = 50) -> list[Rule]:
    """VAL-17."""
    return [Rule("VAL-17", n, F.length(T.text(F.col(n))) > most, f"longer than {most}") for n in columns]


def gap_rules(pairs: dict[str, str]) -> list[Rule]:
    """VAL-22: a column of the print has a value, the one made from it (``pairs``) none: a gap in a dictionary."""
    return [Rule("VAL-22", made, T.blank(F.col(made)) & ~T.blank(F.col(printed)), "dictionary gap", "hint") for printed, made in pairs.items()]


def id_length_rules(eori: str, tax: str, countries: list[str]) -> list[Rule]:
    """VAL-24: segments shorter than 8; a tax id of a party in China has 18. Any of ``countries`` may name China."""
    china = F.lit(False)
    for n in countries:
        china = china | F.array_contains(F.split(F.upper(T.text(F.col(n))), "[^A-Z]+"), "CN") | F.contains(F.upper(T.text(F.col(n))), F.lit("CHINA"))
    bodies = lambda n: F.transform(T.split_ids(F.col(n)), lambda x: T.let(x, lambda s: F.length(T.alnum(T.clean_tax(s)))))
    return [
        Rule("VAL-24a", eori, F.exists(bodies(eori), lambda x: x < 8), "segment shorter than 8", "hint"),
        Rule("VAL-24b", tax, china & F.exists(bodies(tax), lambda x: (x > 0) & (x != 18)), "tax id should be 18", "hint"),
        Rule("VAL-24c", tax, ~china & F.exists(bodies(tax), lambda x: (x > 0) & (x < 8)), "segment shorter than 8", "hint"),
    ]


def number_form_rules(integers: list[str], decimals: list[str], weight: tuple[str, str] | None = None) -> list[Rule]:
    """VAL-26: cells that are no numbers, a fraction in an integer column, and a weight (print, made) exactly doubled."""
    cell = lambda n: T.strip(F.col(n))
    wrong = lambda n: (cell(n) != "") & T.as_num(F.col(n)).isNull()
    rules = [Rule("VAL-26", n, wrong(n) | F.contains(cell(n), F.lit(".")), "a fraction or no number", "hint") for n in integers]
    rules += [Rule("VAL-26", n, wrong(n), "no number", "hint") for n in decimals]
    if weight:
        p, q = (F.regexp_replace(T.text(F.col(n)), "[^0-9.]", "").try_cast("double") for n in weight)
        rules.append(Rule("VAL-26w", weight[1], (p != 0) & (q != 0) & (F.abs(q - p * 2) < 1e-6), "twice the printed weight", "hint"))
    return rules


def record_rules() -> list[Rule]:
    """The rules for numbers, counts and dates of a house or master record."""
    c = lambda n: T.strip(F.col(n))
    missing_m = c("MAWB_NO") == ""
    zero = lambda n: T.blank(F.col(n)) | F.coalesce(T.as_num(F.col(n)) == 0, F.lit(False))
    route = "TO1"
    return [
        Rule("VAL-01a", route, c(route).rlike("^[A-Za-z]{2}$"), "carrier code in the route"),
        Rule("VAL-01b", route, c(route).rlike(r"^[A-Za-z]{2}\d{3,4}$"), "flight number in the route"),
        Rule("VAL-02", route, (c(route) == "") & (c("DEST_NAME") != ""), "first hop missing"),
        *number_rules(),
        Rule("VAL-04", "HAWB_NO", is_master_like("HAWB_NO"), "house number looks like a master number"),
        Rule("VAL-05a", "PIECES", zero("PIECES"), "pieces missing or zero"),
        Rule("VAL-05b", "WEIGHT", zero("WEIGHT"), "weight missing or zero"),
        Rule("VAL-06a", "CREATE_TIME", c("CREATE_TIME") == "", "date missing"),
        Rule("VAL-06b", "CREATE_TIME", (c("CREATE_TIME") != "") & ~c("CREATE_TIME").rlike(r"^\d{4}-\d{2}-\d{2}$"), "date not YYYY-MM-DD"),
        Rule("VAL-10", "COUNTRY", ~T.blank(F.col("COUNTRY")) & ~F.col("country_iso2").rlike("^[A-Z]{2}$"), "country not recognised"),
        Rule("VAL-13", "DEST_NAME", (c("DEST_NAME") != "") & ~c("DEST_NAME").rlike("^[A-Z]{3}$"), "not a three-letter place"),
        Rule("VAL-14", "MAWB_NO", ~missing_m & ~c("MAWB_NO").rlike(r"^\d{3}-\d{8}$"), "master number not ddd-dddddddd"),
        Rule("VAL-15", "PIECES", ~T.blank(F.col("PIECES")) & T.as_num(F.col("PIECES")).isNull(), "not a number"),
        Rule("VAL-16", "GOODS", ~codes_only("GOODS"), "HS cell holds more than codes"),
        Rule("VAL-17", "SHIPPER", F.length(T.text(F.col("SHIPPER"))) > 50, "longer than 50"),
        Rule("VAL-21a", "MAWB_NO", ~T.norm_no(F.col("MAWB_NO")).rlike(r"^\d{11}$"), "not 11 digits", "hint"),
        Rule("VAL-21b", "MAWB_NO", T.norm_no(F.col("MAWB_NO")).rlike(r"^\d{11}$") & ~T.awb_check_digit(F.substring(T.norm_no(F.col("MAWB_NO")), 4, 8)), "check digit", "hint"),
        Rule("VAL-22", "COUNTRY", ~T.blank(F.col("COUNTRY")) & (F.length("country_iso2") != 2), "dictionary gap", "hint"),
        Rule("VAL-25", "CREATE_TIME", c("CREATE_TIME").rlike(r"^\d{2}-\d{2}-\d{2}$"), "two-digit year", "hint"),
        Rule("VAL-26", "PIECES", F.coalesce(T.as_num(F.col("PIECES")) % 1 != 0, F.lit(False)), "fraction in a count", "hint"),
    ]


def qc_record(records: DataFrame, flags: DataFrame, errors: DataFrame, key: str = "stem") -> DataFrame:
    """VAL-20: error first, then the record's flags in order; any of them asks for a review. Hints do not."""
    raised = flags.where("severity = 'flag'").groupBy(key).agg(F.array_sort(F.collect_list(F.concat("field", F.lit(": "), "message"))).alias("_f"))
    joined = records.select(key).join(raised, key, "left").join(errors.select(key, T.strip(F.col("error")).alias("error")), key, "left")
    messages = F.concat(F.when(F.coalesce("error", F.lit("")) != "", F.array("error")).otherwise(F.array().cast("array<string>")), F.coalesce("_f", F.array().cast("array<string>")))
    return joined.select(key, messages.alias("flags")).withColumn("needs_review", F.size("flags") > 0)


def recompute_at_submission(flags: DataFrame, acked: DataFrame, key: str = "stem") -> DataFrame:
    """VAL-19: flags of the version to be sent that nobody acknowledged (same rule and field)."""
    return flags.where("severity = 'flag'").join(acked, [key, "rule_id", "field"], "left_anti")
