"""Dictionary joins and standardisation (JN-08 to JN-11, FN-13 to FN-19, FN-22, STD-*)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.functions import dictionaries as D
from tallyforge.functions import text as T
from tallyforge.sources.records import settle
from tallyforge.streaming.streams import shared_folder

# A code that stands for a city's full name at the origin.
ORIGIN_NAMES = {"BJS": "BEIJING", "PEK": "BEIJING", "PKX": "BEIJING"}
# English month names.
MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
#: Dictionaries are broadcast only up to this many rows; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Up to this many phrases are put into the plan.
PLAN_PHRASES = 1_000


def small(dictionary: DataFrame) -> DataFrame:
    """The dictionary, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(dictionary) if dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dictionary


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt out to all cores. Rows of few bytes that take much work would else share the few tasks that adaptive
    execution leaves for their bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def standardise(df: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """JN-08: add ``out`` = the code of the entry whose folded name equals the folded value, else null."""
    entries = dictionary.select(T.bare(F.col("name")).alias("_name"), F.col("iso2").alias(out), "ord").groupBy("_name").agg(F.max_by(out, "ord").alias(out))
    return df.withColumn("_name", T.bare(F.col(column))).join(small(entries), "_name", "left").drop("_name")


def country_iso2(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """FN-13: two letters pass, ``NAME (XX)`` gives XX, names are looked up, anything else stays in upper case."""
    found = standardise(df, column, dictionary, "_iso")
    value = F.upper(T.strip(F.col(column)))
    inner = F.regexp_extract(value, r"\(([A-Z]{2})\)$", 1)
    return found.withColumn("country_iso2", F.when(value.rlike("^[A-Z]{2}$"), value).when(inner != "", inner).otherwise(F.coalesce("_iso", value))).drop("_iso")


def country_full(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """FN-13: add ``country_full``: the dictionary's name of a two-letter code (``XX`` or ``NAME (XX)``), empty for an unknown code
    alone; a name stays as it is. Of a code's names the last one of the dictionary counts."""
    value = F.upper(T.strip(F.col(column)))
    parts = F.regexp_extract_all(value, F.lit(r"^(.*?)\s*\(([A-Z]{2})\)$"), 1), F.regexp_extract(value, r"\(([A-Z]{2})\)$", 1)
    name = F.when(parts[1] != "", T.text(F.get(parts[0], F.lit(0)))).otherwise(value)
    code = F.when(F.length(value) == 2, value).otherwise(F.when(F.length(name) == 2, name))
    names = dictionary.groupBy(F.col("iso2").alias("_code")).agg(F.max_by(F.upper("name"), "ord").alias("_name"))
    found = df.withColumn("_code", code).join(small(names), "_code", "left")
    return found.withColumn("country_full", F.when(F.length(value) == 2, T.text(F.col("_name"))).otherwise(F.coalesce(F.col("_name"), F.when(name != "", name), parts[1]))).drop("_code", "_name")


def city_code(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """JN-11, FN-14: add ``city_code`` for one column, see ``city_codes``."""
    return city_codes(df, {column: "city_code"}, dictionary)


def city_codes(df: DataFrame, columns: dict[str, str], dictionary: DataFrame) -> DataFrame:
    """JN-11, FN-14: for each column its city's code, in the column that ``columns`` names (itself or another): the whole
    folded name, else its first known token, else the first dictionary name (5 letters or more) that a name of 6 letters
    or more starts with; unknown names stay, in upper case.

    The distinct names of all columns are looked up once, so a city that many rows or columns share costs one search.
    """
    only = lambda c: F.regexp_replace(F.upper(T.fold_ascii(c)), "[^A-Z]", "")
    value = {c: F.upper(T.strip(F.col(c))) for c in columns}
    entries = small(dictionary.groupBy(only(F.col("name")).alias("key")).agg(F.max_by("code", "ord").alias("code"), F.min("ord").alias("ord")))
    names = df.select(F.explode(F.array(*value.values())).alias("_city")).distinct()
    full = only(F.col("_city"))
    parts = F.split(F.upper(T.fold_ascii(F.col("_city"))), "[^A-Z]+")
    words = F.transform(parts, lambda x, i: F.struct(x.alias("key"), F.lit(1).alias("step"), i.alias("at")))
    # every beginning of the name is a key of its own, so the prefix search is an equi-join too
    lengths = F.when(F.length(full) >= 6, F.sequence(F.lit(5), F.length(full))).otherwise(F.array().cast("array<int>"))
    starts = F.transform(lengths, lambda n: F.struct(F.substring(full, F.lit(1), n).alias("key"), F.lit(2).alias("step"), F.lit(0).alias("at")))
    whole = F.array(F.struct(full.alias("key"), F.lit(0).alias("step"), F.lit(0).alias("at")))
    keys = names.select("_city", F.inline(F.concat(whole, words, starts))).where("key <> ''")
    best = keys.join(entries, "key").groupBy("_city").agg(F.min_by("code", F.struct("step", "at", "ord")).alias("_code"))
    # few cities stand in most rows: where the names are few, rows stay where they are and no task gets all rows of a city
    best = small(settle(best, f"{shared_folder(df.sparkSession)}/cities-{uuid.uuid4().hex}"))
    for column, out in columns.items():
        df = df.withColumn("_city", value[column]).join(best, "_city", "left").withColumn(out, F.coalesce("_code", "_city")).drop("_city", "_code")
    return df


def origin_place(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ORIGIN_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), code)


def state_code(df: DataFrame, column: str, iso2: str, dictionary: DataFrame) -> DataFrame:
    """FN-16: official code of a state of the row's country, null if unknown or already the code."""
    entries = dictionary.select(F.col("iso2").alias("_iso"), F.col("name").alias("_name"), F.col("code").alias("_code"))
    found = df.withColumn("_iso", F.col(iso2)).withColumn("_name", T.bare(F.col(column))).join(small(entries), ["_iso", "_name"], "left")
    return found.withColumn("state_code", F.when(F.col("_code") != F.upper(T.strip(F.col(column))), F.col("_code"))).drop("_iso", "_name", "_code")


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame, out: str = "prefix_iso2") -> DataFrame:
    """JN-10: the entry with the longest prefix of the digits of ``column``.

    Each number offers its own beginnings as keys, so the join is an equi-join; distinct numbers are looked up once.
    """
    digits = F.regexp_replace(F.regexp_replace(T.text(F.col(column)), r"\D", ""), "^00", "")
    longest = prefixes.agg(F.max(F.length("prefix"))).first()[0] or 0
    numbers = df.select(F.substring(digits, 1, longest).alias("_head")).distinct().where("_head <> ''")
    keys = numbers.select("_head", F.explode(F.transform(F.sequence(F.lit(1), F.length("_head")), lambda n: F.substring(F.col("_head"), F.lit(1), n))).alias("prefix"))
    best = keys.join(small(prefixes), "prefix").groupBy("_head").agg(F.max_by("iso2", F.length("prefix")).alias(out))
    return df.withColumn("_head", F.substring(digits, 1, longest)).join(best, "_head", "left").drop("_head")


def rightmost_phrase(df: DataFrame, key: str, column: str, phrases: DataFrame, out: str = "phrase") -> DataFrame:
    """JN-09: the dictionary phrase that ends last in the text, as whole words; of equal ends the longer one.

    A dictionary of at most ``PLAN_PHRASES`` is part of the expression: the n-grams that begin with a phrase's first word are looked up
    inside the row. For a larger one the distinct texts' word n-grams are the keys of an equi-join; no phrase is searched row by row.
    """
    names = phrases.select("name").distinct()
    known = [r[0] for r in names.where("name <> ''").limit(PLAN_PHRASES + 1).collect()]
    if len(known) <= PLAN_PHRASES:
        return df.withColumn(out, T.let(F.split(T.bare(F.col(column)), " "), lambda words: _last_known(words, known)))
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0]
    texts = df.select(F.col(column).alias("_text")).distinct().select("_text", F.split(T.bare(F.col("_text")), " ").alias("_words"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_words")), lambda i: _grams_at(F.col("_words"), i, range(1, longest + 1))))
    rows = texts.select("_text", F.inline(F.filter(grams, lambda g: g["name"] != "")))
    best = rows.join(small(names), "name").groupBy("_text").agg(F.max_by("name", F.struct("end", "n")).alias(out))
    return df.withColumn("_text", F.col(column)).join(best, "_text", "left").drop("_text")


def _grams_at(words: Column, i: Column, lengths: Iterable[int]) -> Column:
    """The n-grams that begin at a word (from 1), those that run over the end left out."""
    gram = lambda n: F.when(i + n - 1 <= F.size(words), F.struct((i + n).alias("end"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("name")))
    return F.array_compact(F.array(*[gram(n) for n in lengths]))


def _last_known(words: Column, names: list[str]) -> Column:
    lengths = sorted({len(n.split(" ")) for n in names})
    heads = sorted({n.split(" ")[0] for n in names})
    if not names:
        return F.lit(None).cast("string")
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1).isin(*heads))
    found = F.filter(F.flatten(F.transform(starts, lambda i: _grams_at(words, i, lengths))), lambda g: g["name"].isin(*names))
    return F.array_max(found)["name"]


def error_kind(df: DataFrame, column: str, kinds: DataFrame | None = None) -> DataFrame:
    """FN-19, UDX-02: the kind of the first keyword in order of precedence, else what stands before the colon, cut to 40.

    The table of keywords is the users' own if given. Distinct messages are classified, then joined back.
    """
    value = T.strip(F.col(column))
    kinds = D.error_kinds(df.sparkSession) if kinds is None else kinds
    table = kinds.groupBy().agg(F.sort_array(F.collect_list(F.struct("precedence", "kind", "keyword"))).alias("_kinds"))
    messages = df.select(value.alias("_error")).distinct().join(F.broadcast(table))
    hit = F.get(F.filter("_kinds", lambda k: F.contains(F.col("_error"), k["keyword"])), F.lit(0))["kind"]
    head = F.substring(T.strip(F.substring_index("_error", ":", 1)), 1, 40)
    named = messages.select("_error", F.when(F.col("_error") == "", "").otherwise(F.coalesce(hit, F.when(head == "", F.substring("_error", 1, 40)).otherwise(head))).alias("error_kind"))
    return df.withColumn("_error", value).join(named, "_error", "left").drop("_error")


def date_candidates(c: Column) -> Column:
    """FN-17: days named in free text, each once, sorted: ``2026-09-24``, or ``--09-24`` where no year is printed.

    All printed forms of the inventory; a day and month in figures (26/09/2026) count in both orders if both are possible.
    """
    none = F.array().cast("array<string>")

    def read(up: Column, sign: str, forms: list[tuple[str, list[Callable[[Column], Column]]]]) -> Column:
        # a text without the sign is not searched
        found = [F.transform(F.regexp_extract_all(up, F.lit(prints), 1), of) for prints, ways in forms for of in ways]
        signed = F.contains(up, F.lit(sign)) if len(sign) == 1 else up.rlike(sign)
        if _MONTH_LIKE in sign:  # a month is named
            signed = F.greatest(*[F.contains(up, F.lit(m)) for m in MONTHS]) & signed
        return F.when(signed, F.concat(*found)).otherwise(none)

    found = T.let(F.upper(T.text(c)), lambda up: F.concat(*[read(up, *x) for x in _DAY_PRINTS]))
    return F.sort_array(F.array_distinct(F.array_compact(found)))


def _day(y: Column | None, m: Column, d: Column) -> Column:
    def real(x: Column) -> Column:
        inside = x["m"].between(1, 12) & x["d"].between(1, 31)
        if y is None:
            return F.when(inside, F.format_string("--%02d-%02d", x["m"], x["d"]))
        year = F.when(x["y"] < 100, x["y"] + 2000).otherwise(x["y"])
        return F.when(inside & year.between(1990, 2100), F.format_string("%04d-%02d-%02d", year, x["m"], x["d"]))

    parts = {"m": m, "d": d} | ({} if y is None else {"y": y})
    return T.let(F.struct(*[v.try_cast("int").alias(k) for k, v in parts.items()]), real)


def _figures(x: Column, k: int) -> Column:
    return F.get(F.regexp_extract_all(x, F.lit("[0-9]+"), 0), F.lit(k))


def _named(x: Column) -> Column:
    """The number of the month that the first word of a print names."""
    months = F.create_map(*[F.lit(v) for m, k in MONTHS.items() for v in (m, str(k))])
    return F.try_element_at(months, F.regexp_extract(x, "[A-Z]{3}", 0))


def _in_order(y: int, m: int, d: int) -> Callable[[Column], Column]:
    return lambda x: T.let(F.regexp_extract_all(x, F.lit("[0-9]+"), 0), lambda n: _day(F.get(n, F.lit(y)), F.get(n, F.lit(m)), F.get(n, F.lit(d))))


#: how all names of months begin: few other words do, so that most places are left at once
_MONTH_LIKE = "(?=[JFMASOND][AEUPCO][NBRYGLPTVC])"
_MONTH = f"{_MONTH_LIKE}(?:{'|'.join(MONTHS)})[A-Z]*+"
#: neither a figure nor a letter or underscore before; figures, letters and underscores end no day
_APART, _END = "(?<![0-9A-Z_])", "(?![0-9A-Z_])"
_BLANKS = r"(?U:\s)+"
_YEAR = f"(?:[0-9]{{2}}|[0-9]{{4}}){_END}"
#: what may stand between a month's name and its year
_THEN = rf"(?:{_BLANKS}|[-./,\s]+)"
#: the first figure of a day that neither a figure nor a letter or underscore stands before
_FIRST = "[0-9](?<![0-9A-Z_][0-9])"


def _from_figure(rest: str) -> str:
    """What begins with a day's first figure, as a lookahead from it: the figure is found first, since most places are none."""
    return f"{_FIRST}(?<=(?=([0-9]{rest}))[0-9])"


#: Printed forms of a day, by a sign that all texts with such a print show and that is found fast: the print and how to read it.
#: Prints that may overlap are searched as lookaheads. Where words are named, texts without any of them are not searched either.
_DAY_PRINTS = [
    ("[0-9]{4}[-/. ][0-9]{1,2}[-/. ][0-9]", [(_from_figure(f"[0-9]{{3}}[-/. ][0-9]{{1,2}}[-/. ][0-9]{{1,2}}{_END}"), [_in_order(0, 1, 2)])]),
    ("[0-9][-/.][0-9]{1,2}[-/.][0-9]{4}", [(_from_figure(f"[0-9]?[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}{_END}"), [_in_order(2, 1, 0), _in_order(2, 0, 1)])]),
    (f"[0-9](?:[-/.]|(?U:\\s)++)?+{_MONTH_LIKE}(?:J(?:AN|U[LN])|FEB|MA[RY]|A(?:PR|UG)|SEP|OCT|NOV|DEC)", [
        (_from_figure(f"[0-9]?(?:[-/.]|{_BLANKS})?{_MONTH}{_THEN}?{_YEAR}"), [lambda x: _day(_figures(x, 1), _named(x), _figures(x, 0))]),
        (_from_figure(f"[0-9]?(?:[-.]|{_BLANKS})?{_MONTH}(?![0-9_年月日])(?!{_THEN}{_YEAR})"), [lambda x: _day(None, _named(x), _figures(x, 0))]),
    ]),
    (rf"{_MONTH_LIKE}[A-Z]++(?:{_BLANKS}|\.\s+)[0-9]", [
        (rf"(?=({_APART.replace('0-9', '')}{_MONTH}(?:{_BLANKS}|\.\s+)[0-9]{{1,2}}(?:{_BLANKS}|,\s+)[0-9]{{4}}{_END}))", [lambda x: _day(_figures(x, 1), _named(x), _figures(x, 0))]),
    ]),
    ("年", [("(?=((?<![0-9])[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日))", [_in_order(0, 1, 2)])]),
    ("月", [
        ("(?=((?<![0-9])[0-9]{1,2}[-/.][0-9]{1,2}月[-/.]?[0-9]{2,4}(?![0-9])))", [_in_order(2, 1, 0)]),
        ("(?=((?<![0-9年])[0-9]{1,2}月[0-9]{1,2}日))", [lambda x: _day(None, _figures(x, 0), _figures(x, 1))]),
    ]),
    ("[0-9]{8}", [(f"([0-9]{{8}}){_END}(?<![0-9A-Z_][0-9]{{8}})", [lambda x: _day(F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))])]),
]


def flag_columns(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """FN-22: ``columns``, the known column names that stand in the flag as whole words, in the order of ``names``."""
    hits = [F.when(F.col(column).rlike(rf"(?<![0-9A-Za-z_]){n}(?![0-9A-Za-z_])"), F.lit(n)) for n in names]
    return df.withColumn("columns", F.array_compact(F.array(*hits)))


def flag_column(flag: Column) -> Column:
    """FN-22: the first token of a flag that looks like a column: capitals, digits and underscores, three characters or more."""
    return F.regexp_extract(T.text(flag), "([A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)*)", 1)


def standardise_house(df: DataFrame, countries: DataFrame, cities: DataFrame, constants: dict[str, str] | None = None) -> DataFrame:
    """STD-01: master number, route and origin, country, phones, ids and HS codes of house records; symbols to spaces in
    text columns. ``constants`` are columns the house overwrites. Columns the input lacks are left out. A party with all its cells
    has its ids routed and its address parsed (``party_addresses``); one without id cells keeps what is left of its address
    without postal code, country, state and city (STD-03)."""
    has = set(df.columns)
    df = spread(df)
    for col in [c for c in df.columns if c.endswith("_COMP_ADDRESS")]:
        party = col.removesuffix("_COMP_ADDRESS")
        tail = [f"{party}_POSTAL", f"{party}_COUNTRY", f"{party}_STATE", next((c for c in (f"{party}_CITY", f"{party}_CITTY") if c in has), "")]
        if has.issuperset([*tail, f"{party}_EORI", f"{party}_TAX"]):
            df = party_addresses(df, party, countries)
        elif has.issuperset(tail):
            df = address_residual(df, "", col, tail, tuple(tail)).withColumn(col, F.col("street")).drop("street")
    places = [c for c in ("TO1", "TO2", "TO3", "DEST_NAME", "ORIGIN_NAME") if c in has]
    if places:
        df = city_codes(df, {c: c for c in places}, cities)
    if "ORIGIN_NAME" in has:
        df = df.withColumn("ORIGIN_NAME", origin_place(F.col("ORIGIN_NAME")))
    for col in [c for c in df.columns if c.endswith("COUNTRY")]:
        df = country_iso2(df, col, countries).withColumn(col, F.col("country_iso2")).drop("country_iso2")
    rules = {"MAWB_NO": T.fmt_mawb, "GOODS_HS_CODE": T.hs6}
    for c in df.columns:
        if c.endswith(("_TEL", "_FAX")):
            rules[c] = T.phone_cell
        elif c.endswith(("_EORI", "_TAX")):
            rules[c] = lambda x: F.array_join(F.filter(F.transform(T.split_ids(x), T.id_cell), lambda v: v != ""), " / ")
        elif c.endswith(("_COMP_NAME", "_COMP_ADDRESS", "_CITY", "_STATE", "SHIPPER", "CONSIGNEE")):
            rules[c] = T.sym_to_space
    out = df.withColumns({c: f(F.col(c)) for c, f in rules.items() if c in df.columns})
    return out.withColumns({c: F.lit(v) for c, v in (constants or {}).items() if c in df.columns})


def clean_partial(values: Column) -> Column:
    """PRJ-03: a partial record as a map: absent keys stay absent, blank values become an explicit null, others take the form of
    their kind. Ids of a cell stay apart by `` / ``; the cell of an authorised operator holds one number."""

    def formed(k: Column, v: Column) -> Column:
        squeezed = F.upper(F.regexp_replace(T.text(v), r"(?U)\s+", ""))
        kinds = F.when(k.rlike("_(TEL|FAX)$"), T.phone_cell(v)).when(k.rlike("_(EORI|TAX)$"), T.id_join(v)).when(k.endswith("_AEO"), squeezed).when(k == "MAWB_NO", T.hyphenate11(v))
        return F.when(T.blank(v), F.lit(None).cast("string")).otherwise(kinds.otherwise(T.fold_ws(v)))

    return F.transform_values(values, formed)


def standardise_master(values: Column) -> Column:
    """STD-02: a partial master record as a map, ready to be sent.

    Only the master's own columns stay; a column that was not given stays absent, a blank one is null, so that a whole-row write can
    tell what to keep from what to clear. The shipper's country is China whatever was read. HS codes keep six digits each,
    text without a code stays for the rules to flag; a piece count that is no number is null. Cells of parties lose
    their symbols but for postal codes and ids.
    """
    parties = "^(" + "|".join(D.MASTER_PARTIES) + ")_INFO_"

    def formed(k: Column, v: Column) -> Column:
        count = F.regexp_extract(T.strip(v), r"^([+-]?[0-9]+)([.][0-9]*)?$", 1).try_cast("bigint").cast("string")
        codes = T.let(T.hs6(v), lambda c: F.when(c == "", T.fold_ws(v)).otherwise(c))
        digits = F.regexp_replace(T.text(v), "[^0-9]", "")
        number = F.when(F.length(digits) == 11, T.hyphenate11(digits)).otherwise(T.fold_ws(v))
        own = F.when(k == "MAWB_NO", number).when(k == "SLAC", count).when(k == "GOODS_INFO_HSCODE", codes)
        return own.otherwise(v)

    def bare(k: Column, v: Column) -> Column:
        symbols = k.rlike(parties) & ~k.rlike("_(POSTAL|EORI|TAX)$")
        upper = F.when(k.endswith("_COUNTRY"), F.upper(v)).otherwise(v)
        china = F.when(k == "SHIPPER_INFO_COUNTRY", F.lit("CN"))
        return china.otherwise(F.when(symbols & v.isNotNull(), T.sym_to_space(upper)).otherwise(v))

    own = F.map_filter(values, lambda k, _: k.isin(D.MASTER_COLUMNS))
    return F.transform_values(clean_partial(F.transform_values(own, formed)), bare)


def master_body(df: DataFrame, values: str, keys: list[str]) -> DataFrame:
    """What is sent for a master: ``keys`` and exactly its columns, null where the map ``values`` has none; ``SLAC`` is a number."""
    cells = [F.col(values)[c].cast("bigint" if c == "SLAC" else "string").alias(c) for c in D.MASTER_COLUMNS]
    return df.select(*keys, *cells)


def change_preview(df: DataFrame, key: str, parties: list[str], countries: DataFrame, states: DataFrame) -> DataFrame:
    """ACC-07: ``key, field, from, to, rule, why`` for each cell whose value the rules would change: ``CHARS`` (characters of the
    print), ``POSTAL`` and ``STATE`` (the form of the party's country). Rules that fire together are joined by ``+``.

    Each party has ``<party>_POSTAL``, ``<party>_STATE`` and ``<party>_COUNTRY``; cells of all parties are looked up at once.
    """
    cells = [F.struct(F.lit(f"{p}_{s}").alias("field"), F.lit(s).alias("_kind"), T.text(F.col(f"{p}_{s}")).alias("from"), T.text(F.col(f"{p}_COUNTRY")).alias("_country")) for p in parties for s in ("POSTAL", "STATE")]
    long = country_iso2(df.select(key, F.inline(F.array(*cells))), "_country", countries).withColumn("_clean", T.clean_chars(F.col("from")))
    long = state_code(long, "_clean", "country_iso2", states)
    chars = F.when(F.col("_clean") != F.col("from"), F.struct(F.lit("CHARS").alias("rule"), F.lit("characters of the print").alias("why")))
    formed = F.when(F.col("_kind") == "POSTAL", T.postal_format(F.col("_clean"), F.col("country_iso2"))).otherwise(F.col("state_code"))
    form = F.when(formed.isNotNull(), F.struct(F.col("_kind").alias("rule"), F.concat(F.lit("form of "), "country_iso2").alias("why")))
    rows = long.select(key, "field", "from", F.coalesce(formed, "_clean").alias("to"), F.array_compact(F.array(chars, form)).alias("_r")).where((F.size("_r") > 0) & (F.col("to") != F.col("from")) & (F.col("to") != ""))
    return rows.select(key, "field", "from", "to", F.array_join("_r.rule", "+").alias("rule"), F.array_join("_r.why", "; ").alias("why"))


def strip_tail(address: Column, postal: Column, country: Column, state: Column, city: Column) -> Column:
    """STD-03: an address without commas, without the postal code, country, state and city that stand at its end in any
    order and number, a CITY label before the city and a two-letter country code at the very end."""
    codes = sorted(set(D.COUNTRIES.values()))
    start = F.split(T.fold_ws(address), " ")
    plain = lambda x: F.regexp_replace(F.upper(x), "^[,-]+|[,-]+$", "")
    coded = lambda x: (F.size(x) > 1) & plain(F.element_at(x, -1)).isin(codes)
    tokens = T.let(start, lambda x: F.when(coded(x), F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    names = [F.upper(T.fold_ws(v)) for v in (postal, country, state, city)]
    known = [F.struct(F.split(v, " ").alias("words"), (v != "").alias("some"), (v == names[-1]).alias("city")).alias(f"v{i}") for i, v in enumerate(names)]

    # what is left is always a beginning of the tokens, so only its length is carried on
    def step(x: Column, left: Column) -> Column:
        out = F.when(F.lit(False), left)
        for v in (x[f"v{i}"] for i in range(len(names))):
            n = left - F.size(v["words"])
            fits = v["some"] & (n >= 0) & (F.slice(x["plain"], F.greatest(n, F.lit(0)) + 1, F.size(v["words"])) == v["words"])
            label = (n > 0) & v["city"] & F.coalesce(F.get(x["plain"], n - 1).isin("CITY", "CITT"), F.lit(False))
            out = out.when(fits, F.greatest(n - F.when(label, 1).otherwise(0), F.lit(0)))
        return out.otherwise(left)

    cut = lambda x: F.slice(x["tokens"], F.lit(1), F.aggregate(F.sequence(F.lit(1), F.size(x["tokens"])), F.size(x["tokens"]), lambda left, _: step(x, left)))
    left = T.let(tokens, lambda t: T.let(F.struct(t.alias("tokens"), F.transform(t, plain).alias("plain"), *known), cut))
    return F.regexp_replace(F.array_join(left, " "), "^[ ,]+|[ ,]+$", "")


def address_residual(df: DataFrame, key: str, address: str, known: list[str], tail: tuple[str, str, str, str] | None = None) -> DataFrame:
    """STD-03: what is left of an address once labelled ids, phone segments and the known parts (``known`` columns) are cut.
    ``tail`` names the columns of postal code, country, state and city, which are cut from the end of an address without
    commas too."""
    segments = F.transform(F.split(T.text(F.col(address)), r"[,\n]"), lambda x: T.fold_ws(T.without_ids(x)))
    parts = F.array(*[T.bare(F.col(c)) for c in known])
    phone = r"(?i)^(TEL|FAX|PHONE|MOB)?[.:\s]*\+?[0-9][0-9 ()./-]{5,}$"
    left = F.filter(segments, lambda s: (s != "") & ~s.rlike(phone) & ~F.array_contains(parts, T.bare(s)))
    street = F.array_join(left, ", ")
    if tail is not None:
        street = F.when((F.size(left) == 1) & ~T.text(F.col(address)).rlike(r"[,\n]"), strip_tail(street, *(F.col(c) for c in tail))).otherwise(street)
    return df.withColumn("street", street)


def routed_ids(eori: Column, tax: Column, address: Column, others: list[Column]) -> Column:
    """STD-01: ``eori, tax, address``: ids in the cell of their kind. A customs cell gives its tax ids to the tax cell; the first
    labelled id of the address goes to the cell its label names, unless its number stands in a cell already (``others`` are phones
    and postal code), and leaves the address."""
    kind = lambda wanted, cell: F.filter(T.split_ids(cell), lambda x: T.let(x, T.classify_id) == wanted)
    sent = lambda ids: F.transform(ids, lambda x: T.let(x, T.id_cell))
    body = lambda x: F.upper(T.alnum(T.clean_tax(x)))

    def route(c: Column) -> Column:
        held = F.transform(F.concat(c["e"], c["t"], c["others"]), lambda x: T.let(x, body))
        number = T.let(c["mark"], lambda m: T.id_cell(F.concat(m["label"], F.lit(" "), m["number"])))
        new = c["mark"].isNotNull() & ~F.array_contains(held, T.let(c["mark"]["number"], body))
        added = lambda customs: F.when(new & (c["mark"]["label"].rlike("^EO") == customs), F.array(number)).otherwise(F.array().cast("array<string>"))
        joined = lambda ids: F.array_join(F.array_distinct(ids), " / ")
        return F.struct(joined(F.concat(c["e"], added(True))).alias("eori"), joined(F.concat(c["t"], added(False))).alias("tax"), c["address"].alias("address"))

    first = F.get(T.labelled_marks(address), F.lit(0))
    parts = F.struct(
        sent(kind("eori", eori)).alias("e"), F.concat(sent(kind("tax", eori)), sent(kind("tax", tax))).alias("t"),
        F.array(*[T.text(c) for c in others]).alias("others"), first.alias("mark"), T.without_ids(address, 1).alias("address"),
    )
    return T.let(parts, route)


def _segment(c: Column) -> Column:
    """A segment without the marks at its ends and the rest of a country code that was cut out of brackets."""
    plain = F.regexp_replace(c, r"^[\s.;()\[\]{}]+|[\s.;()\[\]{}]+$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[,(]\s*[A-Z]{0,4}\s*$", ""), r"[\s.;()\[\]{}]+$", "")


def streets(df: DataFrame, address: str, country_name: str, countries: DataFrame, name: str | None = None, out: str = "street") -> DataFrame:
    """STD-03: ``street`` of addresses with commas: what is left without postal code, country, state, city and what the print puts
    around them. Nothing left, the address stays as it is.

    The country and the state are the dictionary phrases that end last. The postal code is the last match of the most telling
    shape. The city is the last segment without figures or words of companies and streets. The segment that the postal code was taken from is
    locality, and so is one that names the city without such words; segments that stand in the locality are no street. A country
    code at the end counts as ``country_name``; segments equal to the column ``name`` go.
    """
    spark = df.sparkSession
    full = T.text(F.col(address))
    code = F.regexp_extract(full, r"[,\s]+([A-Za-z]{2})\s*$", 1)
    known = sorted(set(D.COUNTRIES.values()))
    fixed = F.when(F.upper(code).isin(known), F.rtrim(F.concat(F.regexp_replace(full, r"[,\s]+[A-Za-z]{2}\s*$", ""), F.lit(" "), T.text(F.col(country_name))))).otherwise(full)
    own = F.upper(T.strip(F.col(name))) if name else F.lit("")
    noise = r"(?i)(TEL|FAX|PHONE|MOBILE)\.?\s*[:：/][^,]*|[\w.+-]+@[\w-]+\.[\w.-]*"
    lines = F.transform(F.split(F.regexp_replace(fixed, noise, " "), "[,\n]"), lambda x: F.regexp_replace(T.fold_ws(x), "^[ ,;]+|[ ,;]+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & (F.upper(x) != own))
    # an address without commas stays as it is: nothing is searched in it
    has_commas = F.contains(fixed, F.lit(","))
    rows = df.withColumn("_up", F.when(has_commas, F.upper(F.array_join(kept, ", "))))
    states = spark.createDataFrame([(x,) for x in D.ADDRESS_STATES], "name string")
    rows = rightmost_phrase(rows, "_up", "_up", countries.select(T.bare(F.col("name")).alias("name")), "_country")
    rows = rightmost_phrase(rows, "_up", "_up", states, "_state")
    hits = [F.try_element_at(F.regexp_extract_all("_up", F.lit(p), 0), F.lit(-1)) for p in D.POSTAL_PRINTS]
    rows = rows.withColumn("_postal", F.coalesce(*hits, F.lit("")))
    stop = r"\b(" + "|".join(D.NO_CITY) + r")\b"

    def parsed(c: Column) -> Column:
        up, postal = c["up"], c["postal"]
        at = F.length(up) - F.instr(F.reverse(up), F.reverse(postal)) - F.length(postal) + 2
        body = F.when(postal == "", up).otherwise(F.concat(F.substr(up, F.lit(1), at - 1), F.substr(up, at + F.length(postal))))
        for phrase in ("country", "state"):
            pattern = F.concat(F.lit("(?<![A-Z])"), c[phrase], F.lit("(?![A-Z])"))
            body = F.when(c[phrase].isNull(), body).otherwise(F.regexp_replace(body, pattern, F.lit(" ")))
        segments = F.filter(F.transform(F.split(body, ","), _segment), lambda x: x != "")
        # the segment that the postal code was taken from; others may hold the same figures
        place = F.when(postal != "", F.size(F.split(F.substr(up, F.lit(1), at), ",")) - 1).otherwise(-1)
        return T.let(F.struct(segments.alias("s"), place.alias("place"), up.alias("up")), chosen)

    def chosen(c: Column) -> Column:
        fits = lambda x: x.rlike("[A-Z]{2}") & ~x.rlike("[0-9]") & ~x.rlike(stop)
        last = F.array_max(F.array_compact(F.transform(c["s"], lambda x, i: F.when(fits(x), i))))
        return T.let(F.struct(c["s"].alias("s"), c["place"].alias("place"), c["up"].alias("up"), last.alias("at"), F.get(c["s"], last).alias("city")), left)

    def left(c: Column) -> Column:
        has_city = lambda x: F.coalesce(F.contains(x, c["city"]), F.lit(False)) & ~x.rlike("[0-9]") & ~x.rlike(stop)
        around = F.filter(F.transform(F.split(c["up"], ","), _segment), lambda x, i: (x != "") & ((i == c["place"]) | has_city(x)) & ~x.rlike("[+@]"))
        return T.let(F.array_join(around, ", "), lambda loc: F.array_join(F.filter(c["s"], lambda x, i: (i != F.coalesce(c["at"], F.lit(-1))) & ~F.contains(loc, x)), ", "))

    street = T.let(F.struct(F.col("_up").alias("up"), F.col("_postal").alias("postal"), F.col("_country").alias("country"), F.col("_state").alias("state")), parsed)
    rows = rows.withColumn("_street", F.when(F.col("_up").isNotNull(), street))
    phone = r"(?i)^(TEL|TE|FAX|PHONE|MOB)?[.:\s]*\+?[0-9][0-9 ()./-]{5,}$"
    whole = F.when(T.blank(F.col("_street")), fixed).otherwise(F.col("_street"))
    no_phones = F.array_join(F.filter(F.transform(F.split(whole, ","), T.strip), lambda x: (x != "") & ~x.rlike(phone)), ", ")
    return rows.withColumn(out, F.when(has_commas, no_phones).otherwise(full)).drop("_up", "_country", "_state", "_postal", "_street")


def party_addresses(df: DataFrame, party: str, countries: DataFrame) -> DataFrame:
    """STD-01, STD-03 for a party with all its cells: ids go to ``_EORI`` and ``_TAX``, the address keeps its street, whether it has
    commas or not."""
    city = next(c for c in (f"{party}_CITY", f"{party}_CITTY") if c in df.columns)
    cell = lambda n: F.col(f"{party}_{n}")
    ids = routed_ids(cell("EORI"), cell("TAX"), cell("COMP_ADDRESS"), [cell(n) for n in ("TEL", "FAX", "POSTAL") if f"{party}_{n}" in df.columns])
    named = country_full(df.withColumn("_ids", ids), f"{party}_COUNTRY", countries).withColumn("_addr", F.col("_ids.address"))
    name = f"{party}_COMP_NAME" if f"{party}_COMP_NAME" in df.columns else None
    parsed = streets(named, "_addr", "country_full", countries, name)
    plain = strip_tail(F.col("_addr"), cell("POSTAL"), F.col("country_full"), cell("STATE"), F.col(city))
    street = F.when(F.contains("_addr", F.lit(",")), F.col("street")).otherwise(plain)
    out = parsed.withColumns({f"{party}_COMP_ADDRESS": street, f"{party}_EORI": F.col("_ids.eori"), f"{party}_TAX": F.col("_ids.tax")})
    return out.select(*df.columns)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
