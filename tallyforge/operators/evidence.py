"""Evidence: does every value occur in the source text, and does the text hold numbers the record lacks (EVD-*, JN-17, WIN-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.functions import text as T


def line_spans(lines: DataFrame, key: str = "stem") -> DataFrame:
    """WIN-03: for each line its spans of 1 to 4 adjacent lines: ``i, n, span``."""
    w = Window.partitionBy(key).orderBy("i")
    norm = T.fold_ws(T.half_width(F.col("text")))
    rows = lines.select(key, "i", norm.alias("t"))
    follow = [F.lead("t", k).over(w) for k in range(1, 4)]
    rows = rows.select(key, "i", "t", *[x.alias(f"t{k}") for k, x in enumerate(follow, 1)])
    spans = [F.when(F.col(f"t{n - 1}").isNotNull() if n > 1 else F.lit(True), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", "t", *[f"t{k}" for k in range(1, n)]).alias("span"))) for n in range(1, 5)]
    return rows.select(key, "i", F.inline(F.array_compact(F.array(*spans))))


def norm(c: Column) -> Column:
    """Half-width punctuation, single spaces; upper and lower case stay."""
    # most lines are ASCII: they have no wide punctuation, and only some of them white space to fold
    plain = T.text(c)
    folded = F.when(plain.rlike(r"[\t-\r]|  "), F.regexp_replace(plain, r"\s{2,}|[\t-\r]", " ")).otherwise(plain)
    return F.when(F.octet_length(plain) == F.char_length(plain), F.trim(folded)).otherwise(T.fold_ws(T.half_width(plain)))


def printed(lines: DataFrame, key: str = "stem") -> DataFrame:
    """A row per record: ``lines`` (normalised, in order), ``at`` (their numbers) and ``whole``, all lines as one text."""
    rows = lines.select(key, "i", norm(F.col("text")).alias("t"))
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("_l"))
    rows = rows.select(key, F.col("_l.t").alias("lines"), F.col("_l.i").alias("at"))
    return rows.withColumn("whole", _whole(F.col("lines")))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def whole_print(lines: DataFrame, *keys: str) -> DataFrame:
    """A row per record (``keys``): ``whole``, all lines in order as one text in half-width punctuation, for those who read no single lines.
    White space stays as printed."""
    rows = lines.groupBy(*(keys or ("stem",))).agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("_l"))
    return rows.select(*(keys or ("stem",)), T.half_width(F.array_join("_l.text", " ")).alias("whole"))


def _numbers(lines: Column, holds: Callable[[Column], Column]) -> Column:
    """Places of the lines that hold something, from 1."""
    marked = F.transform(lines, lambda x, i: F.when(holds(x), i + 1))
    return F.array_compact(marked)


def text_sources(value: Column, lines: Column, whole: Column, sources: bool = True) -> Column:
    """EVD-01: ``passed`` and ``sources`` of a text value: every line that holds it, else the first span of 2, 3, then 4 lines,
    else none if only the whole text does. What the whole text lacks no line or span can hold, so lines are looked at
    for values that are there only, and not at all without ``sources``, which are null then."""

    def span(v: Column, n: int) -> Column:
        joined = lambda i: F.array_join(F.filter(F.slice(lines, i, n), lambda x: x != ""), " ")
        starts = F.when(F.size(lines) >= n, F.sequence(F.lit(1), F.size(lines) - (n - 1)))
        first = F.get(F.filter(starts, lambda i: F.contains(joined(i), v)), F.lit(0))
        return F.when(first.isNotNull(), F.sequence(first, first + n - 1))

    def found(v: Column) -> Column:
        ones = _numbers(lines, lambda x: F.contains(x, v))
        where = T.let(ones, lambda o: F.when(F.size(o) > 0, o).otherwise(F.coalesce(span(v, 2), span(v, 3), span(v, 4))))
        there = F.contains(whole, v)
        return F.struct(there.alias("passed"), F.when(there, where).alias("sources"))

    if not sources:
        return F.struct(F.contains(whole, norm(value)).alias("passed"), F.lit(None).cast("array<int>").alias("sources"))
    return T.let(norm(value), found)


def _folded(lines: Column, whole: Column) -> Column:
    """What the checks of letters and digits search: each line's, one below the other, and the whole text's."""
    return F.struct(F.array_join(F.transform(lines, T.alnum), "\n").alias("lines"), T.alnum(whole).alias("whole"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(T.text(c), "[^0-9]+", "")


def _alnum_in(value: Column, folded: Column) -> Column:
    hit = lambda v: F.contains(folded["lines"], v) | ((F.length(v) >= 6) & F.contains(folded["whole"], v))
    return T.let(T.alnum(value), lambda v: (v != "") & hit(v))


def _ids_in(cell: Column, folded: Column) -> Column:
    return T.let(T.split_ids(cell), lambda ids: (F.size(ids) > 0) & F.forall(ids, lambda s: _alnum_in(s, folded)))


def _master_in(number: Column, digits: Column) -> Column:
    both = lambda n: F.contains(digits, n) | (F.contains(digits, F.substring(n, 1, 3)) & F.contains(digits, F.substring(n, 4, 8)))
    return T.let(_digits(number), lambda n: (F.length(n) == 11) & both(n))


def in_alnum(value: Column, lines: Column, whole: Column) -> Column:
    """EVD-02: the value's letters and digits stand in one line, at any length, or six at least across lines."""
    return T.let(_folded(lines, whole), lambda x: _alnum_in(value, x))


def in_multi_id(cell: Column, lines: Column, whole: Column) -> Column:
    """EVD-03: every segment has evidence; a cell without one has none."""
    return T.let(_folded(lines, whole), lambda x: _ids_in(cell, x))


def in_master_number(number: Column, whole: Column) -> Column:
    """EVD-04: eleven digits that stand in the text's digits, in one piece or prefix and serial each for itself."""
    return T.let(_digits(whole), lambda x: _master_in(number, x))


def long_sources(value: Column, lines: Column, whole: Column, upper: Column | None = None, sources: bool = True) -> Column:
    """EVD-05: ``passed`` and ``sources`` of a long value that runs over blocks of the print.

    All tokens with digits stand somewhere, within words too; of the other words of three letters or more at most 5 % are
    missing; the first token stands no later than the last one's last place. The lines are those with any of the first 50
    tokens. Upper and lower case count alike. ``upper`` is the whole text in upper case, if it is known; without ``sources`` they are null.
    """

    def covered(x: Column) -> Column:
        body, tokens = x["body"], x["tokens"]
        digits = F.filter(tokens, lambda t: t.rlike("[0-9]"))
        words = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("[0-9]"))
        missing = F.size(F.filter(words, lambda t: ~F.contains(body, t)))
        first_at, last = F.instr(body, F.get(tokens, F.lit(0))), F.element_at(tokens, -1)
        last_at = F.length(body) - F.length(F.call_function("substring_index", body, last, F.lit(-1))) - F.length(last) + 1
        ordered = F.contains(body, last) & (first_at > 0) & (first_at <= last_at)
        some = F.size(digits) + F.size(words) > 0
        return some & F.forall(digits, lambda t: F.contains(body, t)) & (missing * 20 <= F.size(words)) & ordered

    def checked(x: Column) -> Column:
        held = lambda line: F.exists(F.slice(x["tokens"], 1, 50), lambda t: F.contains(F.upper(line), t))
        passed = (F.size(x["tokens"]) > 0) & covered(x)
        where = _numbers(lines, held) if sources else F.lit(None).cast("array<int>")
        return T.let(passed, lambda ok: F.struct(ok.alias("passed"), F.when(ok, where).alias("sources")))

    return T.let(F.struct((F.upper(whole) if upper is None else upper).alias("body"), T.tokens(F.upper(norm(value))).alias("tokens")), checked)


def date_evidence(value: Column, candidates: Column, text: Column | None = None) -> Column:
    """EVD-06: the day among the candidates, or among those without a year (``--09-24``) if its year stands in the whole
    text. Null (not counted) if the value is no day, or the text names none, or none with a year and not the value's year."""

    def judged(x: Column) -> Column:
        year = F.contains(x["text"], F.substring(x["day"], 1, 4)) if text is not None else F.lit(False)
        dated = F.exists(x["c"], lambda d: ~d.startswith("--"))
        hit = F.array_contains(x["c"], x["day"]) | (F.array_contains(x["c"], F.concat(F.lit("-"), F.substring(x["day"], 5, 6))) & year)
        return F.when(x["day"].isNotNull() & (F.size(x["c"]) > 0) & (dated | year), hit)

    parts = F.split(T.strip(value), "-")
    padded = F.when(T.strip(value).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.concat_ws("-", F.get(parts, F.lit(0)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0")))
    return T.let(F.struct(padded.alias("day"), candidates.alias("c"), T.text(F.lit("") if text is None else text).alias("text")), judged)


def missed_masters(text: Column, record: Column) -> Column:
    """EVD-07: master numbers of the text (shape and check digit) whose digits the record lacks."""
    shaped = F.regexp_extract_all(T.text(text), F.lit(r"(?<!\d)(\d{3}[- ]?\d{4} ?\d{4})(?!\d)"), 1)
    digits = F.filter(F.array_distinct(F.transform(shaped, lambda x: F.regexp_replace(x, r"\D", ""))), lambda d: T.awb_check_digit(F.substring(d, 4, 8)))
    return F.filter(digits, lambda d: ~F.contains(_digits(record), d))


def missed_ids(text: Column, record: Column) -> Column:
    """EVD-08: labelled ids of the text with eight characters or more that the record's letters and digits lack: ``column`` they
    belong in (``EORI`` or ``TAX``) and ``number``."""
    # the record is folded only for texts with ids that its values do not hold as they stand
    held = lambda n, a: F.contains(T.text(record), n) | F.contains(T.alnum(record), a)
    missed = lambda n: T.let(T.alnum(n), lambda a: (F.length(a) >= 8) & ~held(n, a))
    ids = F.transform(T.labelled_marks(text), lambda m: F.struct(F.when(m["label"].rlike("^EO"), "EORI").otherwise("TAX").alias("column"), T.clean_tax(m["number"]).alias("number")))
    return F.array_distinct(F.filter(ids, lambda m: missed(m["number"])))


def missed_hs(lines: Column, record: Column) -> Column:
    """EVD-09: runs of 6 to 10 digits behind a line's HS label whose first 6 are not in the record's HS cell."""
    return _not_captured(F.flatten(F.transform(lines, T.hs_after_colon)), record)


def _not_captured(runs: Column, record: Column) -> Column:
    captured = _digits(record)
    return F.array_distinct(F.filter(runs, lambda x: ~F.contains(captured, F.substring(x, 1, 6))))


def _missed_hs(below: Column, record: Column) -> Column:
    """``missed_hs`` of normalised lines, one below the other: all of them in one search."""
    behind = F.regexp_extract_all(F.upper(below), F.lit(r"(?U)HS(?<!\wHS)(?: *CODES?)? *:([^\n]*)"), 1)
    return _not_captured(F.regexp_extract_all(F.array_join(behind, "\n"), F.lit("([0-9]{6,10})"), 1), record)


def ranked_lines(fields: DataFrame, lines: DataFrame, key: str = "stem") -> DataFrame:
    """EVD-11: the lines with a value's best score: 2 for containment, 1 for all of its tokens of 3 letters or more."""
    words = F.filter(T.tokens(F.upper(F.col("value"))), lambda t: F.length(t) >= 3)
    there = T.tokens(F.upper(F.col("text")))
    missing = F.size(F.array_except(words, there))
    holds = F.contains(F.upper("text"), F.upper("value")) | ((F.length("value") >= 12) & (F.length("text") >= 6) & F.contains(F.upper("value"), F.upper("text")))
    some = (F.size(words) > 0) & ((missing == 0) | ((F.size(words) > 2) & (missing * 3 <= F.size(words))))
    rows = fields.where(~T.blank(F.col("value"))).join(lines, key).select(key, "field", "i", F.when(holds, 2).when(some, 1).otherwise(0).alias("score"))
    best = Window.partitionBy(key, "field")
    return rows.where("score > 0").withColumn("_best", F.max("score").over(best)).where("score = _best").drop("_best")


def text_evidence(fields: DataFrame, lines: DataFrame, key: str = "stem") -> DataFrame:
    """EVD-01, JN-17: ``passed`` and ``sources`` (line numbers) of text values. Blank values are not checked."""
    rows = fields.where(~T.blank(F.col("value"))).join(printed(lines, key), key, "left")
    empty = F.array().cast("array<string>")
    found = rows.select(key, "field", "at", text_sources(F.col("value"), F.coalesce("lines", empty), T.text(F.col("whole"))).alias("_f"))
    return found.select(key, "field", F.col("_f.passed").alias("passed"), F.transform("_f.sources", lambda p: F.element_at("at", p)).alias("sources"))


#: What a reverse check reports, and the column it is reported for.
REVERSE = {"master": "MAWB_NO", "id": "TAX_ID", "hs": "GOODS_HS_CODE"}


#: kinds of fields that are checked
KINDS = ("text", "alnum", "ids", "master", "long", "date")


def records_of(fields: DataFrame, lines: DataFrame, key: str = "stem") -> DataFrame:
    """What ``check_records`` reads: a row per record with fields, ``fields`` (sorted structs ``field, kind, value``), ``lines`` and
    ``at`` as in ``printed``."""
    held = F.collect_list(F.struct("field", "kind", F.col("value").cast("string").alias("value")))
    return fields.groupBy(key).agg(F.sort_array(held).alias("fields")).join(printed(lines, key).drop("whole"), key, "left")


def as_records(rows: DataFrame, key: str = "stem") -> DataFrame:
    """The same from rows that hold a record's ``fields`` (sorted) and ``texts``, its lines in order and as printed."""
    return rows.select(key, "fields", F.transform("texts", norm).alias("lines"), F.sequence(F.lit(1), F.greatest(F.size("texts"), F.lit(1))).alias("at"))


def evidence_job(fields: DataFrame, lines: DataFrame, key: str = "stem", **options) -> DataFrame:
    """EVD-10 on fields and lines that come as rows; ``options`` as in ``check_records``."""
    return check_records(records_of(fields, lines, key), key, **options)


def check_records(records: DataFrame, key: str = "stem", dates: Callable[[Column], Column] | None = None, reverse: tuple[str, ...] = tuple(REVERSE), hs_field: str = "GOODS_HS_CODE", sources: bool = True) -> DataFrame:
    """EVD-10: a row per check: ``field, kind, value, passed, sources``.

    Fields are checked by kind: ``text``, ``alnum``, ``ids``, ``master``, ``long`` (as text, else by tokens) and ``date`` (only if
    ``dates`` finds days and the text lets the value be checked); other kinds are captured values that no check reads. Reverse
    checks (kind ``missed``) name master numbers, labelled ids and HS codes of the print that no field holds.

    A record's fields and lines come as one row. What checks search is made once a record, then a row per field is checked
    in plain expressions, which Spark compiles. Lines are looked at for their numbers only with ``sources``, which are null otherwise.
    """
    none = F.array().cast("array<string>")
    records = records.withColumn("lines", F.coalesce("lines", none))
    records = records.select("*", _whole(F.col("lines")).alias("whole"), F.array_join("lines", "\n").alias("_below"), F.array_join(F.transform("fields", lambda f: T.text(f["value"])), " ").alias("_values"))
    # normalised lines hold no line feed
    records = records.select("*", F.upper("whole").alias("_upper"), F.regexp_replace("_below", r"[\P{Alnum}&&[^\n]]+", "").alias("_letters"))
    records = records.select("*", F.replace("_letters", F.lit("\n"), F.lit("")).alias("_all_letters"), F.regexp_replace("_letters", "[^0-9]+", "").alias("_digits"))
    records = records.withColumn("_days", none if dates is None else dates(F.col("whole")))
    whole = F.col("whole")
    hs_value = F.get(F.filter("fields", lambda f: f["field"] == hs_field), F.lit(0))["value"]
    missed = {
        "master": lambda: (REVERSE["master"], missed_masters(whole, F.col("_values"))),
        "id": lambda: (REVERSE["id"], F.transform(missed_ids(whole, F.col("_values")), lambda m: m["number"])),
        "hs": lambda: (hs_field, _missed_hs(F.col("_below"), hs_value)),
    }
    named = lambda field, values: F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), F.lit("missed").alias("kind"), v.alias("value")))
    every = F.concat("fields", *[named(*missed[r]()) for r in reverse])
    about = [*(["at", "lines"] if sources else []), "whole", "_upper", "_letters", "_all_letters", "_digits", "_days"]
    rows = records.select(key, *about, F.explode(every).alias("_f")).select(key, *about, "_f.*")

    value, kind = F.col("value"), F.col("kind")
    kinds = [k for k in KINDS if dates is not None or k != "date"]
    rows = rows.where((kind.isin(*kinds) & ~T.blank(value)) | (kind == "missed"))
    # the value as its kind's check searches it
    rows = rows.withColumn("_v", F.when(kind.isin("text", "long"), norm(value)).when(kind == "alnum", F.regexp_replace(value, r"\P{Alnum}+", "")).when(kind == "master", _digits(value)))
    v, there = F.col("_v"), F.contains(whole, F.col("_v"))
    folded = F.struct(F.col("_letters").alias("lines"), F.col("_all_letters").alias("whole"))
    no_lines = F.lit(None).cast("array<int>")
    if sources:
        exact = lambda: text_sources(value, F.col("lines"), whole)
        found = F.when(kind == "text", exact()["sources"]).when(kind == "long", F.when(there, exact()["sources"]).otherwise(long_sources(value, F.col("lines"), whole, F.col("_upper"))["sources"]))
        found = F.transform(found, lambda p: F.element_at("at", p))
    else:
        found = no_lines
    passed = (
        F.when(kind == "missed", False).when(kind == "text", there)
        .when(kind == "long", there | long_sources(value, F.array().cast("array<string>"), whole, F.col("_upper"), sources=False)["passed"])
        .when(kind == "alnum", (v != "") & (F.contains("_letters", v) | ((F.length(v) >= 6) & F.contains("_all_letters", v))))
        .when(kind == "ids", _ids_in(value, folded))
        .when(kind == "master", (F.length(v) == 11) & (F.contains("_digits", v) | (F.contains("_digits", F.substring(v, 1, 3)) & F.contains("_digits", F.substring(v, 4, 8)))))
    )
    if dates is not None:
        passed = passed.when(kind == "date", date_evidence(value, F.col("_days"), whole))
    rows = rows.select(key, "field", "kind", "value", passed.alias("passed"), found.alias("sources"))
    # days alone may be left open: only their checks are asked before they are made
    return rows.where((kind != "date") | F.col("passed").isNotNull())


def fidelity_summary(checks: DataFrame, key: str = "stem") -> DataFrame:
    """AGG-14, a row per record: counts, the failed fields and ``sources``, a map of fields to their lines."""
    lines = F.map_from_entries(F.collect_list(F.when(F.size("sources") > 0, F.struct("field", "sources"))))
    return checks.groupBy(key).agg(F.count(F.lit(1)).alias("checked"), F.count_if("passed").alias("passed"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("field")))), ",").alias("failed"), lines.alias("sources"))


def fidelity_batch(summary: DataFrame) -> DataFrame:
    """AGG-14, a row for the batch: records, those with a failed check, and the counts over all."""
    return summary.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("checked") > F.col("passed")).alias("with_failures"), F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"))


def anchor_lines(flags: DataFrame, sources: DataFrame, lines: DataFrame, most: int = 12, key: str = "stem") -> DataFrame:
    """FN-23: lines of a flag: the recorded ones, else those that hold its value; at most ``most``, a display limit."""
    found = flags.join(lines, key).where((T.alnum(F.col("value")) != "") & F.contains(T.alnum_upper(F.col("text")), T.alnum_upper(F.col("value")))).groupBy(key, "field").agg(F.array_sort(F.collect_set("i")).alias("_seen"))
    joined = flags.join(sources, [key, "field"], "left").join(found, [key, "field"], "left")
    return joined.select(key, "field", F.slice(F.coalesce("sources", "_seen", F.array().cast("array<int>")), 1, most).alias("lines"))
