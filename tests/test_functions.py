"""Worked examples of the value functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dictionaries as D
from tallyforge.functions import text as T
from tallyforge.operators import evidence as V
from tallyforge.operators import accuracy as A
from tallyforge.operators import events as E
from tallyforge.operators import standardise as S

CASES = [
    (T.norm_no, "235-9614 6363", "23596146363"),
    (T.sym_to_space, "ROOM 101-3", "ROOM 101 3"),
    (T.sym_to_space, "a@b.COM", "a b COM"),
    (T.sym_to_space, "  A   B  ", "A B"),
    (T.sym_to_space, "SÃO PAULO", "SÃO PAULO"),
    (T.fmt_mawb, "131-3306 2536", "131-33062536"),
    (T.fmt_mawb, "999-PEK06865456", "999-06865456"),
    (T.fmt_mawb, "074-PEK68614", "074-PEK 68614"),
    (T.awb_check_digit, "12345675", True),
    (T.hs6, "HS CODE:8526109 HS CODE:8412210", "852610,841221"),
    (T.hs6, "852610", "852610"),
    (T.hs6, "none", ""),
    (T.clean_phone, "+46 (0)70 11 22 333", "+46701122333"),
    (T.clean_phone, "02011112222", "02011112222"),
    (T.clean_phone, "text only", ""),
    (T.phone_cell, "+86 10 11112222 / 13811112222", "861011112222"),
    (T.id_cell, "CNPJ: 11.222.333/0001-44", "CNPJ11222333000144"),
    (T.id_cell, "VAT#123456789", "VAT123456789"),
    (T.id_cell, "VAT NO", ""),
    (T.id_cell, "SE1234567890", "SE1234567890"),
    (T.clean_tax, "VAT#123456789", "123456789"),
    (T.clean_tax, "TAX ID 123456789", "123456789"),
    (T.classify_id, "VAT IT01234567890", "eori"),
    (T.classify_id, "USCI 911100001111222233", "tax"),
    (T.classify_id, "EORI", None),
    (T.bare, "São  Paulo.", "SAO PAULO"),
    (T.as_num, "1,200.5", 1200.5),
    (T.as_num, "1d", None),
    (lambda c: T.coerce_num(c, True), "12 KGM", 12),
    (lambda c: T.coerce_num(c, True), "1.5", None),
    (T.coerce_num, "abc", None),
    (lambda c: T.postal_format(c, F.lit("BR")), "04546040", "04546-040"),
    (lambda c: T.postal_format(c, F.lit("NL")), "1234 ab", "1234 AB"),
    (lambda c: T.postal_format(c, F.lit("DE")), "12345", None),
    (lambda c: T.postal_format(c, F.lit("BR")), "0454604", None),
    (lambda c: T.postal_wrong(c, F.lit("BR")), "0454604", True),
    (lambda c: T.postal_wrong(c, F.lit("SE")), "SE-114 33", False),
    (lambda c: T.postal_wrong(c, F.lit("AE")), "123", False),
    (lambda c: F.array_join(S.date_candidates(c), ","), "20-Sep-26", "2026-09-20"),
    (lambda c: F.array_join(S.date_candidates(c), ","), "Sep 21, 2026", "2026-09-21"),
    (lambda c: F.array_join(S.date_candidates(c), ","), "2026年9月22日", "2026-09-22"),
    (lambda c: F.array_join(S.date_candidates(c), ","), "19-9月-26", "2026-09-19"),
    (lambda c: F.array_join(S.date_candidates(c), ","), "20260920", "2026-09-20"),
    (lambda c: F.array_join(S.date_candidates(c), ","), "MAWB 020-19025661", ""),
]


def test_worked_examples(spark):
    rows = spark.createDataFrame([(v,) for _, v, _ in CASES], "v string").repartition(1)
    wide = [f(F.lit(v)) for f, v, _ in CASES]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(wide)]).first()
    assert rows.count() == len(CASES)
    for i, (_, value, want) in enumerate(CASES):
        assert got[i] == want, (value, got[i], want)


@pytest.mark.parametrize("kind,a,b,same", [("no", "235-96146363", "23596146363", True), ("num", "170.0", "170", True), ("text", "STEEL  PARTS", "STEEL PARTS", True), ("text", "STEEL", "steel", False), ("text", None, " ", True), ("int", "", "0", False)])
def test_same_value(spark, kind, a, b, same):
    assert spark.range(1).select(T.same_value(F.lit(kind), F.lit(a), F.lit(b))).first()[0] is same


def test_idempotent(spark):
    once = spark.createDataFrame([("CNPJ: 1.2/3-4 5", "+46 (0)70"), (None, None), ("", "x")], "a string, b string").select(T.id_cell(F.col("a")).alias("a"), T.phone_cell(F.col("b")).alias("b"))
    twice = once.select(T.id_cell(F.col("a")).alias("a"), T.phone_cell(F.col("b")).alias("b"))
    assert once.collect() == twice.collect()


def test_suppression_compares_with_the_last_accepted_write(spark):
    events = [("k", at, fp, True) for at, fp in ((0, "x"), (50, "x"), (60, "y"), (70, "x"), (200, "x"))]
    out = E.suppress_repeats(spark.createDataFrame(events, "key string, at long, fp string, ok boolean"), 90)
    assert [r["accepted"] for r in out.orderBy("at").collect()] == [True, False, True, True, True]


def test_address_without_commas_loses_its_tail(spark):
    rows = [
        ("MAIN ST 5 10115 BERLIN GERMANY", "10115", "GERMANY", None, "BERLIN", "MAIN ST 5"),
        ("5 Long Road New York 10001 NEW YORK USA US", "10001", "USA", "New York", "NEW YORK", "5 Long Road"),
        ("HEBEI ROAD 7 CITY LANGFANG HEBEI 066200 CN", "066200", "CHINA", "HEBEI", "LANGFANG", "HEBEI ROAD 7"),
        ("BERLIN STREET 4", None, None, None, "BERLIN", "BERLIN STREET 4"),
        ("BERLIN", None, None, None, "BERLIN", ""),
        ("ROAD 1, BERLIN, GERMANY", None, "GERMANY", None, "BERLIN", "ROAD 1"),
        (None, "1", "USA", None, "X", ""),
    ]
    df = spark.createDataFrame(rows, "address string, postal string, country string, state string, city string, want string").withColumn("stem", F.lit("s"))
    got = S.address_residual(df, "stem", "address", ["postal", "country", "state", "city"], ("postal", "country", "state", "city")).collect()
    assert [r["street"] for r in got] == [r["want"] for r in got]


def test_dates_of_all_printed_forms(spark):
    cases = [("24SEP", "--09-24"), ("20SEP26", "2026-09-20"), ("20SEP2026", "2026-09-20"), ("26/09/2026", "2026-09-26"), ("05/09/2026", "2026-05-09,2026-09-05"), ("9月16日", "--09-16"), ("19-9月-26日", "2026-09-19"), ("2026 09 20", "2026-09-20"), ("20 Sep. 2026", "2026-09-20"), ("", ""), (None, ""), ("2026-13-40", "")]
    df = spark.createDataFrame(cases, "text string, want string")
    got = df.select("text", "want", F.array_join(S.date_candidates(F.col("text")), ",").alias("got")).collect()
    assert [(r["text"], r["got"]) for r in got] == [(r["text"], r["want"]) for r in got]
    rows = [("2026-09-24", "24SEP FLIGHT, 2026", True), ("2025-09-24", "24SEP FLIGHT, 2026", None), ("2026-09-24", "24SEP", None), ("2026-09-26", "26/09/2026", True), ("2026-09-26", "none", None)]
    df = spark.createDataFrame(rows, "day string, text string, want boolean")
    got = df.select("want", V.date_evidence(F.col("day"), S.date_candidates(F.col("text")), F.col("text")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_suppression_does_not_gather_a_key(spark):
    rows = spark.range(30_000).select(F.lit("hot").alias("key"), F.col("id").alias("at"), F.lit("x").alias("fp"), (F.col("id") % 1000 != 0).alias("ok"))
    out = E.suppress_repeats(rows, 90)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    # a write is accepted when the last accepted one is 90 old; the one at 0 failed and left no memory
    assert [r["at"] for r in out.where("accepted").orderBy("at").limit(4).collect()] == [0, 1, 91, 181]
    assert out.count() == 30_000


def test_city_lookup_order_and_permutation(spark):
    names = ["Manaus", "FRA", "Beijing Capital International Apt", "PEK-PEKING", "", None, "Nowhere"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, city string")
    for df in (rows, rows.repartition(3).orderBy(F.desc("i"))):
        got = {r["i"]: r["city_code"] for r in S.city_code(df, "city", D.cities(spark)).collect()}
        assert [got[i] for i in range(7)] == ["MAO", "FRA", "BJS", "BJS", "", "", "NOWHERE"]


def test_dictionaries_know_the_whole_reference(spark):
    assert (len(D.COUNTRIES), len(D.CITIES), {k: len(v) for k, v in D.STATES.items()}) == (116, 201, {"US": 56, "CA": 13, "BR": 27, "AU": 8})
    rows = [("c", k, v) for k, v in D.COUNTRIES.items()] + [("c", "People's Republic of China", "CN"), ("c", "Bangladesh", "BD"), ("c", "Republic of Korea", "KR")]
    got = S.country_iso2(spark.createDataFrame(rows, "kind string, name string, want string"), "name", D.countries(spark)).collect()
    assert len(got) == len(rows) and all(r["country_iso2"] in (r["want"], r["name"]) if len(r["name"]) == 2 else r["country_iso2"] == r["want"] for r in got)
    rows = [(k, v) for k, v in D.CITIES.items()] + [("Hamburg", "HAM"), ("Xi'an", "XIY"), ("dubai", "DXB")]
    assert [(r["name"], r["city_code"]) for r in S.city_code(spark.createDataFrame(rows, "name string, want string"), "name", D.cities(spark)).where("want <> city_code").collect()] == []
    rows = [(cc, k, v) for cc, t in D.STATES.items() for k, v in t.items()] + [("US", "Pennsylvania", "PA")]
    found = S.state_code(spark.createDataFrame(rows, "cc string, name string, want string"), "name", "cc", D.states(spark))
    assert found.where("want <> state_code or state_code is null").isEmpty()


def test_no_cross_join_on_dictionaries(spark):
    rows = spark.createDataFrame([(1, "+46 1"), (2, "+358 2")], "k int, tel string")
    plan = S.longest_prefix(rows, "tel", D.dial_codes(spark))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_labels_with_dots_and_in_chinese(spark):
    df = spark.createDataFrame([("R.F.C. ABC123456789",), ("统一社会信用代码：91110000111122223X",), ("TAX 123456789",), ("gstin 22AAAAA0000A1Z5",)], "t string")
    assert [r[0] for r in df.select(F.array_join(T.labelled_ids(F.col("t")), ",")).collect()] == ["ABC123456789", "91110000111122223X", "", "22AAAAA0000A1Z5"]
    assert [r[0] for r in df.select(T.clean_tax(F.col("t"))).collect()] == ["ABC123456789", "91110000111122223X", "123456789", "22AAAAA0000A1Z5"]


def test_evidence_on_lines(spark):
    lines = [("a", 1, "ACME  Gmbh"), ("a", 2, "Room101 EAST"), ("a", 3, "10115 Berlin，HS CODE： 8526109"), ("a", 4, "020-1234 5675")]
    prints = spark.createDataFrame(lines, "stem string, i int, text string")
    cases = [
        ("POSTAL", "alnum", "10115", True), ("HOUSE", "alnum", "9 99", False), ("TEL", "alnum", "EAST 10115", True),
        ("ADDR", "long", "ACME ROOM 101 EAST", True), ("FAR", "long", "EAST ACME", False), ("LOST", "long", "ACME ROOM 102", False), ("NONE", "long", "--", False),
        ("TAX", "ids", "Room101 / 10115", True), ("EORI", "ids", "Room101 / 99", False),
        ("M1", "master", "020-12345675", True), ("M2", "master", "none", False), ("M3", "master", "020-1234567", False), ("M4", "master", "020-12345670", False),
        ("CASE", "text", "acme Gmbh", False), ("ACROSS", "text", "Gmbh Room101", True), ("FIVE", "text", "Berlin,HS", True), ("EMPTY", "text", " ", None),
    ]
    fields = spark.createDataFrame([("a", f, k, v) for f, k, v, _ in cases], "stem string, field string, kind string, value string")
    got = {r["field"]: r for r in V.evidence_job(fields, prints, reverse=()).collect()}
    assert {f: got[f]["passed"] if f in got else None for f, _, _, _ in cases} == {f: want for f, _, _, want in cases}
    assert (got["ADDR"]["sources"], got["ACROSS"]["sources"], got["FIVE"]["sources"]) == ([1, 2, 3], [1, 2], [3])
    missed = V.evidence_job(fields.where("field = 'CASE'"), prints).where("kind = 'missed'").collect()
    assert sorted((r["field"], r["value"]) for r in missed) == [("GOODS_HS_CODE", "8526109"), ("MAWB_NO", "02012345675")]
    summary = V.fidelity_summary(V.evidence_job(fields, prints)).first()
    assert summary["sources"]["ADDR"] == [1, 2, 3] and summary["checked"] == len(cases) - 1 + 1
    # a record without lines has no evidence
    assert [r["passed"] for r in V.evidence_job(fields.where("field IN ('ADDR', 'M1')").withColumn("stem", F.lit("b")), prints).collect()] == [False, False]


def test_evidence_without_sources(spark):
    """The same checks pass; lines are not looked at for their numbers."""
    prints = spark.createDataFrame([("a", 1, "House: H-1"), ("a", 2, "ACME"), ("a", 3, "LTD, 24-Sep-26 x")], "stem string, i int, text string")
    fields = spark.createDataFrame([("a", "T", "text", "ACME LTD"), ("a", "L", "long", "acme ltd"), ("a", "H", "alnum", "h1"), ("a", "N", "alnum", "H 1"), ("a", "I", "ids", "H1 / LTD24"), ("a", "D", "date", "2026-09-24")], "stem string, field string, kind string, value string")
    job = lambda sources: {r["field"]: r for r in V.evidence_job(fields, prints, dates=S.date_candidates, sources=sources).collect()}
    with_, without = job(True), job(False)
    assert {f: r["passed"] for f, r in with_.items()} == {f: r["passed"] for f, r in without.items()} == {"T": True, "L": True, "H": False, "N": True, "I": True, "D": True}
    assert with_["T"]["sources"] == [2, 3] and all(r["sources"] is None for r in without.values())


def test_hs_and_ids_in_running_text(spark):
    cases = [("HSCODE: 89031200", "89031200"), ("hs：7007290000", "7007290000"), ("HS Codes : 853890, 850511 X 1234567", "853890,850511,1234567"), ("THS: 853890", ""), ("HS 853890", ""), ("NET 12: HS CODE: 12345 850152", "850152"), (None, "")]
    df = spark.createDataFrame(cases, "t string, want string")
    got = df.select("want", F.array_join(T.hs_after_colon(F.col("t")), ",").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    cases = [("GOODS HS CODE 8526.10, 8471；9001 PIPES 12345678", "852610,8471,9001"), ("H.S. CODES：8471，9001", "8471,9001"), ("HS码 8471", "8471"), ("HS 8471", "")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r[1] for r in df.select("want", T.hs_from_text(F.col("t"))).collect()] == [w for _, w in cases]
    cases = [("Road 5 VAT NO: DE123456789 Berlin", "Road 5 Berlin"), ("TAX ID 1234567 X", "X"), ("VAT no number here", "VAT no number here"), ("Room #5", "Room #5")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [(r[0], r[1]) for r in df.select("want", T.without_ids(F.col("t"))).collect()] == [(w, w) for _, w in cases]


def test_status_and_progress_of_cells(spark):
    cells = [("s", "A", 1, False, "x", "x", False), ("s", "B", 2, True, "x", "x", False), ("s", "C", 0, False, "", " ", False), ("s", "D", 0, True, "", "", True), ("s", "E", 0, False, None, "", True), ("s", "F", 0, False, "x", "", False), ("s", "G", 0, False, "", "y", False)]
    df = spark.createDataFrame(cells, "stem string, field string, flags int, acked boolean, raw string, air string, skip boolean")
    got = {r["field"]: (r["status"], r["todo"]) for r in A.cell_status(df).collect()}
    assert got == {"A": ("flag", True), "B": ("confirmed", False), "C": ("empty", True), "D": ("emptyok", False), "E": ("skipped", False), "F": ("miss", False), "G": ("same", False)}
    state = {r["grp"]: tuple(r)[2:] for r in A.segment_state(df, {"A": "one", "C": "one", "G": "one", "C2": "x", "E": "two"}).collect()}
    assert state == {"one": (3, 2, 1, 1, 1, "hasflag"), "two": (1, 0, 0, 0, 1, "clear"), "other": (3, 0, 0, 0, 3, "clear")}


def test_error_kind_of_a_missing_setting(spark):
    df = spark.createDataFrame([("SystemExit: no key",), ("OSError: disk",), ("",), ("RuntimeError: read Timeout",)], "error string")
    assert sorted(r["error_kind"] for r in S.error_kind(df, "error").collect()) == ["", "OSError", "not configured", "timeout"]


def test_addresses_with_commas_keep_their_street(spark):
    rows = [
        ("Room 5, No 8 Park Road, Hangzhou, Zhejiang 310000, China", "CHINA", "ROOM 5, NO 8 PARK ROAD"),
        ("Hauptstr. 5, 10115 Berlin, DE", "GERMANY", "HAUPTSTR. 5"),
        ("ACME Ltd, 12 Long Street, Unit 4, London SW1A 1AA, United Kingdom", "UNITED KINGDOM", "12 LONG STREET, UNIT 4"),
        ("Rua A 7, TEL: +55 11 2222, 04546-040 Sao Paulo, Brazil", "BRAZIL", "RUA A 7"),
        ("Georgia House, 5 Oak Avenue, Atlanta, Georgia 30301", "", "HOUSE, 5 OAK AVENUE"),
        ("Berlin, Germany", "GERMANY", "Berlin, Germany"), ("Main Road 1", "", "Main Road 1"), (None, "", ""),
    ]
    df = spark.createDataFrame(rows, "address string, country string, want string").withColumn("company", F.lit("acme ltd"))
    got = S.streets(df, "address", "country", D.countries(spark), "company").collect()
    assert len(got) == len(rows) and [(r["address"], r["street"]) for r in got if r["street"] != r["want"]] == []


def test_ids_go_to_the_cell_of_their_kind(spark):
    rows = [
        ("SE5563646560 / CNPJ: 11.222.333/0001-44", "VAT NO 123456789", "Road 5 EORI NO IT03268900267 Rome", "SE5563646560 / EORINOIT03268900267", "CNPJ11222333000144 / VATNO123456789", "Road 5 Rome"),
        ("", "", "Road 5 VAT NO 123456789, TAX ID 987654321", "", "VATNO123456789", "Road 5 TAX ID 987654321"),
        ("VAT NO IT03268900267", "", "x VAT IT03268900267", "VATNOIT03268900267", "", "x"),
        (None, None, None, "", "", ""),
    ]
    df = spark.createDataFrame(rows, "eori string, tax string, address string, e string, t string, a string")
    got = df.select("e", "t", "a", S.routed_ids(F.col("eori"), F.col("tax"), F.col("address"), [F.lit("+49 30")]).alias("r")).select("e", "t", "a", "r.*").collect()
    assert [(r["eori"], r["tax"], r["address"]) for r in got] == [(r["e"], r["t"], r["a"]) for r in got]


def test_master_records_are_cleaned_by_column(spark):
    given = {
        "MAWB_NO": " 176 62400004 ", "SLAC": "12.0", "GOODS_INFO_HSCODE": "HS CODE:8526109 / 8412210", "SHIPPER_INFO_COUNTRY": None, "SHIPPER_INFO_COMP_NAME": " STEEL   (NORTH) CO., LTD.",
        "SHIPPER_INFO_POSTAL": "101-300", "CONSIGNEE_INFO_EORI": " sa48 27430 / fr 1 ", "CONSIGNEE_INFO_TEL": "+86 22 2532 / 99", "NOTIFY_INFO_COUNTRY": "sa.", "NOTIFY_INFO_AEO": "aeo cn-12", "NOTIFY_INFO_EMAIL": "a@b.COM", "CONSIGNEE_INFO_CITY": "  ", "HMY_ID": "7",
    }
    wanted = {
        "MAWB_NO": "176-62400004", "SLAC": "12", "GOODS_INFO_HSCODE": "852610,841221", "SHIPPER_INFO_COUNTRY": "CN", "SHIPPER_INFO_COMP_NAME": "STEEL NORTH CO LTD",
        "SHIPPER_INFO_POSTAL": "101-300", "CONSIGNEE_INFO_EORI": "SA4827430 / FR1", "CONSIGNEE_INFO_TEL": "86222532", "NOTIFY_INFO_COUNTRY": "SA", "NOTIFY_INFO_AEO": "AEOCN 12", "NOTIFY_INFO_EMAIL": "a b COM", "CONSIGNEE_INFO_CITY": None,
    }
    rows = spark.createDataFrame([(given,), ({"SLAC": "x", "GOODS_INFO_HSCODE": "none", "MAWB_NO": "176-6240004"},), ({},)], "ams map<string,string>")
    once = rows.select(S.standardise_master(F.col("ams")).alias("ams"))
    got = [r["ams"] for r in once.collect()]
    assert got == [wanted, {"SLAC": None, "GOODS_INFO_HSCODE": "none", "MAWB_NO": "176-6240004"}, {}]
    twice = once.select(S.standardise_master(F.col("ams")).alias("ams"))
    assert [r["ams"] for r in twice.collect()] == [{**wanted, "NOTIFY_INFO_AEO": "AEOCN12"}, *got[1:]]
    body = S.master_body(once, "ams", [])
    assert body.columns == D.MASTER_COLUMNS and len(body.columns) == 39
    first = body.first()
    assert first["SLAC"] == 12 and first["NOTIFY_INFO_CITY"] is None


def test_a_street_that_holds_the_figures_of_the_postal_code_stays(spark):
    rows = [("a", "101153 Long Road, Unit 1, 10115 Berlin", "101153 LONG ROAD, UNIT 1"), ("b", "310000 Long Road, Hangzhou, Zhejiang 310000, China", "310000 LONG ROAD")]
    df = spark.createDataFrame(rows, "k string, address string, street_expected string").withColumn("country", F.lit(""))
    got = {r["k"]: (r["street"], r["street_expected"]) for r in S.streets(df, "address", "country", D.countries(spark)).collect()}
    assert all(a == b for a, b in got.values()), got


def test_rows_that_take_much_work_are_dealt_out(spark):
    df = S.spread(spark.range(100).coalesce(1).select(F.lit("x").alias("MAWB_NO"), "id"))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_overlapping_prints_of_days_and_words_before_them(spark):
    rows = [("2026-09-24/10/2026", ["2026-09-24", "2026-10-24"]), ("01/02/2026", ["2026-01-02", "2026-02-01"]), ("X24SEP26", []), ("24SEP, 2026", ["2026-09-24"]), ("_\n20260924", ["2026-09-24"])]
    got = spark.createDataFrame(rows, "t string, e array<string>").select("t", "e", S.date_candidates(F.col("t")).alias("g")).collect()
    assert [(r["t"], r["g"]) for r in got] == [(t, e) for t, e in rows]


def test_rightmost_phrase_of_large_and_small_dictionaries(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Road 1, New York, United States"), (2, "Paris France 7"), (3, "none"), (4, None), (5, "United")], "k int, t string")
    small = {r["k"]: r["phrase"] for r in S.rightmost_phrase(df, "k", "t", D.countries(spark)).collect()}
    monkeypatch.setattr(S, "PLAN_PHRASES", 10)
    large = {r["k"]: r["phrase"] for r in S.rightmost_phrase(df, "k", "t", D.countries(spark)).collect()}
    assert small == large == {1: "UNITED STATES", 2: "FRANCE", 3: None, 4: None, 5: None}


def test_rows_of_one_city_stay_dealt_out(spark):
    """All rows name one city: its code comes to them; they don't go to one task for it."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") >= 0, "Tokyo").alias("TO1"))
        out = S.city_codes(rows, {"TO1": "TO1"}, D.cities(spark))
        assert sorted(tuple(r) for r in out.select("TO1", F.spark_partition_id()).distinct().collect()) == [("TYO", i) for i in range(4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_known_parts_are_folded_once_a_row(spark):
    cols = [F.col(c) for c in ("a", "p", "c", "s", "t")]
    rows = [("Road 1 12345 Rome City  ITALY IT", "12345", "Italy", "", "Rome"), ("1 A St New York, NY 10001 USA", "10001", "USA", "NY", "New York"), ("Rome Rome", "", "", "", "Rome"), ("", "1", "", "", ""), ("Street Italy Milan City", "", "Italy", "", "City")]
    found = spark.createDataFrame(rows, "a string, p string, c string, s string, t string").select(S.strip_tail(*cols).alias("x"))
    assert [r["x"] for r in found.collect()] == ["Road 1 12345 Rome City", "1 A St", "", "", "Street Italy Milan"]
    assert "regexp_replace" not in found._jdf.queryExecution().analyzed().toString().split("aggregate(")[1]


def test_labelled_ids_in_one_search(spark):
    """The search of the whole text finds what the words one by one do, and looks at no word by its place."""
    ascii_parts = ["VAT", "v.a.t.", "NO", "/no.", "NUMBER", "EORI", "eoi", "GST", "IN", "TAX", "ID", "TAXID", "R.F.C.", "X-VAT", "-VAT", ":", "#", "(", ",", "DE123456789", "DE123456789,,", "1234567", "123456", "AB12.34-5/6", "ABCD1234567", "\n", "  "]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ps) + rnd.choice([" ", " ", ""]) for _ in range(rnd.randint(0, 12))) for ps in (ascii_parts, [*ascii_parts, "：", "（", "统一社会信用代码", "　", "\x85", "é", "​"]) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = lambda m: F.transform(m, lambda x: F.struct(x["label"].alias("label"), x["number"].alias("number")))
    both = df.select("t", T.labelled_marks(F.col("t")).alias("got"), plain(T.id_marks(T._words(F.col("t")))).alias("want"))
    assert both.where("NOT got <=> want").collect() == [] and both.where("size(want) > 0").count() > 300
    assert "sequence(" not in df.select(T.labelled_marks(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_whole_print_holds_the_ids_of_the_lines(spark):
    """A label at the end of a line, its number on the next; a blank line; full-width marks."""
    lines = [("a", 1, "ACME  VAT"), ("a", 3, "NO：DE123456789，"), ("a", 2, None), ("b", 2, "IT3268900267"), ("b", 1, " EORI NO"), ("c", 1, "VAT 1234567")]
    prints = spark.createDataFrame(lines, "stem string, i int, text string")
    ids = lambda rows: {r["stem"]: [tuple(x) for x in r["m"]] for r in rows.select("stem", V.missed_ids(F.col("whole"), F.lit("IT-3268 ")).alias("m")).collect()}
    assert ids(V.whole_print(prints)) == ids(V.printed(prints)) == {"a": [("TAX", "DE123456789")], "b": [("EORI", "IT3268900267")], "c": []}
    assert [V.whole_print(prints).where("stem = 'c'").first()["whole"]] == ["VAT 1234567"]
