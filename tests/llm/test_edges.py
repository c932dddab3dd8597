"""Empty tables, repeated rows, ties, very long texts and clashing columns, operator by operator."""

from __future__ import annotations

import pytest
from llm.helpers import documents, frame, prose

from tallyforge.llm import bpe, fingerprint, html, language, neardup, packing, quality, toxicity, urls

LABELS = "doc_id long, quality int, toxic int"


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_empty_tables(spark):
    docs, none = documents(spark, [prose(1, 60)]).limit(0), spark.createDataFrame([], LABELS)
    assert quality.judge(docs, none).count() == 0 and quality.keep_good(docs, none).columns == docs.columns
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, none)).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert bpe.digests(docs, vocabulary("word_bpe_49k.json")).count() == 0
    assert packing.pieces_of(docs, vocabulary("byte_bpe_50k.json")).count() == 0
    assert neardup.keep_one(docs).columns == docs.columns


def test_repeated_rows_are_judged_alike(spark):
    docs = frame(spark, [(7, prose(3, 60), "en", "s", 0, "x")] * 2 + [(8, prose(4, 60), "en", "s", 0, "x")] * 2)
    pairs = lambda rows: [[r for r in rows if r["doc_id"] == i] for i in (7, 8)]
    for found in (language.identify(docs, language.fit(docs)), bpe.digests(docs, vocabulary("word_bpe_49k.json")), quality.judge(docs, spark.createDataFrame([], LABELS)), fingerprint.compare(docs)):
        assert all(len(p) == 2 and p[0] == p[1] for p in pairs(found.collect()))
    graded = toxicity.grade(docs, toxicity.OrdinalModel({"river*": 2.0})).collect()
    assert all(len(p) == 2 and p[0]["severity"] == p[1]["severity"] for p in pairs(graded))
    page = (1, "http://a.b/c", "<article><p>text</p></article>")
    assert [r["text"] for r in html.extract(spark.createDataFrame([page, page], "page_id long, url string, html string")).collect()] == ["text", "text"]


def test_very_long_texts(spark):
    text = prose(5, 90_000)
    assert len(text) > 700_000
    docs = documents(spark, [text, text.replace("river", "brook", 1), prose(6, 60)])
    (a, b, c) = sorted(quality.judge(docs, spark.createDataFrame([], LABELS)).collect(), key=lambda r: r["doc_id"])
    assert a["n_words"] == b["n_words"] == len(text.split())
    same = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert same == {0: 0, 1: 0, 2: 2}
    pieces = packing.pieces_of(docs, vocabulary("byte_bpe_50k.json")).where("doc_id = 0").toPandas().sort_values("piece")
    assert pieces.start.tolist() == (pieces.length.cumsum() - pieces.length).tolist() and len(pieces) > 100
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs, vocabulary("word_bpe_49k.json")).collect()}[0] > 90_000
    assert language.identify(docs, language.fit(docs)).count() == 3
    assert len(html.main_text(f"<article><p>{text}</p></article>", html.fit_tree(html.labelled_rows(html.LABELLED_PAGES)))) > 600_000
    near = {r["doc_id"]: r for r in fingerprint.compare(docs).collect()}
    assert near[0]["n_chars"] == len(text) and near[0]["near_next"] > 0.99


def test_ties(spark):
    # equal pieces are packed one by one; of equally long rules the longer host wins
    pieces = spark.createDataFrame([(1, 0, 0, 512, 9)] * 6, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces).collect()
    assert len(packed) == 6 and len({r["sequence_id"] for r in packed}) == 3
    rules = [urls.Rule("block", "b.cc", "/"), urls.Rule("allow", "cc", "/ab")]
    pages = spark.createDataFrame([(1, "http://b.cc/abc")], "page_id long, url string")
    assert urls.judge(pages, rules).first()["rule"] == "b.cc/"
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    assert urls.judge_by_join(pages, table).first()["rule"] == "b.cc/"


def test_pipeline_stages_pass_other_columns_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    vocabulary("byte_bpe_50k.json")
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, [prose(1, 80), None, prose(2, 80)]).selectExpr("*", "concat('k', doc_id) AS kept", "'a' AS _row", "2 AS block", "doc_id + 5 AS _doc", "CAST(7 AS INT) AS n_bytes", "named_struct('x', doc_id) AS spans", "'w' AS _text", "doc_id AS cls")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        kept = {r["doc_id"]: r["text"] for r in rows}
        for r in rows:  # other columns keep their values, whatever their names
            assert (r["kept"], r["_row"], r["block"], r["_doc"], r["n_bytes"], r["spans"]["x"], r["_text"], r["cls"]) == (f"k{r['doc_id']}", "a", 2, r["doc_id"] + 5, 7, r["doc_id"], "w", r["doc_id"]), name
            assert out.schema["n_bytes"].dataType.simpleString() == "int"
        assert kept[0] == prose(1, 80) and kept[2] == prose(2, 80)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
