"""Operators on single texts: quality, toxicity, language, html, urls, BPE."""

from __future__ import annotations

import collections
import hashlib
import os
import re

import pytest
from llm.helpers import awkward, documents, frame, prose

from tallyforge.llm import bpe, html, language, quality, toxicity, urls


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- quality ---------------------------------------------------------------------


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(w, w[1:], w[2:], strict=False))
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts_match_brute_force(spark):
    texts = [*awkward(), "a b c a b c a b", "x x x x", "one two\none two\n\nthree", "a b c d a b c " * 20]
    docs = documents(spark, texts)
    got = quality.judge(docs, labels(spark, [])).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"])  # nothing to set a threshold from


def test_quality_ratio_parts_junk_from_prose(spark):
    rows = [(i, prose(i, 80), "en", "s", 0, "x") for i in range(60)] + [(100 + i, " | ".join(prose(i, 80).upper().split()), "en", "s", 0, "x") for i in range(60)]
    marks = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 60, 2)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels(spark, marks)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(60))
    kept = quality.keep_good(docs, labels(spark, marks))
    assert kept.columns == docs.columns and kept.count() == 60


def test_quality_learns_from_every_label(spark):
    """Labels of 400,000 other documents beside them take none of the 60 from the fit."""
    good = [prose(i, 80) for i in range(30)]
    junk = [" ".join(f"zz{(i * 7 + k * k) % 997} buy{(k * 31 + i) % 499}" for k in range(40)) for i in range(30)]
    docs = documents(spark, good + junk)
    own = labels(spark, [(i, int(i < 30), 0) for i in range(60)])
    others = spark.range(1_000, 401_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    alone, among = ({r["doc_id"]: (r["score"], r["kept"]) for r in quality.judge(docs, marks).collect()} for marks in (own, own.union(others)))
    assert alone == among and not any(kept for i, (_, kept) in among.items() if i >= 30)


def test_quality_repeated_ids_are_judged_one_by_one(spark):
    docs = frame(spark, [(1, prose(1, 60), "en", "s", 0, "x"), (1, "short", "en", "s", 0, "x"), (None, prose(2, 60), "en", "s", 0, "x")])
    assert sorted(r["n_words"] for r in quality.judge(docs, labels(spark, [])).collect()) == [1, 60, 60]
    assert quality.keep_good(docs, labels(spark, [])).count() == 2


# --- toxicity --------------------------------------------------------------------


def test_toxicity_grades_rise_and_clean_documents_stay(spark):
    insults = ["grobnak", "vilturd", "scarnip"]
    rows, marks = [], []
    for i in range(120):
        n = i % 4
        words = prose(i, 60).split(" ")
        for k in range(n):
            words[7 * k + 3] = insults[k] + "abc"[i % 3]
        rows.append((i, " ".join(words), "en", "s", 0, "x"))
        marks.append((i, 1, int(n > 0)))
    rows += [(500 + i, t, "en", "s", 0, "x") for i, t in enumerate(awkward())]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, labels(spark, marks[::2] + marks[1::2]))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert len(got) == len(rows) and "score" in docs.columns
    for i in range(120):
        assert got[i]["toxic"] == (i % 4 > 0)
    assert got[3]["severity"] > got[1]["severity"]
    assert not any(got[500 + i]["toxic"] for i in range(len(awkward())))
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == 30 + len(awkward())


def test_toxicity_without_labels_calls_nothing_toxic(spark):
    docs = documents(spark, awkward())
    model = toxicity.fit(docs, labels(spark, []))
    assert toxicity.grade(docs, model).where("toxic").count() == 0
    assert toxicity.grade(docs.limit(0), model).count() == 0


# --- language ---------------------------------------------------------------------

ENDINGS = {"aa": ["ing", "ed", "th"], "bb": ["ção", "nh", "ou"]}


def test_language_held_out_accuracy_and_und(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(200):
        lang = "ab"[i % 2] * 2
        rows.append((i, " ".join("".join(rng.choice(ENDINGS[lang]) for _ in range(3)) for _ in range(30)), lang, "s", 0, "x"))
    rows += [(1000 + i, t, None, "s", 0, "x") for i, t in enumerate([None, "", "12 34 ²", "##"])]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs)).collect()}
    held = [i for i in range(200) if got[i]["held_out"]]
    assert len(held) > 30 and all(got[i]["lang_pred"] == rows[i][2] for i in held)
    assert all(got[1000 + i]["lang_pred"] == "und" and got[1000 + i]["score"] == 0 for i in range(4))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_probabilities_sum_to_one(spark):
    import numpy as np

    p = language.LanguageParams()
    model = language.LanguageModel(["x"], [{"\x02\x02\x02a": 3, "\x02\x02ab": 2, "\x02aba": 1, "\x02\x02a\x03": 1}], p)
    letters = ["a", "b", "\x03", "?"]  # the last stands for all letters never seen
    for h in ("\x02\x02\x02", "\x02\x02a", "zzz"):
        codes = np.array([[ord(c) for c in h + x] for x in letters], dtype=np.uint32)
        assert np.exp(model.log_probs(codes))[:, 0].sum() <= 1.000001


def test_language_model_over_the_driver_bound_keeps_every_gram(spark):
    import random

    rng = random.Random(6)
    ends = {"aa": "ing ed th".split(), "bb": "ção nh ou".split(), "cc": "ющ ый 𐐀я".split()}
    # cc is rare, so a bound over all languages together would drop its grams first
    rows = [(i, " ".join("".join(rng.choice(ends[x]) for _ in range(3)) for _ in range(30)), x, "s", 0, "x") for i, x in enumerate(["aa"] * 90 + ["bb"] * 60 + ["cc"] * 12)]
    docs = frame(spark, rows)
    small, large = language.fit(docs), language.fit(docs, language.LanguageParams(max_grams=20))
    assert small.langs == large.langs == ["aa", "bb", "cc"]
    assert all(len(small.tables[n][0]) == len(large.tables[n][0]) for n in range(1, 5))
    got, want = ({r["doc_id"]: r for r in language.identify(docs, m).collect()} for m in (large, small))
    for i, row in want.items():
        assert (got[i]["lang_pred"], got[i]["rejected"]) == (row["lang_pred"], row["rejected"])
        assert abs(got[i]["cross_entropy"] - row["cross_entropy"]) < 1e-9 and abs(got[i]["score"] - row["score"]) < 1e-9


def test_language_empty_table(spark):
    docs = documents(spark, awkward()).limit(0)
    model = language.fit(docs)
    assert language.identify(docs, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(documents(spark, awkward()), model).collect()} == {"und"}


# --- html ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div><article><header>by line</header><h1>Head &amp; tail</h1><p>First   <b>para</b>graph<br>goes on &eacute;.<p>Second &lt;one&gt;.</p>
<script>var x = "<p>no</p>";</script><ul><li>item one</li></ul><div id="comments"><p>Great post!</p></div></article><aside>side</aside><form><p>mail</p></form><footer>&copy; me</footer></body></html>"""


def test_html_main_text(spark):
    nodes = html.fit_tree(html.labelled_rows(html.LABELLED_PAGES))
    assert html.main_text(PAGE, nodes) == "Head & tail\nFirst paragraph goes on é.\nSecond <one>.\nitem one"
    assert html.main_text("", nodes) == ""
    plain = "<div><a href=x>Home</a> <a href=y>News</a></div>" + "".join(f"<p>{prose(i, 40)}</p>" for i in range(3)) + "<div><a href=z>Terms</a></div>"
    assert html.main_text(plain, nodes).count("\n") == 2


def test_html_word_counts_and_link_density_decide():
    rows = html.labelled_rows(html.LABELLED_PAGES)
    nodes = html.fit_tree(rows)
    right = [got == bool(r[-1]) for got, r in zip(html.classify(nodes, [r[:-1] for r in rows]), rows, strict=True)]
    assert sum(right) >= 0.98 * len(rows)
    used = {html.FEATURES[n[0]] for n in nodes if n[0] >= 0}
    assert {"words", "link_density"} <= used and used & {"prev_words", "prev_density", "next_words", "next_density"}
    # no element or class says what is what here
    page = "<div><p><a>Home</a></p><p><a>About us</a></p></div>" + "".join(f"<p>{prose(i, 30 + 9 * i)}</p>" for i in range(6)) + "<p><a>Terms of use</a></p><p><a>Contact</a></p>"
    text = html.main_text(page, nodes)
    assert text.count("\n") == 5 and "Home" not in text and "Terms" not in text


def direct_text(source):
    """Main text of the generated pages by their fixed layout, read without the operator."""
    import html as lib

    body = re.search(r"<article>(.*?)</article>", source, re.S)
    blocks = re.split(r"</?(?:h1|h2|h3|p|ul|ol|li|div|blockquote|table|tr|td)\b[^>]*>", re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", " ", body.group(1), flags=re.S)) if body else []
    texts = [re.sub(r"\s+", " ", lib.unescape(re.sub(r"<[^>]+>", lambda m: " " if m.group().startswith("<br") else "", b))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="needs the driver's tables")
def test_html_equals_a_direct_reading_of_the_generated_pages():
    import pyarrow.parquet as pq

    nodes = html.fit_tree(html.labelled_rows(html.LABELLED_PAGES))
    for source in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        assert html.main_text(source or "", nodes) == direct_text(source or "")


@pytest.mark.parametrize("source", ["<", "<p", "<p>a</b></p></p>", "<!-- x", "<script>", "</article>", "<article>a" * 50, "<a href='>'>x</a>", "&#x110000; &bogus;"])
def test_html_broken_markup_does_not_crash(source):
    html.main_text(source, html.fit_tree(html.labelled_rows(html.LABELLED_PAGES)))


def test_html_query_shape(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    rows = html.extract(pages).collect()
    assert len(rows) == 3 and rows[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


# --- urls ---------------------------------------------------------------------------

RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]
URLS = {"http://a.example.com/en/1": ("example.com/en/", "block"), "https://WWW.Example.com/en/": ("www.example.com/en/", "allow"), "http://x.net/es": (None, "allow"), "http://x.net/es/?a": ("net/es/", "block"), "http://notexample.com/en/": ("com/", "allow"), "http://com/x": ("com/", "allow"), "http://com": (None, "allow"), "nonsense": (None, "allow"), None: (None, "allow"), "a://b://c.net/fr/": (None, "allow")}


def test_url_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = urls.parse_rules(RULES)
    want = dict(enumerate(URLS.values()))
    got = urls.judge(pages, rules).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == want
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    joined = urls.judge_by_join(pages, table).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in joined} == want
    # rules that are too large to send, and more path lengths than any list would hold
    many = [urls.Rule("block", "long.net", "/" + "x" * n) for n in range(1, 1500)]
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in [*rules, *many]], "verdict string, host string, path string")
    far = spark.createDataFrame([(1, "http://a.long.net/" + "x" * 1400 + "y")], "page_id long, url string")
    assert urls.judge_by_join(far, table).first()["rule"] == "long.net/" + "x" * 1400
    monkeypatch.setattr(urls, "MAX_INDEX_BYTES", 10)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()} == want
    assert urls.judge(pages.limit(0), rules).count() == 0 and urls.judge(pages, []).where("rule is not null").count() == 0


def test_url_collisions_are_told_apart():
    index = urls.DigestArray.build(urls.parse_rules(["allow a.b/x", "block c.d/y"]))
    index.keys[:] = index.keys[0]
    import xxhash

    index.keys[:] = xxhash.xxh64_intdigest("c.d/y")
    assert index.texts[int(index.probe(["c.d/y"])[0])] == "c.d/y"


# --- BPE ----------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [*awkward(), "don't <|endoftext|>Hello\x1cA  B", "Σίσυφος ΣΑΣ", "ﬁ é é x 한국어 🎉🎉 x²½ 123", "\x85\xa0a​b İI"]
    got = {r["doc_id"]: r for r in bpe.digests(documents(spark, texts), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == sha(lib.decode(ids, skip_special_tokens=False))


def test_html_marks_of_the_page_or_the_article_dont_empty_it():
    nodes = html.fit_tree(html.labelled_rows(html.LABELLED_PAGES))
    a, b = " ".join(["alpha"] * 60), " ".join(["beta"] * 60)
    body = f"<p>{a}</p><p>{b}</p>"
    pages = [
        f'<body class="has-sidebar"><article>{body}</article></body>', f'<body class="nav-open"><article>{body}</article></body>', f'<article class="post comments-open">{body}</article>',
        f'<main id="content-banner">{body}</main>', f'<article class="share-price">{body}</article>', f'<div class="no-sidebar"><article>{body}</article></div>', f"<div>{body}</div>", f"<ul><li><a href=x>one</a></li></ul><h1>Title of it</h1>{body}",
    ]
    for page in pages:
        got = html.main_text(page, nodes).split("\n")
        assert got[-2:] == [a, b], page
    assert html.main_text(f'<article>{body}</article><div class="comments"><p>{b}</p></div><div class="site-nav"><p>{b}</p></div>', nodes) == f"{a}\n{b}"
    assert html.main_text(f"<article><p>{a} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <button>Press</button> end</p><p>{b}</p></article>", nodes) == f"{a} x=1 Press end\n{b}"


def test_html_tree_decides_by_more_than_marks():
    """Without marks, word counts and link densities part text from links; the tree is not the rule of marks."""
    nodes = html.fit_tree(html.labelled_rows(html.LABELLED_PAGES))
    used = {html.FEATURES[n[0]] for n in nodes if n[0] >= 0}
    assert used & {"words", "prev_words", "next_words"} and used & {"link_density", "prev_density", "next_density"}
    rows = html.labelled_rows(html.LABELLED_PAGES)
    by_marks = [row[6] == 0 and row[7] == 1 for row in rows]
    assert html.classify(nodes, [r[:-1] for r in rows]) != by_marks
    right = [got == bool(r[-1]) for got, r in zip(html.classify(nodes, [r[:-1] for r in rows]), rows, strict=True)]
    assert sum(right) / len(right) > 0.97
