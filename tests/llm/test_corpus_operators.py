"""Operators on whole corpora: packing, fingerprints, near-duplicates, repeated passages, the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import awkward, documents, frame, prose
from pyspark.sql import functions as F

from tallyforge.llm import fingerprint, graph, neardup, packing, substrings

# --- packing ------------------------------------------------------------------------


def test_packing_places_every_piece_once(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = [*awkward(), *[prose(i, 20 + 7 * i) for i in range(60)], "日本語 <|endoftext|> x", "tab\there  two"]
    rows = packing.pack(packing.pieces_of(documents(spark, texts), path)).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() == len(ids) and mine.length.max() <= 1024
        assert (mine.length.iloc[1:] == 1024).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist() and seq.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 2


def test_packing_in_blocks_and_with_repeats(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 900).tolist()
    pieces = spark.createDataFrame([(None if i % 3 == 0 else 1, 0, 0, int(s), 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(pieces, packing.PackingParams(block_pieces=100)).toPandas()
    assert len(out) == 900 and sorted(out.length) == sorted(sizes)
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    assert out.sequence_id.nunique() <= 1.06 * sum(sizes) / 1024 + 2
    assert packing.pack(pieces.limit(0)).count() == 0


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 700, 200).tolist()
    order = sorted(range(200), key=lambda i: -sizes[i])
    a, b = packing.fill(order, sizes, 1024), packing.fill(rng.permutation(200).tolist(), sizes, 1024)
    child = packing.crossover(a, b, sizes, 1024, rng)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 1024 for x in child)


def test_search_needs_fewer_bins_than_best_fit():
    rng, sizes = np.random.default_rng(5), []
    for _ in range(200):  # three pieces fill a bin; best fit alone can't find out which
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1024 - a) // 2))
        sizes += [a, b, 1024 - a - b]
    sizes.sort(reverse=True)
    start = packing.fill(list(range(600)), sizes, 1024)
    best = packing.evolve(sizes, [], 7, packing.PackingParams(generations=20))[0]
    assert sorted(i for x in best for i in x) == list(range(600)) and all(sum(sizes[i] for i in x) <= 1024 for x in best)
    assert len(start) > 220 and len(best) <= len(start) - 12


def test_both_encoders_agree_on_latin_texts():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = packing.IdEncoder(f.read())
    assert encoder.fast is not None
    rng = np.random.default_rng(6)
    letters = [*"aAbeEzßéÑÿ ŁŒƀɏ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "'s", "'LL", "'re", "0", "12", "²", "½", "ª", ".", ",,", "!?", "$", "<|", "|>", "\x00", "\xad", "the", "ing", "http://", "a" * 90, " " * 40]
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(1, 60)).tolist())
        assert encoder.fast.encode_ordinary(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


# --- fingerprints ---------------------------------------------------------------------


def test_fingerprint_edits_and_neighbours(spark):
    texts = [*awkward(), *[prose(i, 100) for i in range(20)]]
    rows = {r["doc_id"]: r for r in fingerprint.compare(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] and rows[4]["near_next"] == 1.0
    assert all(rows[i]["near_edited"] > 0.4 and rows[i]["near_next"] < 0.4 for i in range(10, 29))


def test_fingerprint_is_a_multiset_hash(spark):
    one, two = "a b c\nd e f\na b c", "a b c\na b c\nd e f"
    texts = documents(spark, [one, two, "a b c\nd e f", "a b c"]).select("doc_id", "text")
    v = {r["doc_id"]: r["vector"] for r in fingerprint.vectors(texts, ["doc_id"]).collect()}
    assert v[0] == v[1] and v[0] != v[2]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert [wrap(a + b) for a, b in zip(v[2]["exact"], v[3]["exact"], strict=True)] == v[0]["exact"]
    assert [a + b for a, b in zip(v[2]["packed"], v[3]["packed"], strict=True)] == v[0]["packed"]


def test_fingerprint_odd_ids(spark):
    rows = [(None, "x y", "en", "s", 0, "x"), (5, "a b", "en", "s", 0, "x"), (5, "c d", "en", "s", 0, "x")]
    assert fingerprint.compare(frame(spark, rows)).count() == 3
    assert fingerprint.compare(frame(spark, rows[:1])).first()["near_next"] == 1.0
    assert fingerprint.compare(frame(spark, rows).limit(0)).count() == 0


# --- near-duplicates ---------------------------------------------------------------------


def brute_classes(texts, params, idf):
    words = neardup.Words()
    sets = [neardup.weighted_shingles(words.hashes(t or ""), idf, params) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if neardup.weighted_jaccard(sets[i], sets[j]) >= params.similarity:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark):
    texts = list(awkward())
    for seed in range(40, 52):
        words = prose(seed, 120).split(" ")
        texts.append(" ".join(words))
        for k in range(seed % 4):  # near copies: one or two words changed
            near = list(words)
            near[10 + 20 * k] = f"changed{k}"
            texts.append(" ".join(near))
        texts.append(" ".join(words[:60] + prose(seed + 500, 60).split(" ")))  # shares half
    docs = documents(spark, texts)
    params = neardup.NearParams(chunk=4)
    got = {r["doc_id"]: r for r in neardup.classes(docs, params).collect()}
    want = brute_classes(texts, params, neardup.fit_idf(docs, params))
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert sum(r["kept"] for r in got.values()) == len(set(want))
    kept = neardup.keep_one(docs, params)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want)


@pytest.mark.parametrize("chunk", [512, 64])
def test_near_duplicates_of_drifting_families_match_brute_force(spark, chunk):
    texts = []
    for family in range(2):
        base = prose(700 + family, 400).split()
        for step in range(3):
            # copies with endings of their own are like the text without one, not like each other
            texts += [" ".join(base + prose(1000 * family + 100 * step + k, 40).split()) for k in range(50)]
            texts.append(" ".join(base))
            base = [*base]
            base[100 * step : 100 * step + 20] = prose(900 + 10 * family + step, 20).split()
    docs = documents(spark, texts)
    params = neardup.NearParams(chunk=chunk)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, params).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, params, neardup.fit_idf(docs, params))


def test_near_duplicates_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "same text here and there", "en", "s", 0, "x")] * 3 + [(None, "SAME text, here and there", "en", "s", 0, "x")]
    docs = frame(spark, rows)
    assert neardup.keep_one(docs).count() == 1
    assert neardup.classes(docs.limit(0)).count() == 0


def test_sampling_agrees_as_often_as_sets_are_alike():
    params = neardup.NearParams(bands=200)
    sampler, rng = neardup.Sampler(params), np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = keys[:300], keys[60:]
    w = np.ones(400, dtype=np.float32)
    same = (sampler.samples(a, w[:300]) == sampler.samples(b, w[60:])).mean()
    assert abs(same - 240 / 400) < 0.06


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 3)], "u long, v long")
    assert {r["node"]: r["label"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 4: 4, 5: 4}
    assert graph.components(edges.limit(0)).count() == 0


# --- repeated passages ---------------------------------------------------------------------


def brute_cut(rows, window=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, b in raw:
        if i is not None:
            for s in range(len(b) - window + 1):
                w = b[s : s + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - window + 1):
                if first[b[s : s + window]] < i:
                    gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), kept))
    return sorted(out, key=str)


#: everything cut small: several blocks, slices of texts, partitions, flushes and indexes
SMALL = {"flush_rows": 200, "block_bytes": 2000, "chunk_bytes": 300, "part_keys": 300, "part_rows": 200, "index_rows": 50}


def cut_rows(docs, **params):
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.cut(docs, substrings.RepeatParams(**params)).collect()], key=str)


@pytest.mark.parametrize("repeat_ids", [False, True])
@pytest.mark.parametrize("params", [{}, SMALL, {**SMALL, "hot_rows": 20}])
def test_repeats_match_brute_force(spark, repeat_ids, params):
    shared, other = prose(900, 30), prose(901, 20)
    phrase = "Reprinted under the terms of the open licence, all rights kept."
    texts = list(awkward()) + [prose(i, 20) + shared + prose(i + 50, 10) for i in range(8)] + [shared[i:] + other[: 60 + i] for i in range(6)] + ["ab" * 100, "ab" * 60, "ü" * 80, "x" + "ü" * 40, other + shared, "a" * 50, "a" * 49]
    texts += [prose(i, 8) + " " + phrase[: 63 - i % 9] + " " + prose(i + 300, 8) for i in range(60)] + [phrase * 3, prose(3, 30), prose(3, 25)]
    ids = [i // 2 if repeat_ids else i for i in range(len(texts))]
    rows = [(i, t, "en", "s", 0, "x") for i, t in zip(ids, texts, strict=True)] + [(None, shared, "en", "s", 0, "x")]
    docs = frame(spark, rows).repartition(3)
    assert cut_rows(docs, **params) == brute_cut([(r[0], r[1]) for r in rows])


def test_repeats_keep_other_columns_and_take_empty_tables(spark):
    docs = documents(spark, [prose(1, 40), None, prose(1, 40)]).withColumn("kept", F.lit(1)).withColumn("tags", F.array(F.lit("a")))
    out = substrings.cut(docs)
    assert out.columns == [*[c for c in docs.columns if c != "kept"], "n_bytes", "n_removed", "n_spans", "kept", "kept_text"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["kept_text"] == rows[0]["text"] == rows[2]["text"] and rows[2]["kept_text"] == "" and rows[1]["text"] is None and rows[2]["tags"] == ["a"]
    assert substrings.cut(docs.limit(0)).count() == 0


def test_repeats_of_a_very_long_text(spark):
    text = prose(8, 60_000)
    docs = documents(spark, [text[300_000:300_200], text, "x" + text])
    rows = {r[0]: r for r in cut_rows(docs)}
    assert [rows[i][2] for i in range(3)] == [0, 200, len(text)]


def test_repeats_deal_a_common_phrase_out_evenly():
    # under 50 bytes: no window lies inside the phrase, so each document has contexts of its own
    texts = [(prose(i, 4) + " licensed for personal and educational use " + prose(i + 5000, 4)).encode() for i in range(2000)]
    params = substrings.RepeatParams()
    keys, n = np.unique(substrings.contexts(texts, params).key, return_counts=True)
    dealt = substrings.contexts(texts, params, keys, keys[n >= 500])
    assert not np.isin(dealt.key, keys[n >= 500]).any()
    loads = np.bincount((dealt.key[~np.isin(dealt.key, keys)] >> np.uint64(42)).astype(int), minlength=64)
    assert loads.sum() > 20_000 and loads.max() < 1.5 * loads.mean()


def test_run_index_is_shorter_than_its_text_and_right():
    rng = np.random.default_rng(4)
    base = [bytes(rng.choice(list(b"ab c"), rng.integers(50, 76)).tolist()) for _ in range(6)]
    found = set()
    for _ in range(300):
        text = bytearray(base[rng.integers(6)])
        text[rng.integers(len(text))] = ord("d")
        found.add(bytes(text[rng.integers(3) :]))
    texts = sorted(t for t in found if len(t) >= 50)
    docs = rng.integers(0, 40, len(texts))
    first: dict[bytes, int] = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for o in range(len(t) - 49):
            first[t[o : o + 50]] = min(first.get(t[o : o + 50], 99), d)
    index = substrings.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), docs, 50)
    got = {(c, o): d for c, o, d in zip(*(x.tolist() for x in index.matches()), strict=True)}
    assert got == {(i, o): first[t[o : o + 50]] for i, t in enumerate(texts) for o in range(len(t) - 49)}
    assert len(index.heads) < len(index.text) / 3
    # what decides is in the runs: other symbols or samples give other matches
    index.least = index.least + 1
    assert all(d > got[c, o] for c, o, d in zip(*(x.tolist() for x in index.matches()), strict=True))


def test_contexts_alone_with_their_minimizer_are_not_indexed(monkeypatch):
    """Copies hold the same contexts; only those around a difference meet others and need the index."""
    indexed = []
    build = substrings.RunIndex.__init__
    monkeypatch.setattr(substrings.RunIndex, "__init__", lambda self, blob, lengths, *rest: (indexed.append(len(lengths)), build(self, blob, lengths, *rest))[1])
    whole, p = prose(31, 2000), substrings.RepeatParams()
    changed = whole.replace(whole[6000:6010], "#" * 10)

    def removed(*texts: str) -> int:
        docs = pa.RecordBatch.from_pydict({"_doc": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
        block = [pa.array([0], pa.int64()), pa.array([substrings._batch_bytes(docs)], pa.binary())]
        keys = substrings._send_keys(iter([pa.RecordBatch.from_arrays(block, names=["block", "docs"])]), 1, p)
        marks = [{"n": r["n"], "data": r["data"]} for b in substrings._mark(keys, p) for r in b.to_pylist()]
        # one task a document, so that no task joins equal contexts before they are sent
        sent = []
        for i in range(len(texts)):
            one = pa.RecordBatch.from_arrays([pa.array([i]), pa.array([substrings._batch_bytes(docs.slice(i, 1))], pa.binary()), pa.array([marks])], names=["block", "docs", "marks"])
            sent += substrings._send(iter([one]), 1, p)
        spans = [substrings._spread(r["data"], r["n"], *substrings._SPAN) for b in substrings._match(iter(sent), p) for r in b.to_pylist()]
        return sum(int((stop - start).sum()) for row, start, stop in spans)

    assert removed(whole, whole) == len(whole) and not indexed
    assert removed(whole, changed) == len(whole) - 10 and 0 < sum(indexed) < 20


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    texts = [prose(i, 90) for i in range(40)]
    texts += [texts[0], texts[1].replace("river", "ocean", 1), "short", None, " | ".join(prose(77, 90).upper().split()), prose(600, 60) + texts[2][:300]]
    documents(spark, texts, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, 0) for i in range(30)] + [(44, 0, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 40 not in left and 42 not in left and 43 not in left and set(range(40)) <= set(left)
    assert texts[2][:300] not in left[45] and left[45].startswith(texts[45][:40])
    packed = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_minimizers_with_very_many_contexts_are_hot():
    """One phrase in 20,000 surroundings: its minimizers are counted one by one, also within one block."""
    rng = random.Random(8)
    phrase = "the parties named above hereby agree to all of it"
    texts = [" ".join(f"{rng.randbytes(14).hex()} {phrase} {rng.randbytes(14).hex()}" for _ in range(5000)) for _ in range(4)]
    docs = pa.RecordBatch.from_pydict({"_doc": pa.array(range(4), pa.int64()), "text": pa.array(texts)})
    p = substrings.RepeatParams()
    key, n, several = substrings._distinct_keys(docs, p)
    assert n.max() > 10_000 and several[n.argmax()]
    blocks = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([substrings._batch_bytes(docs)], pa.binary())], names=["block", "docs"])
    marks = [r for b in substrings._mark(substrings._send_keys(iter([blocks]), 1, p), p) for r in b.to_pylist()]
    assert sum(r["hot"] for r in marks) >= int(n.max()) and int(n.max()) >= p.hot_rows
