"""Near-duplicates by consistent weighted sampling.

Documents are weighted sets of word shingles; a shingle's weight is its count
times a damped inverse document frequency. Improved consistent weighted sampling
(Ioffe 2010) gives every document ``hashes`` samples; two documents agree in one
with a probability of their weighted Jaccard similarity. Bands of samples make
buckets; a bucket's documents are compared with its leaders by their short
signatures, and the pairs that look alike are verified on the whole texts.

Texts with the same words are one node from the start, so large groups of copies
cost no pairs. In a bucket each document is paired with one leader first. The links
of all buckets give components; then all members of a bucket that lie in different
components are compared by signature, and those that look alike on whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import join_uneven, settle, small_batches, text_of
from tallyforge.llm.graph import components

WORD = re.compile(r"\w+")
#: Words a task remembers before it starts anew.
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    #: share of the idf in a shingle's weight; small, so that 0.8 keeps about its usual meaning
    idf_share: float = 0.25
    df_buckets: int = 1 << 16
    #: least share of equal samples for a pair to be verified, 4 to 5 deviations below ``similarity``
    estimate: float = 0.62
    #: documents of a bucket that one task compares
    chunk: int = 512

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class Words:
    """64-bit hashes of a text's lower-case words, through a cache."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            words = text.split()  # nothing but symbols
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def weighted_shingles(words: np.ndarray, idf: np.ndarray, params: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights. Fewer words than a shingle has are one shingle."""
    k = min(params.shingle, len(words))
    n = len(words) - k + 1 if k else 0
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    h = np.zeros(n, dtype=np.uint64)
    rare = idf[(words >> np.uint64(64 - int(math.log2(params.df_buckets)))).astype(np.int64)]
    weight = np.zeros(n, dtype=np.float32)
    for i in range(k):
        h = (h ^ words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        weight += rare[i : i + n]
    keys, first, counts = np.unique(h, return_index=True, return_counts=True)
    return keys, (weight[first] / k * counts).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = float(np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64))
    return low / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low)


class Sampler:
    """Improved consistent weighted sampling. The random variables of a shingle and a hash come from one table,
    at a place that both give: r, c ~ Gamma(2, 1), beta ~ Uniform(0, 1)."""

    SIZE = 1 << 17

    def __init__(self, params: NearParams):
        rng = np.random.default_rng(20100101)
        self.r = rng.gamma(2.0, 1.0, self.SIZE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, self.SIZE)).astype(np.float32)
        self.beta = rng.random(self.SIZE).astype(np.float32)
        self.inverse = 1 / self.r
        self.params = params
        self.steps = (np.arange(params.hashes, dtype=np.uint32) * np.uint32(2654435761) + np.uint32(1))[:, None]

    def samples(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit sample for each hash. Some shingles at a time, so that the tables of a step stay in the processor's cache."""
        k, size = self.params.hashes, 256
        best = np.full(k, np.inf, dtype=np.float32)
        out = np.zeros(k, dtype=np.uint64)
        rows = np.arange(k)
        logs = np.log(weights)
        one, two = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32) | np.uint32(1)
        for s in range(0, len(keys), size):
            part = keys[s : s + size]
            place = two[s : s + size] * self.steps
            place += one[s : s + size]
            place >>= np.uint32(15)
            place = place.astype(np.intp)
            # t = floor(log w / r + beta); a = log c - r (t - beta + 1)
            t, a, r = (x.take(place, mode="clip") for x in (self.inverse, self.beta, self.r))
            t *= logs[s : s + size]
            t += a
            np.floor(t, out=t)
            a -= t
            a -= np.float32(1)
            a *= r
            a += self.log_c.take(place, mode="clip")
            low = a.argmin(axis=1)
            value = a[rows, low]
            better = np.flatnonzero(value < best)
            low = low[better]
            best[better] = value[better]
            out[better] = (part[low] ^ (t[better, low].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
        return out ^ (out >> np.uint64(31))

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        p = self.params
        h = np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(p.rows):
            h = (h ^ samples.reshape(p.bands, p.rows)[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def fit_idf(docs: DataFrame, params: NearParams) -> np.ndarray:
    """Damped idf for each of ``df_buckets`` word buckets, from the counts of all documents."""
    shift = np.uint64(64 - int(math.log2(params.df_buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n = Words(), np.zeros(params.df_buckets + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[np.unique((words.hashes(text) >> shift).astype(np.int64))] += 1
                counts[-1] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    found = docs.select(text_of().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(params.df_buckets + 1)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    n = counts[-1]
    rare = np.log((n + 1) / (counts[:-1] + 1)) / max(1.0, math.log(n + 1))
    return (1 - params.idf_share + params.idf_share * 2 * np.clip(rare, 0, 1)).astype(np.float32)


def signatures(docs: DataFrame, idf: np.ndarray, params: NearParams) -> DataFrame:
    """``doc_id, text_key, norm, bands, sig``: the digest of the text's words, band keys, low bytes of the samples."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sampler, own = Words(), Sampler(params), sent.value
        empty = np.zeros(params.hashes, np.uint64)
        for batch in batches:
            norms, bands, sigs = [], [], []
            seen: dict[bytes, int] = {}
            for text in batch.column(2).to_pylist():
                w = words.hashes(text)
                norm = xxhash.xxh3_128_digest(w.tobytes())
                if norm in seen:
                    i = seen[norm]
                    bands.append(bands[i])
                    sigs.append(sigs[i])
                else:
                    keys, weights = weighted_shingles(w, own, params)
                    s = sampler.samples(keys, weights) if len(keys) else empty
                    bands.append(sampler.band_keys(s))
                    sigs.append(s.astype(np.uint8).tobytes())
                    seen[norm] = len(norms)
                norms.append(norm)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * params.bands), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norms, pa.binary()), lists, pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "norm", "bands", "sig"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, norm binary, bands array<long>, sig binary")


def lead(sigs: np.ndarray, least: int) -> np.ndarray:
    """Leader of each row (an earlier row, or itself): the first leader that shares ``least`` samples with it."""
    n = len(sigs)
    leader = np.full(n, -1)
    while (rest := np.flatnonzero(leader < 0)).size:
        first = rest[0]
        like = (sigs[rest] == sigs[first]).sum(axis=1) >= least
        leader[rest[like]] = first
        leader[first] = first
    return leader


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, list]]:
    """Rows of equal (key, chunk) from sorted batches (key, chunk, node, sig and perhaps one more), groups of one left out."""
    now, nodes, sigs, texts = None, [], [], []

    def group() -> tuple:
        return now, np.array(nodes), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(nodes), -1), texts

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        columns.append(batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * batch.num_rows)
        for key, chunk, node, sig, text in zip(*columns, strict=True):
            if (key, chunk) != now:
                if len(nodes) > 1:
                    yield group()
                now, nodes, sigs, texts = (key, chunk), [], [], []
            nodes.append(node)
            sigs.append(sig)
            texts.append(text)
    if len(nodes) > 1:
        yield group()


def _led(rows: DataFrame, params: NearParams) -> DataFrame:
    """``key, node, leader`` for rows (``key, chunk, node, sig``): leaders are found inside each (key, chunk)."""
    least = int(params.estimate * params.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, leaders = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(leaders, pa.int64())], names=["key", "node", "leader"])
            for x in (keys, nodes, leaders):
                x.clear()
            return out

        for (key, _), group, sigs, _ in _groups(batches):
            found = lead(sigs, least)
            keys.extend([key] * len(group))
            nodes.extend(group.tolist())
            leaders.extend(group[found].tolist())
            if len(keys) > 50_000:
                yield flush()
        yield flush()

    spread = rows.select("key", "chunk", "node", "sig").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
    return spread.mapInArrow(run, "key long, node long, leader long")


def key_counts(rows: DataFrame) -> tuple[DataFrame, int]:
    """``key, n`` of the keys that several of ``rows`` share, and the number of those rows."""
    counts = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-counts")
    return counts, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def candidates(buckets: DataFrame, counts: DataFrame, total: int, sigs: DataFrame, params: NearParams) -> DataFrame:
    """``key, node, leader`` with ``node <> leader``. Buckets over ``chunk`` documents are cut into chunks; the
    chunks' leaders meet again, level by level. Where that no longer shrinks a bucket, all pairs of its chunks are
    compared, block by block, so that no bucket is cut short. Rows of hot keys stay where they are until they are dealt out."""
    found, rows, size = None, buckets, None
    while True:
        # rows of buckets that need more than one chunk
        large = counts.where(F.col("n") > params.chunk).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sized = join_uneven(rows, counts, "key", "n", total).withColumn("chunks", F.ceil(F.col("n") / params.chunk))
        deal = F.pmod(F.xxhash64("node", "key"), F.col("chunks"))
        if size is not None and not large:
            deal_rows = sized.withColumn("chunk", F.lit(0).cast("long"))
        elif size is not None and large > 0.5 * size:
            # blocks of two chunks each
            part = F.col("chunks") * 2
            own = sized.withColumn("own", F.pmod(F.xxhash64("node", "key"), part))
            other = F.explode(F.sequence(F.lit(0).cast("long"), part - 1))
            pairs = own.select("key", "node", "own", part.alias("part"), other.alias("other"))
            deal_rows = pairs.withColumn("chunk", F.least("own", "other") * F.col("part") + F.greatest("own", "other"))
            led = settle(_led(deal_rows.join(sigs, "node"), params), "near-blocks").where("node <> leader").distinct()
            return led if found is None else found.unionByName(led)
        else:
            deal_rows = sized.withColumn("chunk", deal)
        led = settle(_led(deal_rows.select("key", "chunk", "node").join(sigs, "node"), params), "near-led")
        links = led.where("node <> leader")
        found = links if found is None else found.unionByName(links)
        if not large:
            return found
        size = large
        multi = counts.where(F.col("n") > params.chunk)
        leaders = join_uneven(led.where("node = leader").select("key", "node").distinct(), multi, "key", "n", total)
        rows = settle(leaders.select("key", "node"), "near-leaders")
        counts, total = key_counts(rows)


def node_texts(used: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the nodes in ``used``. ``nodes``: ``node, doc_id, text_key``."""
    wanted = settle(nodes.join(used.distinct(), "node").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "near-wanted")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_of().alias("text"))
    # both sides grow with the input, so neither is broadcast however small it is now
    wanted = wanted.hint("merge")
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["text_key"] == wanted["_key"])).select("node", "text").dropDuplicates(["node"])
    return settle(texts, "near-texts")


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, params: NearParams) -> DataFrame:
    """``node, leader, like`` for pairs of nodes, from their whole texts."""
    rows = pairs.hint("merge").join(texts, "node").hint("merge").join(texts.select(F.col("node").alias("leader"), F.col("text").alias("other")), "leader")
    sent = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), sent.value
        last: tuple[int, tuple] | None = None
        for batch in batches:
            like = []
            for leader, text, other in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if last is None or last[0] != leader:
                    last = (leader, weighted_shingles(words.hashes(other), own, params))
                like.append(weighted_jaccard(weighted_shingles(words.hashes(text), own, params), last[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], names=["node", "leader", "like"])

    return rows.select("node", "leader", "text", "other").mapInArrow(run, "node long, leader long, like double")


def _blocks(members: DataFrame, total: int, params: NearParams) -> DataFrame:
    """``key, band, chunk, node, label`` for bucket members (``key, band, node, label``) of buckets with two labels or more: any two
    members of a bucket with different labels share a chunk at least once.

    Small buckets are one chunk. Larger ones are dealt out as blocks of two parts each; parts of the bucket's most
    frequent label do not meet each other, so a large class costs little more than one reading. ``total``: rows of all buckets.
    """
    half = max(1, params.chunk // 2)
    counts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    sized = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    sized = sized.select("key", "n", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.c")) / half).alias("few"), F.ceil(F.col("top.c") / half).alias("many"))
    rows = join_uneven(members, settle(sized, "near-sized"), "key", "n", total).withColumn("parts", F.col("few") + F.col("many"))
    draw, common, whole = F.xxhash64("node", "key"), F.col("label") == F.col("top"), F.col("n") <= params.chunk
    own = F.when(whole, F.lit(0)).when(common, F.col("few") + F.pmod(draw, F.col("many"))).otherwise(F.pmod(draw, F.col("few"))).cast("long")
    last = F.when(whole, F.lit(0)).when(common, F.col("few") - 1).otherwise(F.col("parts") - 1).cast("long")
    rows = rows.select("key", "band", "node", "label", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    return rows.select("key", "band", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("chunk"), "node", "label")


def _across(sig: np.ndarray, labels: np.ndarray, band: int, params: NearParams) -> Iterator[tuple[int, np.ndarray]]:
    """Rows and the other rows of different labels that look like them, each pair once, and only in the first band that both share."""
    least = int(params.estimate * params.hashes)
    _, group, size = np.unique(labels, return_inverse=True, return_counts=True)
    # the most frequent label first: its rows are never compared with each other
    order = np.lexsort((group, -size[group]))
    sig, labels = sig[order], labels[order]
    ends = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True]).tolist()
    for a, b in zip(ends[1:-1], ends[2:], strict=True):
        for i in range(a, b):
            like = np.flatnonzero((sig[:a] == sig[i]).sum(axis=1) >= least)
            if band and len(like):
                before = (sig[like, : band * params.rows] == sig[i, : band * params.rows]).reshape(len(like), band, params.rows)
                like = like[~before.all(axis=2).any(axis=1)]
            if len(like):
                yield int(order[i]), order[like]


def look_alikes(members: DataFrame, total: int, sigs: DataFrame, params: NearParams) -> DataFrame:
    """``key, band, node`` of the bucket members (``key, band, node, label``) that look like one of another label. A pair that
    meets in several bands counts in the first; a member comes out once, however many it looks like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), nodes, sig, own in _groups(batches):
            band, alike = own[0]["band"], np.zeros(len(nodes), bool)
            for i, like in _across(sig, np.array([x["label"] for x in own]), band, params):
                alike[i] = True
                alike[like] = True
            n = int(alike.sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([band] * n, pa.int32()), pa.array(nodes[alike])], names=["key", "band", "node"])

    rows = _blocks(members, total, params).join(sigs, "node").select("key", "chunk", "node", "sig", F.struct("label", "band").alias("own"))
    spread = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
    return spread.mapInArrow(run, "key long, band int, node long").distinct()


def link_across(members: DataFrame, total: int, sigs: DataFrame, texts: DataFrame, idf: np.ndarray, params: NearParams) -> DataFrame:
    """``u, v``: links between labels of the bucket members (``key, band, node, label``).

    Members of a block are compared on whole texts where their signatures look alike and their labels are not yet
    linked in the block; only links that join two labels come out.
    """
    rows = _blocks(members, total, params).join(sigs, "node").hint("merge").join(texts, "node")
    rows = rows.select("key", "chunk", "node", "sig", F.struct("label", "band", "text").alias("own"))
    sent = members.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own_idf = Words(), sent.value
        sets: dict[int, tuple] = {}
        for _, nodes, sig, own in _groups(batches):
            if len(sets) > 5_000:
                sets.clear()
            labels = np.array([x["label"] for x in own])
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            def of(i: int, nodes: np.ndarray = nodes, own: list = own) -> tuple:
                k = int(nodes[i])
                if k not in sets:
                    sets[k] = weighted_shingles(words.hashes(own[i]["text"]), own_idf, params)
                return sets[k]

            found = []
            for i, like in _across(sig, labels, own[0]["band"], params):
                for j in like.tolist():
                    u, v = root(int(labels[i])), root(int(labels[j]))
                    if u != v and weighted_jaccard(of(i), of(j)) >= params.similarity:
                        parent[max(u, v)] = min(u, v)
                        found.append((max(u, v), min(u, v)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    spread = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
    return spread.mapInArrow(run, "u long, v long").distinct()


def classes(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, text_key, class_id, class_size, kept``.

    Two texts are linked if the weighted Jaccard similarity of their shingles is ``similarity`` or more; classes are
    the connected components. ``class_id`` is the least doc_id of the class, ``kept`` marks one row of each class, that
    of the least doc_id. Texts with the same words (any case and punctuation) are alike, and so are null and empty
    texts. Texts of any length are sampled whole. Of equal doc_ids the row that is read first is kept. Repeated rows are
    members of one class; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    idf = fit_idf(docs, params)
    rows = settle(signatures(docs, idf, params).withColumn("uid", F.monotonically_increasing_id()), "near-signatures")
    firsts = rows.groupBy("norm").agg(F.min(F.struct("uid", "doc_id", "text_key")).alias("f"), F.count(F.lit(1)).alias("copies"))
    nodes = settle(firsts.select("norm", "copies", F.col("f.uid").alias("node"), F.col("f.doc_id").alias("doc_id"), F.col("f.text_key").alias("text_key")), "near-nodes")
    total = rows.count()
    keyed = rows.join(nodes.select(F.col("node").alias("uid")), "uid")
    sigs = settle(keyed.select(F.col("uid").alias("node"), "sig", "bands"), "near-node-signatures")
    buckets = sigs.select("node", F.posexplode("bands").alias("band", "key"))
    sigs = sigs.select("node", "sig")
    counts, in_buckets = key_counts(buckets)
    led = settle(candidates(buckets.select("node", "key"), counts, in_buckets, sigs, params), "near-candidates")
    pairs = settle(led.select("node", "leader").distinct(), "near-pairs")
    # a bucket without a pair has no two documents that look alike
    alike = settle(counts.join(led.select("key").distinct(), "key"), "near-keys")
    members = settle(join_uneven(buckets, alike, "key", "n", in_buckets).select("key", "band", "node"), "near-members-of-buckets")
    texts = node_texts(members.select("node"), nodes, docs)
    like = settle(verify(pairs, texts, idf, params), "near-verified")
    links = like.where(F.col("like") >= params.similarity).select("node", "leader")
    labels = settle(components(links.select(F.col("node").alias("u"), F.col("leader").alias("v"))), "near-labels")
    # what looks alike in a bucket and is not in one class yet is compared too, leaders and linked documents as well
    members = settle(members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label")), "near-labelled-members")
    alike = settle(look_alikes(members, in_buckets, sigs, params), "near-look-alikes")
    if not alike.isEmpty():
        alike = alike.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
        across = components(settle(link_across(alike, in_buckets, sigs, texts, idf, params), "near-links-across"))
        across = across.select(F.col("node").alias("label"), F.col("label").alias("_joined"))
        own = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        labels = own.join(across, "label", "left").select("node", F.coalesce("_joined", "label").alias("label"))
    labelled = settle(nodes.select("norm", "copies", "node").join(labels, "node", "left").select("norm", "copies", F.coalesce("label", "node").alias("label")), "near-labelled")
    members = settle(join_uneven(rows.select("uid", "doc_id", "text_key", "norm"), labelled, "norm", "copies", total).drop("norm", "copies"), "near-members")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("uid"))
    heads = settle(members.groupBy("label").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("class_size")), "near-heads")
    out = join_uneven(members, heads, "label", "class_size", total)
    return out.select("doc_id", "text_key", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("head.uid")).alias("kept"))


def keep_one(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One row of each class of ``docs``, all columns."""
    found = settle(classes(docs, params), "near-classes")
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_key"]), "left_semi")
    # rows that repeat both id and text can't be told apart by the join
    if found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])
