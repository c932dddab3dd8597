"""Ranked lexical search: every query against all documents, term at a time with a limit on accumulators.

Documents become rows of (id, length, query terms, counts); texts don't move. Each task ranks its own documents in shards:
a query's terms are taken rarest first, and a document gets an accumulator at its first term. Once the bounds of the terms
left add up to less than the k-th best partial score, no further document can reach the first k: no accumulators are
created any more, and the survivors are updated to their exact scores. A task returns its k best documents a query, over
all its shards; a window ranks those.

Queries are taken in blocks of about ``BLOCK_BYTES`` of text, so that what is broadcast is bounded whatever their number.
Null and empty texts have no terms, neither as documents nor as queries; queries without results return no row. Each row is
a document, or a query, of its own, also where ids repeat. Equal scores rank by ascending id, null ids last. Very long texts
are read whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import settle, small_batches

BLOCK_BYTES = 8 << 20
#: Documents whose postings a task holds at a time.
SHARD = 4096

#: ASCII letters and digits and all other bytes of UTF-8 stay, capitals become small, the rest become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and digits and of all other code points beyond ASCII; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 75 + 75 n N div L; in Python's integers where 64 bits are too few."""
    if int(n.max(initial=0)) * 75 * documents < 1 << 62:
        return 25 + 75 * n * documents // total
    return np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)


class Shard:
    """The postings of some documents, by term, each in the order of the documents."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(term, kind="stable")
        self.ids, self.doc = ids, doc[order]
        self.score = impact(tf, m[doc])[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.score, first) if len(first) else first
        self.place = {int(t): i for i, t in enumerate(self.terms)}

    def rank(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of at least ``floor``, all those among the first k included. ``query``: (term, weight), rarest first."""
        found = [(i, w) for t, w in query if w and (i := self.place.get(t)) is not None]
        left = np.cumsum([w * int(self.most[i]) for i, w in reversed(found)])[::-1] if found else []
        acc = np.zeros(len(self.ids), np.int64)
        alive, floor = None, max(floor, 1)
        for (i, w), bound in zip(found, left, strict=True):
            at = slice(self.bounds[i], self.bounds[i + 1])
            doc, score = self.doc[at], self.score[at]
            if alive is None and bound < floor:
                alive = np.flatnonzero(acc)
            if alive is None:
                acc[doc] += w * score
                if np.count_nonzero(acc) >= k:
                    floor = max(floor, int(np.partition(acc, -k)[-k]))
            elif len(alive):
                # each survivor's place in the postings, if it has one
                spot = np.searchsorted(doc, alive)
                spot[spot == len(doc)] = 0
                has = doc[spot] == alive
                acc[alive[has]] += w * score[spot[has]]
        best = np.flatnonzero(acc >= floor)
        return best, acc[best]


def _first(ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, missing, -scores))[:k]


def _ranker(given: Broadcast, k: int, documents: int, total: int, shard: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[list[tuple[int, int]]] = given.value
        if not queries:
            return
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)

        def take(rows: pa.Table) -> None:
            missing = rows["doc_id"].is_null().to_numpy()
            ids = rows["doc_id"].fill_null(0).to_numpy()
            m = length_norm(rows["n"].to_numpy(), documents, total)
            listed = rows["terms"].combine_chunks()
            counts = np.diff(listed.offsets.to_numpy())
            postings = Shard(ids, m, counts, listed.flatten().to_numpy(), rows["tfs"].combine_chunks().flatten().to_numpy())
            for q, query in enumerate(queries):
                i, s, z = best[q]
                docs, scores = postings.rank(query, k, int(z[-1]) if len(z) == k else 0)
                if len(docs):
                    i, s, z = np.append(i, ids[docs]), np.append(s, missing[docs]), np.append(z, scores)
                    top = _first(i, s, z, k)
                    best[q] = i[top], s[top], z[top]

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= shard:
                take(pa.Table.from_batches(held))
                held = []
        if held:
            take(pa.Table.from_batches(held))
        rows = [np.full(len(i), q, np.int32) for q, (i, _, _) in enumerate(best)]
        q, i, s, z = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, *map(list, zip(*best))))
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "doc_id": pa.array(i, pa.int64(), mask=s.astype(bool)), "score": pa.array(z, pa.int64())})

    return rank


def _indexer(given: Broadcast):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = given.value
        for batch in batches:
            sizes, listed, counted = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                held = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                sizes.append(len(words))
                listed.append([t for t, _ in held])
                counted.append([c for _, c in held])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()),
                "terms": pa.array(listed, pa.list_(pa.int32())), "tfs": pa.array(counted, pa.list_(pa.int64())),
            })

    return index


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        ranked = _search_block(docs, [(r["item_id"], Counter(terms(r["text"]))) for r in rows], items.schema["item_id"].dataType.simpleString(), k, shard)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _search_block(docs: DataFrame, items: list[tuple[object, Counter]], id_type: str, k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({t for _, c in items for t in c})
    number = {t: i for i, t in enumerate(words)}
    forward = docs.mapInArrow(_indexer(spark.sparkContext.broadcast(number)), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")
    forward = settle(forward, "forward")
    documents, total = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    # at most a row for each term of the block
    df = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    rarest_first = sorted(df, key=lambda t: (df[t], t))
    place = {t: (i, weight(documents, df[t])) for i, t in enumerate(rarest_first)}
    queries = []
    for _, counts in items:
        held = sorted((place[number[t]][0], number[t], c * place[number[t]][1]) for t, c in counts.items() if number[t] in place)
        queries.append([(t, w) for _, t, w in held])
    ranker = _ranker(spark.sparkContext.broadcast(queries), k, documents, total or 1, shard)
    found = forward.mapInArrow(ranker, "q int, doc_id bigint, score bigint")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"q int, item_id {id_type}")
    return found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
