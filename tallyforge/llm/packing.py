"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Pieces that fill a sequence stand alone. The others are dealt into blocks of
bounded size; each block is packed by several islands, each a population of
packings. A crossover injects well-filled bins of one parent whole into the
other, drops the bins that now hold duplicates, and best-fits the displaced
pieces, first in the place of smaller ones. After each epoch the islands of a block pass their elites on in a ring.
Bins that a block leaves open are dealt anew into fewer blocks, round by round.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import byte_letters
from tallyforge.llm.common import settle, small_batches, text_of


@dataclass(frozen=True)
class PackingParams:
    capacity: int = 1024
    end_id: int = 2
    #: pieces a block holds on average
    block_pieces: int = 4096
    islands: int = 2
    population: int = 4
    epochs: int = 2
    generations: int = 6
    #: a bin filled less than this share is opened again in the next round
    closed: float = 0.995


class IdEncoder:
    """Ids of a text as the vocabulary file's own library gives them, as little-endian bytes.

    Texts of Latin letters without special tokens go through the faster of two libraries, fed with the same
    vocabulary and pattern, if the file's ids are in the order of its merges; on those both give the same ids.
    Other texts go through the first.
    """

    # Fixed value: the pattern of byte-level vocabularies.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LATIN_END = "\u0250"

    def __init__(self, source: str):
        import tiktoken
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(source)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = {c: b for b, c in byte_letters().items()}
        model = json.loads(source)["model"]
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.fast = None
        # the faster library takes ids for ranks, so they have to be in the order of merges, after the letters
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)) and max(vocab[c] for c in letters) < min(merged, default=len(vocab)):
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast and max(text) < self.LATIN_END and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter than a sequence."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces_of(docs: DataFrame, vocabulary: str, params: PackingParams = PackingParams()) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document; a null or empty text is the end id alone.

    A text of any length is encoded whole and cut into pieces. Rows that repeat a doc_id, or have none, are cut one by
    one; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = IdEncoder(sent.value)
        end = np.array([params.end_id], dtype="<u4").tobytes()
        for batch in batches:
            at, number, starts, lengths, crcs = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text) + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, params.capacity)):
                    at.append(i)
                    number.append(k)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Bins by free room; the fullest bin that still takes a piece is found by one bit operation."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.bins: list[list[int]] = []

    def add(self, items: list[int], used: int) -> None:
        self.bins.append(items)
        self._open(len(self.bins) - 1, self.capacity - used)

    def _open(self, at: int, room: int) -> None:
        if room:
            self.by_room[room].append(at)
            self.mask |= 1 << room

    def best_fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add([item], size)
            return
        room = size + (fits & -fits).bit_length() - 1
        bins = self.by_room[room]
        at = bins.pop()
        if not bins:
            self.mask &= ~(1 << room)
        self.bins[at].append(item)
        self._open(at, room - size)


def fill(order: list[int], sizes: list[int], capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    bins = OpenBins(capacity)
    for b in kept:
        bins.add(list(b), sum(sizes[i] for i in b))
    for i in order:
        bins.best_fit(i, sizes[i])
    return bins.bins


def fitness(packing: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the sum of squared fills."""
    return -len(packing), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in packing)


def replace(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Swap a loose piece for a smaller one of a bin wherever that fills the bin better; the pieces that are loose then."""
    waiting = sorted((sizes[i], i) for i in loose)
    spare = [(b, room) for b in bins if (room := capacity - sum([sizes[i] for i in b]))]
    while spare:
        left = []
        for b, room in spare:
            before, k = room, 0
            while room and k < len(b):
                size = sizes[b[k]]
                at = bisect_right(waiting, (size + room, len(sizes))) - 1
                if at >= 0 and waiting[at][0] > size:
                    grown, i = waiting.pop(at)
                    insort(waiting, (size, b[k]))
                    b[k], room = i, room - (grown - size)
                else:
                    k += 1
            left.append((b, room, room < before))
        if not any(moved for _, _, moved in left):
            break
        spare = [(b, room) for b, room, _ in left if room]
    return [i for _, i in waiting]


def insert(kept: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Displaced pieces go back: swapped into bins that they fill better, then the largest first where they fit best."""
    kept = [list(b) for b in kept]
    loose = replace(kept, loose, sizes, capacity)
    loose.sort(key=lambda i: (-sizes[i], i))
    return fill(loose, sizes, capacity, kept)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject some of ``a``'s well-filled bins into ``b``; bins of ``b`` with duplicates go, and its least filled ones; their other pieces go back in."""
    used = [sum([sizes[i] for i in x]) for x in a]
    well = float(np.median(used))
    filled = [x for x, n in zip(a, used, strict=True) if n >= well]
    first, last = sorted(rng.integers(0, len(filled) + 1, 2).tolist())
    inject = filled[first:last]
    taken = {i for x in inject for i in x}
    own = [sum([sizes[i] for i in x]) for x in b]
    low = sorted(own)[len(own) // 20] if len(own) > 20 else min(own)
    kept, loose = [], []
    for x, n in zip(b, own, strict=True):
        if n <= low < capacity or any(i in taken for i in x):
            loose += [i for i in x if i not in taken]
        else:
            kept.append(x)
    return insert([*inject, *kept], loose, sizes, capacity)


def mutate(packing: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Take out the least filled bin and some others, mostly badly filled ones; their pieces go back in."""
    used = np.array([sum([sizes[i] for i in x]) for x in packing])
    chance = 0.02 + 0.5 * (used < capacity) * rng.random()
    out = rng.random(len(packing)) < chance
    out[int(used.argmin())] = True
    kept = [x for x, gone in zip(packing, out.tolist(), strict=True) if not gone]
    loose = [i for x, gone in zip(packing, out.tolist(), strict=True) if gone for i in x]
    return insert(kept, loose, sizes, capacity)


def evolve(sizes: list[int], elites: list[list[list[int]]], seed: int, params: PackingParams) -> list[list[list[int]]]:
    """One island's epoch; the best two packings. It ends early where a packing needs no more bins than the sum of sizes does."""
    rng, cap = np.random.default_rng(seed), params.capacity
    low = -(-sum(sizes) // cap)
    rate = lambda p: fitness(p, sizes, cap)
    population = list(elites)
    if not population:
        population.append(fill(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, cap))
    while len(population) < params.population and len(population[0]) > low:
        # random orders, from nearly sorted by size to not sorted at all
        noise = rng.normal(0, cap * rng.random(), len(sizes))
        population.append(fill(sorted(range(len(sizes)), key=lambda i: (-sizes[i] - noise[i], i)), sizes, cap))
    population = sorted(((rate(p), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for born in range(params.generations):
        if -population[0][0][0] <= low or len(population) < 2:  # no packing needs fewer sequences
            break
        i, j = rng.choice(len(population), 2, replace=False).tolist()
        child = crossover(population[i][2], population[j][2], sizes, cap, rng)
        if rng.random() < 0.7:
            child = mutate(child, sizes, cap, rng)
        population.append((rate(child), params.population + born, child))
        population = sorted(population, key=lambda x: (x[0], -x[1]), reverse=True)[: params.population]
    return [p for _, _, p in population[:2]]


def _genome(packing: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(packing):
        out[b] = k
    return out


def _bins(genome: np.ndarray) -> list[list[int]]:
    order = np.argsort(genome, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(genome[order])) + 1)]


def _pack_round(pieces: DataFrame, blocks: int, number: int, params: PackingParams) -> DataFrame:
    """``uid, block, bin, used`` of each piece (``uid, length``)."""
    dealt = pieces.select(F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(blocks)).alias("block"), "uid", "length")
    dealt = settle(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("pieces")), "packing-blocks")
    rows = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(params.islands - 1))).alias("island"), F.col("pieces.length").alias("sizes"))
    elites = None
    for epoch in range(params.epochs):

        def island(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    sizes = [int(x) for x in row.sizes]
                    old = [_bins(np.frombuffer(g, np.int32)) for g in row.elites] if epoch else []
                    best = evolve(sizes, old, hash((int(row.block), int(row.island), epoch, number)) & 0xFFFFFFFF, params)
                    yield pd.DataFrame({"block": [row.block], "island": [row.island], "elites": [[_genome(p, len(sizes)).tobytes() for p in best]]})

        start = rows if elites is None else rows.join(elites, ["block", "island"])
        # a block is a row, so a task may take any number of them
        spread = start.repartition(max(1, min(blocks * params.islands, 10_000)), "block", "island")
        found = settle(spread.mapInPandas(island, "block long, island int, elites array<binary>"), "packing-epoch")
        # in a ring: the best of island k also goes to island k + 1
        moved = found.select("block", ((F.col("island") + 1) % params.islands).alias("island"), F.slice("elites", 1, 1).alias("elites"))
        elites = found.unionByName(moved).groupBy("block", "island").agg(F.flatten(F.sort_array(F.collect_list("elites"))).alias("elites"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes = np.array([p["length"] for p in row.pieces], dtype=np.int64)
                uids = np.array([p["uid"] for p in row.pieces], dtype=np.int64)
                options = [np.frombuffer(g, np.int32) for g in row.genomes]
                rate = lambda g: (g.max(), -(np.bincount(g, sizes) ** 2).sum(), g.tobytes())
                best = min(options, key=rate)
                used = np.bincount(best, sizes).astype(np.int64)
                order = np.lexsort((uids, -sizes, best))
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.r_[True, np.diff(best[order]) > 0]
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                yield pd.DataFrame({"uid": uids[order], "block": row.block, "bin": best[order], "used": used[best[order]], "offset": offset})

    genomes = elites.groupBy("block").agg(F.flatten(F.collect_list("elites")).alias("genomes"))
    return settle(dealt.join(genomes, "block").mapInPandas(choose, "uid long, block long, bin int, used long, offset long"), "packing-bins")


def pack(pieces: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` of at most ``capacity``.

    Equal pieces are packed one by one. Of packings with as many bins the one with the larger sum of squared fills wins,
    then the first by its genome. Each round halves what is open, so their number is bounded by the logarithm of the
    number of pieces. An empty table gives an empty result.
    """
    pieces = settle(pieces.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    whole = pieces.where(F.col("length") >= params.capacity)
    part = pieces.where(F.col("length") < params.capacity).select("uid", "length")
    left, number, done = part.count(), 0, []
    while left:
        blocks = -(-left // params.block_pieces)
        found = _pack_round(part, blocks, number, params)
        # the round's number is in the top bits, then the block, then the bin
        ident = F.lit(number + 1) * F.lit(1 << 58) + F.col("block") * F.lit(1 << 16) + F.col("bin")
        found = found.withColumn("sequence_id", ident)
        closed = F.col("used") >= int(params.closed * params.capacity)
        if blocks > 1:
            part = found.where(~closed).join(part, "uid").select("uid", "length")
            rest = part.count()
            if rest <= 0.5 * left:
                done.append(found.where(closed))
                left, number = rest, number + 1
                continue
        done.append(found)
        break
    placed = whole.select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for found in done:
        placed = placed.unionByName(found.select("uid", "sequence_id", "offset"))
    return pieces.join(placed, "uid").drop("uid")
