"""Long repeated passages: every byte in a 50-byte string that also starts in a document with a smaller doc_id.

Run-length indexes of the whole corpus, one per partition of it. Documents are routed to where they can meet. Every
50-byte string (a window) has a minimizer, its least-hashed ``gram``; windows of one minimizer lie in a stretch of at
most ``2 * window - gram`` bytes, its context. Equal windows have equal minimizers, so contexts of one minimizer have
to meet, and no others.

1. Documents travel in blocks: a few megabytes of compressed rows. Each block sends the minimizers it holds, once each;
   those that a second document has come back to it, marked.
2. Blocks send the contexts of marked minimizers, with their bytes. A task sends contexts with equal bytes once, for the
   document with the least id; its other documents have an earlier one for them.
3. Each partition builds run-length indexes of its contexts, but for those that have their minimizer alone once equal
   ones are joined: no other context has a window of theirs. Suffixes are sorted, their Burrows-Wheeler transform cut
   into runs, with the least document of each run as its sample. Matching statistics of every context are streamed
   right to left through the runs; where a match reaches the window's length, the samples of its interval say whether an
   earlier document has it.

Minimizers with ``hot_rows`` contexts or more (a common phrase in ever new surroundings) would fill one partition. The
first step counts them; their windows are dealt out one by one, by a hash of the whole window, and meet in step 3 alike.

Spans go back to their blocks, are merged there, and their bytes are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallyforge.llm.common import settle, small_batches

_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xBF58476D1CE4E5B9)
_MORE = np.uint64(0x9FB21C651E98DF25)
#: places in a chunk of text take so many bits of a 64-bit word, the gram's hash the others
_PLACE_BITS = np.uint64(21)


@dataclass(frozen=True)
class RepeatParams:
    window: int = 50
    gram: int = 25
    #: bytes of text in a block (a longer document is a block of its own), and those that are hashed at a time
    block_bytes: int = 4_000_000
    chunk_bytes: int = 400_000
    #: minimizers that one partition of the first step holds on average; contexts, of the third
    part_keys: int = 2_000_000
    part_rows: int = 60_000
    #: contexts in one index
    index_rows: int = 20_000
    #: contexts a task gathers before it hands them on
    flush_rows: int = 300_000
    #: contexts from which a minimizer is dealt out by windows
    hot_rows: int = 4_096


# --- contexts of documents -------------------------------------------------


def _slide_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours, by doubling."""
    out, size = values, 1
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < n:
        m = len(values) - n + 1
        out = np.minimum(out[:m], out[n - size : n - size + m])
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


@dataclass
class Contexts:
    """Runs of windows with one minimizer: 48-bit minimizer, hash of the bytes, document's place, first byte in it and in
    ``buf``, length in bytes."""

    key: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    buf: np.ndarray


def _context_hash(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64) * _MORE)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array holds."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def contexts(texts: list[bytes], p: RepeatParams, shared: np.ndarray | None = None, hot: np.ndarray | None = None) -> Contexts:
    """Contexts of the texts; each window lies in exactly one. With ``shared`` only those whose minimizer it holds. Contexts
    whose minimizer is in ``hot`` are given as their windows, each with a hash of itself for a minimizer."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n, w = len(buf), p.window - p.gram + 1
    i64, u64 = np.empty(0, np.int64), np.empty(0, np.uint64)
    empty = Contexts(u64, u64, i64, i64, i64, i64, buf)
    if n < p.window:
        return empty
    if n >> int(_PLACE_BITS):
        raise ValueError("a chunk of text is too large")
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    gram = _mixed((sums[p.gram :] - sums[: -p.gram]) * down[: n - p.gram + 1])
    # the hash's upper bits, then the place: the least is the least hash, and of equal ones the leftmost
    placed = (gram >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(gram), dtype=np.uint64)
    place = (_slide_min(placed, w) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    start = np.flatnonzero(doc[: n - p.window + 1] == doc[p.window - 1 :])
    if not len(start):
        return empty
    place = place[start]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[first[1:], len(start)] - 1
    a, b = start[first], start[last] + p.window
    # the least hashes are small, so they are mixed anew to fall evenly
    key = _mixed(gram[place[first]] * _MORE) >> np.uint64(16)
    if shared is not None:
        many = _among(key, hot)
        keep = _among(key, shared) & ~many
        size = (last - first + 1)[many]
        each = np.repeat(a[many] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = _context_hash(sums, down, each, each + p.window)
        key = np.r_[key[keep], _mixed(own * _MORE) >> np.uint64(16)]
        a, b = np.r_[a[keep], each], np.r_[b[keep], each + p.window]
    begins = np.cumsum(lengths) - lengths
    return Contexts(key, _context_hash(sums, down, a, b), doc[a], a - begins[doc[a]], a, b - a, buf)


def _pieces(texts: list[bytes], p: RepeatParams) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Chunks of text: place of the document, first byte in it, bytes. Long documents come in slices that share no window."""
    rows, bases, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for base in range(0, max(1, len(t) - p.window + 1), p.chunk_bytes):
            part = t[base : base + p.chunk_bytes + p.window - 1]
            if held and held + len(part) > 2 * p.chunk_bytes:
                yield np.array(rows), np.array(bases), parts
                rows, bases, parts, held = [], [], [], 0
            rows.append(i)
            bases.append(base)
            parts.append(part)
            held += len(part)
    if parts:
        yield np.array(rows), np.array(bases), parts


# --- packed columns ----------------------------------------------------------


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of known types and equal length, compressed; numbers of more than a byte in planes, so that equal upper bytes vanish."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _spread(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = pa.decompress(data, decompressed_size=n * sum(np.dtype(k).itemsize for k in kinds), codec="zstd"), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(k).ravel())
        at += n * size
    return out


#: for texts: a fifth less to move than at the first level, for a twentieth more time in all
_TEXT = pa.Codec("zstd", compression_level=6)
_SPAN = ("<u4", "<u4", "<u4")  # row in the block, first byte, byte after the last
_STEPS = ("<u8", "<u4")  # steps between sorted minimizers, contexts of each


def _merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with those of a row that touch or overlap merged."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order].astype(np.int64), start[order].astype(np.int64), stop[order].astype(np.int64)
    far = np.maximum.accumulate(row * (1 << 32) + stop)
    cut = np.r_[True, (row[1:] != row[:-1]) | (row[1:] * (1 << 32) + start[1:] > far[:-1])]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(row)] - 1
    return row[first], start[first], far[last] - row[first] * (1 << 32)


def _by_block(block: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Block, number of spans, packed spans."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True]) + 1 if len(block) else []
    at = 0
    for end in ends:
        found = _merged(*(x[order[at:end]] for x in (row, start, stop)))
        yield int(block[at]), len(found[0]), _squeeze(*(x.astype(k) for x, k in zip(found, _SPAN, strict=True)))
        at = end


# --- blocks of documents -----------------------------------------------------


def _batch_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_TEXT)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _batch_of(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as source:
        return source.read_next_batch()


def _to_blocks(batches: Iterator[pa.RecordBatch], p: RepeatParams) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([_batch_bytes(whole)], pa.binary())], names=["docs"])

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        first = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > p.block_bytes:
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield block()
                first, size = i, 0
            size += n
        if batch.num_rows > first:
            held.append(batch.slice(first))
    if held:
        yield block()


def _texts(docs: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, UTF-8 texts and places of the documents that have an id."""
    known = np.flatnonzero(docs.column("_doc").is_valid().to_numpy(zero_copy_only=False))
    ids = pc.fill_null(docs.column("_doc"), 0).to_numpy(zero_copy_only=False)
    raw = docs.column("text").cast(pa.binary()).to_pylist()
    return ids, [raw[i] or b"" for i in known], known


# --- step 1: minimizers that several documents have ------------------------------


def _distinct_keys(docs: pa.RecordBatch, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted minimizers of a block, how many different contexts each has, whether several documents have it."""
    _, texts, _ = _texts(docs)
    found = [(c.key, c.hash, rows[c.row]) for rows, _, parts in _pieces(texts, p) if len((c := contexts(parts, p)).key)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, bool)
    key, h, row = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, key))
    key, h, row = key[order], h[order], row[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
    several = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
    return key[first], np.add.reduceat(new.astype(np.int64), first).astype(np.uint32), several


def _send_keys(batches: Iterator[pa.RecordBatch], parts: int, p: RepeatParams) -> Iterator[pa.RecordBatch]:
    """A block's minimizers by partition. Every minimizer of several documents counts twice or more."""
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key, n, several = _distinct_keys(_batch_of(data), p)
            part = ((key >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
            if not len(part):
                continue
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            last = np.r_[first[1:], len(part)]
            sizes = [b - a for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            packed = [_squeeze(np.diff(key[a:b], prepend=np.uint64(0)), n[a:b], several[a:b].astype(np.uint8)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array([block] * len(first), pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["part", "block", "n", "data"])


_MARKS = "block long, n int, data binary, shared long, hot long"


def _mark(batches: Iterator[pa.RecordBatch], p: RepeatParams) -> Iterator[pa.RecordBatch]:
    """Of each block's minimizers those that several documents have, marked if they are hot; with the number of contexts."""
    now, held = None, []

    def marked() -> pa.RecordBatch:
        cols = [_spread(data, n, *_STEPS, "u1") for _, n, data in held]
        key = np.concatenate([np.cumsum(c[0]) for c in cols])
        n, several = np.concatenate([c[1] for c in cols]).astype(np.int64), np.concatenate([c[2] for c in cols]) > 0
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]])
        blocks = np.diff(np.r_[first, len(order)])
        shared = (blocks > 1) | np.logical_or.reduceat(several[order], first)
        flag = np.where(shared, np.where(np.add.reduceat(n[order], first) >= p.hot_rows, 2, 1), 0).astype(np.uint8)
        flags = np.empty(len(key), np.uint8)
        flags[order] = np.repeat(flag, blocks)
        ends = np.cumsum([len(c[0]) for c in cols]).tolist()
        out: list[list] = [[] for _ in range(5)]
        for (block, size, _), end in zip(held, ends, strict=True):
            own = slice(end - size, end)
            k, f, m = (x[own][flags[own] > 0] for x in (key, flags, n))
            if len(k):
                for column, value in zip(out, (block, len(k), _squeeze(np.diff(k, prepend=np.uint64(0)), f), int(m[f == 1].sum()), int(m[f == 2].sum())), strict=True):
                    column.append(value)
        held.clear()
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["block", "n", "data", "shared", "hot"])

    for batch in batches:
        for part, block, n, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part != now and held:
                yield marked()
            now = part
            held.append((block, n, data))
    if held:
        yield marked()


# --- step 2: contexts with their bytes --------------------------------------------


def _joined(blob: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``blob``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return blob[np.repeat(begins - before, lengths) + np.arange(lengths.sum())]


def _equal_bytes(blob: np.ndarray, begins: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each stretch has the same bytes as the stretch at place ``other``."""
    same = lengths == lengths[other]
    ok = np.flatnonzero(same & (other != np.arange(len(other))))
    if len(ok):
        differ = _joined(blob, begins[ok], lengths[ok]) != _joined(blob, begins[other[ok]], lengths[ok])
        ends = np.cumsum(lengths[ok]) - lengths[ok]
        same[ok] = ~np.logical_or.reduceat(differ, ends)
    return same


def _classes(key: np.ndarray, h: np.ndarray, blob: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the contexts by minimizer and hash, and where classes of equal bytes begin in it. Where a hash is the same
    but the bytes are not, a class is cut; the index joins what belongs together."""
    order = np.lexsort((h, key))
    k, g = key[order], h[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])] if len(k) else np.empty(0, bool)
    if len(order):
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        new |= ~_equal_bytes(blob, begins[order], lengths[order], head)
    return order, np.flatnonzero(new)


_SENT = "part int, block long, n int, m int, data binary, bytes binary"
_NAMES = ["part", "block", "n", "m", "data", "bytes"]
_CLASS = ("<u8", "u1", "<u4")  # step from the minimizer before, length, rows
_ROW = ("<i8", "<i8", "<u4", "<u4")  # document, block, row in the block, first byte


def _span_rows(found: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Spans as rows that pass the third step unchanged; they are dealt out by block."""
    block, n, data = zip(*found, strict=True)
    none = [None] * len(block)
    part = [hash(b) & 0x3FFFFFFF for b in block]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(n, pa.int32()), pa.array(none, pa.int32()), pa.array(data, pa.binary()), pa.array(none, pa.binary())], names=_NAMES)


def _send(batches: Iterator[pa.RecordBatch], parts: int, p: RepeatParams) -> Iterator[pa.RecordBatch]:
    """Contexts of marked minimizers, dealt out by minimizer (hot ones: by window). Batches: block, docs, marks."""
    gathered: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        key, h, doc, block, row, start, length = (np.concatenate(x) for x in zip(*(g[:-1] for g in gathered), strict=True))
        blob = np.concatenate([g[-1] for g in gathered])
        gathered.clear()
        begins = np.cumsum(length) - length
        order, first = _classes(key, h, blob, begins, length)
        least = np.minimum.reduceat(doc[order], first)
        count = np.diff(np.r_[first, len(order)])
        later = doc[order] > np.repeat(least, count)
        if later.any():  # a document before it in this task has these bytes
            gone = order[later]
            yield _span_rows(_by_block(block[gone], row[gone], start[gone], start[gone] + length[gone]))
        heads, rows = order[first], order[~later]
        of_class = np.repeat(np.arange(len(first)), count)[~later]
        part = ((key[heads] >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
        a = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        b = np.r_[a[1:], len(part)]
        ra, rb = np.searchsorted(of_class, a), np.searchsorted(of_class, b)
        per = np.bincount(of_class, minlength=len(heads))
        for at in range(0, len(a), 64):
            out: list[list] = [[] for _ in _NAMES]
            for i, j, ri, rj in zip(*(x[at : at + 64].tolist() for x in (a, b, ra, rb)), strict=True):
                c, r = heads[i:j], rows[ri:rj]
                classes = _squeeze(np.diff(key[c], prepend=np.uint64(0)), length[c].astype(np.uint8), per[i:j].astype("<u4"))
                members = _squeeze(doc[r].astype("<i8"), block[r].astype("<i8"), row[r].astype("<u4"), start[r].astype("<u4"))
                raw = _TEXT.compress(_joined(blob, begins[c], length[c]).tobytes(), asbytes=True)
                values = int(part[i]), len(classes), j - i, rj - ri, classes + members, raw
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=_NAMES)

    size = 0
    for batch in batches:
        for block, data, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            cols = [_spread(x["data"], x["n"], "<u8", "u1") for x in marks]
            keys, flags = np.concatenate([np.cumsum(c[0]) for c in cols]), np.concatenate([c[1] for c in cols])
            order = np.argsort(keys)
            shared, hot = keys[order], keys[order][flags[order] > 1]
            ids, texts, known = _texts(_batch_of(data))
            for rows, bases, parts_of_text in _pieces(texts, p):
                c = contexts(parts_of_text, p, shared, hot)
                if len(c.key):
                    at = known[rows[c.row]]
                    gathered.append((c.key, c.hash, ids[at], np.full(len(at), block), at, bases[c.row] + c.start, c.length, _joined(c.buf, c.begin, c.length)))
                    size += len(at)
            if size >= p.flush_rows:
                yield from flush()
                size = 0
    if gathered:
        yield from flush()


# --- step 3: the run-length index ---------------------------------------------------


class RunIndex:
    """Run-length Burrows-Wheeler index of a set of contexts, each with the least document that has it.

    A separator ends each context; suffixes are sorted by prefix doubling. Kept are:

    - ``heads, symbols``: where a run of equal symbols before the sorted suffixes begins, and its symbol. Runs are also cut
      where the longest common prefix of neighbours is shorter than the window, so a run lies in one window's interval;
    - ``sampled``: the least document among a run's suffixes;
    - ``starts, least``: where the intervals of windows begin, and the least sample of their runs;
    - ``seeds``: the interval of each context's last bytes, where its matching statistics start.
    """

    def __init__(self, blob: np.ndarray, lengths: np.ndarray, docs: np.ndarray, window: int):
        m = len(lengths)
        self.lengths, self.window = lengths, window
        ends = np.cumsum(lengths + 1) - 1  # of the separators
        self.begins = ends - lengths
        n = int(ends[-1]) + 1 if m else 0
        self.text = text = np.zeros(n + 8, np.uint8)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[:n][inside] = blob + 1  # UTF-8 has no byte 255
        own = np.repeat(np.arange(m), lengths + 1)
        left = ends[own] - np.arange(n)  # symbols before the separator
        order, rank, seed_rank, depth = self._sort(text, ends, own, left, window)
        symbol = np.where(left[order] < lengths[own[order]], text[order - 1], 0)
        whole = left[order] >= window
        # equal over the window: equal at both ends of it
        one, two = seed_rank[order], seed_rank[np.minimum(order + window - depth, n - 1)]
        same = np.zeros(n, bool)
        same[1:] = whole[1:] & whole[:-1] & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        border = ~same
        border[1:] &= whole[1:] | whole[:-1]
        border[:1] = True
        cut = border.copy()
        cut[1:] |= symbol[1:] != symbol[:-1]
        self.heads = np.flatnonzero(cut)
        self.symbols = symbol[self.heads]
        self.sampled = np.minimum.reduceat(docs[own[order]], self.heads)
        self.starts = np.flatnonzero(border)
        self.least = np.minimum.reduceat(self.sampled, np.searchsorted(self.heads, self.starts))
        self.ends = np.r_[self.starts[1:], n]
        low = seed_rank[ends - depth]
        self.seeds = low, low + np.bincount(seed_rank, minlength=n)[low]
        self.depth = depth
        # per symbol its runs, and where the suffixes begin that follow it: what a backward step needs
        size = np.diff(np.r_[self.heads, n])
        by = np.argsort(self.symbols, kind="stable")
        alphabet = np.arange(257)
        before = np.searchsorted(self.symbols[by], alphabet)
        counts = np.r_[0, np.cumsum(size[by])]
        first = np.r_[0, np.cumsum(np.bincount(text[:n], minlength=256))]
        base = first[self.symbols[by]] + counts[:-1] - counts[before[self.symbols[by]]]
        # an empty run before the first of each symbol, so that a search always finds one
        at = before[:256]
        self.run_key = np.insert((self.symbols[by].astype(np.int64) << 32) + self.heads[by] + 1, at, alphabet[:256] << 32)
        self.run_head = np.insert(self.heads[by], at, 0)
        self.run_size = np.insert(size[by], at, 0)
        self.run_base = np.insert(base, at, first[:256])

    @staticmethod
    def _sort(text: np.ndarray, ends: np.ndarray, own: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted suffixes, their ranks, and ranks by the first ``depth`` symbols (the rank of the first that has them)."""
        n, m = len(own), len(ends)
        key = np.zeros(n, np.uint64)
        for s in range(8):
            key |= text[s : s + n].astype(np.uint64) << np.uint64(56 - 8 * s)
        near = np.flatnonzero(left < 8)
        key[near] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[near]).astype(np.uint64) % np.uint64(64))) - np.uint64(1))
        key[ends] = 0
        order = np.argsort(key)
        order[:m] = ends  # separators come first, in the order of their contexts
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        new[:m] = True
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth, seed_rank, seed_depth = 8, None, 8
        while seed_depth * 2 <= window:
            seed_depth *= 2
        stop = ends[own]
        while True:
            if depth == seed_depth:
                seed_rank = rank.copy()
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            at = order[slots]
            pair = (rank[at] << 32) | rank[np.minimum(at + depth, stop[at])]
            by = np.argsort(pair)
            at, pair = at[by], pair[by]
            order[slots] = at
            fresh = np.r_[True, pair[1:] != pair[:-1]]
            new[slots] = fresh
            rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
            depth *= 2
        return order, rank, rank if seed_rank is None else seed_rank, seed_depth

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that put ``symbol`` before those from ``at`` on."""
        run = np.searchsorted(self.run_key, (symbol << 32) + at, side="right") - 1
        return self.run_base[run] + np.minimum(at - self.run_head[run], self.run_size[run])

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context, place in it, and least document of every window, from matching statistics.

        All contexts are read from right to left at once, a symbol each a step. The state is the interval of the suffixes
        that match what was read, up to the window's length.
        """
        long_first = np.argsort(-self.lengths, kind="stable")
        lengths, begins = self.lengths[long_first], self.begins[long_first]
        low, high = (x[long_first].copy() for x in self.seeds)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for read in range(self.depth, int(lengths[0]) + 1 if len(lengths) else 0):
            if read > self.depth:
                k = int(np.searchsorted(-lengths, -read, side="right"))
                symbol = self.text[begins[:k] + lengths[:k] - read].astype(np.int64)
                low, high = self._step(symbol, low[:k]), self._step(symbol, high[:k])
            if read >= self.window:
                group = np.searchsorted(self.starts, low, side="right") - 1
                low, high = self.starts[group], np.where(high > low, self.ends[group], low)
                least = np.where(high > low, self.least[group], np.iinfo(np.int64).max)
                found.append((long_first[: len(low)], lengths[: len(low)] - read, least))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _neighboured(values: np.ndarray) -> np.ndarray:
    """Which values of a sorted array it holds twice or more."""
    again = values[1:] == values[:-1]
    return np.r_[False, again] | np.r_[again, False] if len(values) else np.empty(0, bool)


def _match(batches: Iterator[pa.RecordBatch], p: RepeatParams) -> Iterator[pa.RecordBatch]:
    """``block, n, data``: spans that earlier documents have. Batches are sorted by part."""
    names = ["block", "n", "data"]
    now, held = None, []

    def indexed() -> Iterator[pa.RecordBatch]:
        cols = [_spread(data[:cut], n, *_CLASS) for n, _, cut, data, _ in held]
        rows = [_spread(data[cut:], m, *_ROW) for _, m, cut, data, _ in held]
        key = np.concatenate([np.cumsum(c[0]) for c in cols])
        length = np.concatenate([c[1] for c in cols]).astype(np.int64)
        per = np.concatenate([c[2] for c in cols]).astype(np.int64)
        doc, block, row, start = (np.concatenate(x) for x in zip(*rows, strict=True))
        sizes = [int(c[1].astype(np.int64).sum()) for c in cols]
        blob = np.concatenate([np.frombuffer(pa.decompress(raw, decompressed_size=k, codec="zstd"), np.uint8) for k, (*_, raw) in zip(sizes, held, strict=True)])
        held.clear()
        begins, first = np.cumsum(length) - length, np.cumsum(per) - per
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        found: list[list[np.ndarray]] = [[], [], []]  # row, first byte, bytes
        at = 0
        while at < len(order):  # all contexts of a minimizer in one index
            end = min(at + p.index_rows, len(order))
            end = int(np.searchsorted(sorted_key, sorted_key[end - 1], side="right"))
            mine = order[at:end]
            at = end
            text, size = _joined(blob, begins[mine], length[mine]), length[mine]
            stops = np.cumsum(size)
            up, down = _powers(len(text) + 1)
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            by, heads = _classes(key[mine], _context_hash(sums, down, stops - size, stops), text, stops - size, size)
            one = by[heads]
            same = np.empty(len(mine), np.int64)  # the distinct context of each
            same[by] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(by)]))
            which = np.repeat(first[mine] - (np.cumsum(per[mine]) - per[mine]), per[mine]) + np.arange(per[mine].sum())
            of = np.repeat(same, per[mine])
            least = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(least, of, doc[which])
            # a document after the context's first has earlier matches for all windows of it; the first, for those that others have
            later = doc[which] > least[of]
            spans = [(which[later], np.zeros(later.sum(), np.int64), size[one][of[later]])]
            # a context that has its minimizer alone shares no window with others: the index holds those that do not
            met = np.flatnonzero(_neighboured(key[mine][one]))
            if len(met):
                some = one[met]
                context, place, earliest = RunIndex(_joined(text, (stops - size)[some], size[some]), size[some], least[met], p.window).matches()
                context = met[context]
                hit = earliest < least[context]
                c, o = context[hit], place[hit]
                sort = np.argsort(c, kind="stable")
                c, o = c[sort], o[sort]
                lead = np.flatnonzero(~later)
                a, b = np.searchsorted(c, of[lead]), np.searchsorted(c, of[lead], side="right")
                many = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
                spans.append((np.repeat(which[lead], b - a), o[many], np.full(len(many), p.window)))
            for column, values in zip(found, zip(*spans, strict=True), strict=True):
                column.extend(values)
        w, o, k = (np.concatenate(x) for x in found)
        begin = start[w].astype(np.int64) + o
        rows_out = list(_by_block(block[w], row[w], begin, begin + k))
        if rows_out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows_out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=names)

    for batch in batches:
        through = batch.filter(pc.is_null(batch.column(5)))
        if through.num_rows:
            yield pa.RecordBatch.from_arrays([through.column(i) for i in (1, 2, 4)], names=names)
        for part, cut, n, m, data, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if raw is None:
                continue
            if part != now and held:
                yield from indexed()
            now = part
            held.append((n, m, cut, data, raw))
    if held:
        yield from indexed()


# --- the job ---------------------------------------------------------------------------


def blocks_of(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """``block, docs``: ids (``_doc``), texts and all other columns (one struct, ``_row``, so that no name of theirs matters), some
    megabytes of text together, compressed."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"), others.alias("_row"))
    packed = rows.mapInArrow(lambda batches: _to_blocks(batches, params), "docs binary")
    return settle(packed.select(F.monotonically_increasing_id().alias("block"), "docs"), "repeat-blocks")


def repeats(blocks: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``block, spans``: packed spans (bytes) to remove from the block's documents; they may overlap."""
    held = blocks.agg(F.coalesce(F.sum(F.octet_length("docs")), F.lit(0))).first()[0]
    # texts shrink to about two fifths, and a context has about half as many windows as it may have
    parts = max(1, int(held * 2.5 * 2 / (params.window - params.gram + 2) / params.part_keys))
    keys = blocks.mapInArrow(lambda batches: _send_keys(batches, parts, params), "part int, block long, n int, data binary")
    dealt = keys.repartition(parts, "part").sortWithinPartitions("part")
    marks = settle(dealt.mapInArrow(lambda batches: _mark(batches, params), _MARKS), "repeat-marks")
    total = marks.agg(F.coalesce(F.sum("shared") + F.sum("hot") * ((params.window - params.gram + 2) // 2), F.lit(0))).first()[0]
    parts = max(1, int(total / params.part_rows))
    # both sides grow with the input, so neither is broadcast however small it is now
    marks = marks.groupBy("block").agg(F.collect_list(F.struct("n", "data")).alias("marks")).hint("merge")
    sent = blocks.join(marks, "block").select("block", "docs", "marks").mapInArrow(lambda batches: _send(batches, parts, params), _SENT)
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part")
    spans = dealt.mapInArrow(lambda batches: _match(batches, params), "block long, n int, data binary")
    return spans.groupBy("block").agg(F.collect_list(F.struct("n", "data")).alias("spans"))


#: What ``cut`` adds to a row.
ADDED = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "kept_text": "string"}


def _cut_rows(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """``_row`` (all columns but the text), ``text`` and the added columns."""
    small_batches(docs.sparkSession)
    blocks = blocks_of(docs, params)
    joined = blocks.join(repeats(blocks, params).hint("merge"), "block", "left").select("docs", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _cut_block(_batch_of(data), packed or [])

    others = StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = StructType([StructField("_row", others), StructField("text", StringType())] + [StructField(k, {"long": LongType(), "binary": BinaryType(), "string": StringType()}[t]) for k, t in ADDED.items()])
    return joined.mapInArrow(run, schema)


def _column(name: str) -> Column:
    return F.col("text") if name == "text" else F.col("_row")[name].alias(name)


def cut(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left) and ``kept_text`` added.

    Strings are judged on the input; matches never cross documents. A null text counts as empty. Rows with a null
    doc_id have no place in the order: they lose nothing and take nothing from others. Rows that repeat a doc_id don't
    take from each other. Of equal strings the one in the document with the least doc_id stays. A text of any length is
    read in slices. ``kept_text`` leaves out the rest of a character that a cut has split. Columns with the added names
    are replaced, all others keep their values; an empty table gives an empty result.
    """
    return _cut_rows(docs, params).select(*[_column(c) for c in docs.columns if c not in ADDED], *ADDED)


def cut_texts(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``docs`` with what ``cut`` leaves as ``text`` and its code points as ``n_chars``, if there is such a column.

    A null text stays null. All other columns keep their values, whatever their names.
    """
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    changed = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return _cut_rows(docs, params).select(*[changed.get(c, _column(c)) for c in docs.columns])


def _cut_block(docs: pa.RecordBatch, packed: list[dict]) -> pa.RecordBatch:
    texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
    row, start, stop = _merged(*(np.concatenate(x) for x in zip(*(_spread(x["data"], x["n"], *_SPAN) for x in packed), strict=True))) if packed else (np.empty(0, np.int64),) * 3
    first, last = np.searchsorted(row, np.arange(len(texts))).tolist(), np.searchsorted(row, np.arange(len(texts)), side="right").tolist()
    out: dict[str, list] = {k: [] for k in ADDED}
    for raw, a, b in zip(texts, first, last, strict=True):
        kept, at = [], 0
        for s, e in zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True):
            kept.append(raw[at:s])
            at = e
        kept.append(raw[at:])
        left = b"".join(kept)
        for k, v in zip(ADDED, (len(raw), len(raw) - len(left), b - a, left, left.decode("utf-8", "ignore")), strict=True):
            out[k].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([docs.column("_row"), docs.column("text"), *(pa.array(out[k], t) for k, t in zip(ADDED, kinds, strict=True))], names=["_row", "text", *ADDED])
