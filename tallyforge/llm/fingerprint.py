"""Document fingerprints: a homomorphic multiset hash over paragraphs. DataFrame functions only.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors, each part modulo a power of two. The sum does not depend
on the order of paragraphs, and a paragraph is inserted or deleted by adding or
subtracting its vector. A vector has two parts:

- ``EXACT`` words of 64 bits, hashed from the whole paragraph, modulo 2^64: equality;
- ``LANES`` counters, modulo 2^32, packed two to a word: for each word pair of
  the paragraph the bits of its hash. They let two fingerprints be compared: the
  counters less half the number of pairs are random projections of the multiset
  of pairs, and the cosine of two documents' projections is their likeness. A
  text holds less than 2^31 bytes, so no counter of a document reaches its modulus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.llm.common import settle, text_of

EXACT = 4
WIDTH = 32
PACKED = 30
LANES = 2 * PACKED
MASK = 1 | 1 << WIDTH


def _wrapping_sum(values: Column, of) -> Column:
    """Sum of ``of(x)`` over an array of strings, modulo 2^64.

    Spark's sums fail on overflow, so 32-bit halves are added apart and joined again.
    """
    low = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + of(x).bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + F.shiftrightunsigned(of(x), 32)).bitwiseAND(F.lit(0xFFFFFFFF)))
    carried = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def vectors(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the ``vector`` of each row: ``exact`` words, ``packed`` counters and the number of ``pairs``.

    The empty text has one empty paragraph and no pair. Rows are summed where they lie: one row per document is shuffled.
    """
    paragraphs = F.split(F.col(text), "\n")
    exact = [_wrapping_sum(paragraphs, lambda p, k=k: F.xxhash64(p, F.lit(k))).alias(f"e{k}") for k in range(EXACT)]
    # pairs stay inside their paragraph, so that the vectors of paragraphs add up
    words = F.array_remove(F.split(F.regexp_replace(text, "\n+", " \n "), "[ \t\r\f]+"), "")
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), *keep, *exact, words.alias("_w"))
    pairs = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("b"))
    names = [f"e{k}" for k in range(EXACT)]
    rows = rows.select("_row", *keep, *names, F.inline_outer(pairs).alias("a", "b"))
    h = F.when(F.col("a").isNotNull() & (F.col("a") != "\n"), F.xxhash64("a", F.nullif(F.col("b"), F.lit("\n"))))
    rows = rows.select("_row", *keep, *names, h.alias("h"))
    lanes = [F.coalesce(F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(MASK))), F.lit(0)).alias(f"c{k}") for k in range(PACKED)]
    first = [F.first(c).alias(c) for c in [*keep, *names]]
    summed = rows.groupBy("_row").agg(*first, *lanes, F.count("h").alias("pairs"))
    vector = F.struct(F.array(*names).alias("exact"), F.array(*[f"c{k}" for k in range(PACKED)]).alias("packed"), "pairs")
    return summed.select(*keep, vector.alias("vector"))


def as_text(v: str) -> Column:
    """The fingerprint as hexadecimal text: exact words, then packed counters, then the number of pairs."""
    words = F.transform(F.concat(f"{v}.exact", f"{v}.packed", F.array(f"{v}.pairs")), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.array_join(words, "")


def _lane(packed: Column, k: int, pairs: Column) -> Column:
    """Twice the counter less the number of pairs."""
    count = F.shiftrightunsigned(packed, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))
    return (2 * count - pairs).cast("double")


def _dot(one: str, two: str) -> Column:
    a, b = F.col(f"{one}.pairs"), F.col(f"{two}.pairs")
    products = F.zip_with(f"{one}.packed", f"{two}.packed", lambda x, y: reduce(lambda p, q: p + q, [_lane(x, k, a) * _lane(y, k, b) for k in range(2)]))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def likeness(one: str, two: str) -> Column:
    """Cosine of two vectors' projections, from 0 to 1; 1 if all exact words agree."""
    norm = F.sqrt(_dot(one, one) * _dot(two, two))
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(one, two) / norm))).otherwise(0.0)
    return F.when(F.col(f"{one}.exact") == F.col(f"{two}.exact"), F.lit(1.0)).otherwise(cosine)


def neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id, prev_id, take`` for each distinct doc_id; ``take`` is how much of its text the one before it needs.

    Ids are dealt out by range; inside a range a window finds neighbours, and the ends of the ranges, one row for each,
    are joined to those of the next range. The first follows the last.
    """
    lengths = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lengths.repartitionByRange(parts, "doc_id").select("doc_id", "n", F.spark_partition_id().alias("part"))
    ranged = settle(ranged, "fingerprint-order")
    w = Window.partitionBy("part").orderBy("doc_id")
    inner = ranged.select("*", F.lead("doc_id").over(w).alias("next_id"), F.lag("n").over(w).alias("prev_n"), F.lag("doc_id").over(w).alias("prev_id"))
    ends = ranged.groupBy("part").agg(F.min("doc_id").alias("head"), F.max_by(F.struct("doc_id", "n"), "doc_id").alias("tail"))
    # one row for each range: their number is a setting, not the data's size
    ring = Window.orderBy("part")
    all_rows = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("head").over(ring), F.first("head").over(all_rows)).alias("after"),
        F.coalesce(F.lag("tail").over(ring), F.last("tail").over(all_rows)).alias("before"),
    )
    out = inner.join(F.broadcast(ends), "part")
    is_first, is_last = F.col("prev_n").isNull(), F.col("next_id").isNull()
    return out.select(
        "doc_id",
        F.when(is_last, F.col("after")).otherwise(F.col("next_id")).alias("next_id"),
        F.when(is_first, F.col("before.doc_id")).otherwise(F.col("prev_id")).alias("prev_id"),
        F.floor(F.when(is_first, F.col("before.n")).otherwise(F.col("prev_n")) / 4).alias("take"),
    )


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the README for the edit), and their likenesses.

    A null text counts as empty, a null doc_id is an id of its own that sorts first. Rows that repeat a doc_id each
    give a row; as a neighbour such an id stands with the smallest of its texts. A single document follows itself.
    Texts of any length are hashed whole. Other columns are ignored; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    # nulls would meet nothing in a join; the flag beside the id lets them
    docs = docs.select(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id")).alias("doc_id"), text_of().alias("text"))
    docs = docs.withColumn("doc_id", F.struct(F.col("doc_id.known"), F.coalesce("doc_id.id", F.lit(0).cast(kind)).alias("id")))
    places = settle(neighbours(docs), "fingerprint-neighbours")
    heads = docs.join(places.select("doc_id", "prev_id", "take"), "doc_id")
    heads = heads.groupBy(F.col("prev_id").alias("doc_id")).agg(F.min(F.expr("substring(text, 1, cast(take AS int))")).alias("head"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("head"), F.lit(1), quarter))
    both = docs.join(heads, "doc_id").select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    uid = F.monotonically_increasing_id()
    both = both.select(uid.alias("uid"), "*")
    side = lambda is_edit, text, sha: F.struct(F.lit(is_edit).alias("is_edit"), text.alias("text"), sha.alias("sha"))
    sides = F.array(side(False, F.col("text"), F.lit("")), side(True, F.col("edited"), F.sha2("edited", 256)))
    sides = both.select("uid", "doc_id", "n_chars", F.inline(sides))
    found = settle(vectors(sides, ["uid", "doc_id", "n_chars", "is_edit", "sha"]), "fingerprint-vectors")
    own = found.where("not is_edit").select("uid", "doc_id", "n_chars", F.col("vector").alias("own"))
    edit = found.where("is_edit").select("uid", F.col("sha").alias("edited_sha256"), F.col("vector").alias("edit"))
    first = own.groupBy("doc_id").agg(F.min("own").alias("following"))
    first = first.join(places.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before")), "doc_id")
    rows = own.join(edit, "uid").join(first.select(F.col("before").alias("doc_id"), "following"), "doc_id")
    return rows.select(
        F.when(F.col("doc_id.known"), F.col("doc_id.id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text("own").alias("fingerprint"),
        as_text("edit").alias("edited_fingerprint"),
        likeness("own", "edit").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )
