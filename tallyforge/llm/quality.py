"""Quality rules: counting rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

The ratio compares two multinomials over hashed word unigrams and bigrams: one
of trusted documents, one of the whole corpus. A document's score is the mean
log ratio of its n-grams; it stays if the score reaches a threshold that is set
once from labelled documents the trusted model has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import settle, text_of

#: Log ratios are whole numbers of this fraction, so that their sums don't depend on the order of rows.
UNIT = 1_000_000.0
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class QualityParams:
    """``buckets`` bounds the model; it is fitted on all labelled rows."""

    buckets: int = 1 << 18
    #: words of 64 bits that say which documents may have a label; more labels let more others through, which the join drops
    marks: int = 1 << 18
    #: weight of the corpus model in the trusted one, as a share of the trusted n-grams
    prior: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50
    #: score bins for the threshold
    bins: int = 2_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator, so that the optimizer can't copy their expressions into every place that reads them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first find included."""

    def at(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            found = F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["p"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(_let(pairs, places), start, step, lambda a: a["n"])

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), at)
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, counted)).cast("long")


def base_rules(docs: DataFrame, params: QualityParams = QualityParams(), text: str = "text") -> DataFrame:
    """Add ``words`` and the counting columns to ``docs``; a null text has no words."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = computed(docs, {"words": words_of(t), "lines": lines})
    w = F.col("words")
    out = computed(
        out,
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": repeat_words(w),
        },
    ).drop("lines")
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _grams(df: DataFrame, params: QualityParams, keep: list[str]) -> DataFrame:
    """A row for each word: bucket of the word, and of the word with its follower."""
    w = F.col("words")
    pairs = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b"))
    rows = df.select(*keep, F.inline_outer(pairs).alias("a", "b"))
    n = F.lit(params.buckets)
    uni = F.when(F.col("a").isNotNull(), F.pmod(F.xxhash64("a"), n).cast("int"))
    bi = F.when(F.col("b").isNotNull(), F.pmod(F.xxhash64("a", "b"), n).cast("int"))
    return rows.select(*keep, uni.alias("uni"), bi.alias("bi"))


def labelled_texts(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """``text, quality, fit`` of every labelled document; half fit the model, half set the threshold.

    Only texts that may have a label are shuffled: a table of at most ``marks`` rows holds a bit for each labelled id's hash.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.select("doc_id", "quality", (F.pmod(F.xxhash64("doc_id", F.lit(88)), F.lit(2)) == 0).alias("fit"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(64 * params.marks))
    word, bit = F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    marks = rows.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    marked = docs.select("doc_id", "text", word.alias("_word"), bit.alias("_bit")).join(F.broadcast(marks), "_word")
    marked = marked.where(F.call_function("shiftright", "_bits", "_bit").bitwiseAND(F.lit(1)) == 1).select("doc_id", "text")
    # texts are not sorted for the join
    return marked.join(rows.hint("shuffle_hash"), "doc_id").select("text", "quality", "fit")


def fit_ratio(docs: DataFrame, labelled: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Table ``bucket, llr`` of at most ``buckets`` rows. The corpus model counts every n-gram of every document, the trusted one
    those of every good document of the fitted half of ``labelled``."""

    def counts_of(texts: DataFrame, name: str) -> DataFrame:
        grams = _grams(texts.select(words_of(text_of()).alias("words")), params, [])
        each = grams.select(F.explode(F.array("uni", "bi")).alias("bucket")).where("bucket is not null")
        return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    trusted = counts_of(labelled.where("fit and quality = 1"), "trusted")
    counts = counts_of(docs, "raw").join(trusted, "bucket", "left").select("bucket", "raw", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    counts = settle(counts, "quality-counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raws"), F.coalesce(F.sum("trusted"), F.lit(0)).alias("trusts"))
    share = F.col("raw") / F.col("raws")
    weight = params.prior * F.col("trusts") + 1.0
    trusted = (F.col("trusted") + weight * share) / (F.col("trusts") + weight)
    return counts.join(F.broadcast(total)).select("bucket", F.round(F.log(trusted / share) * UNIT).cast("long").alias("llr"))


def score(rows: DataFrame, ratio: DataFrame, params: QualityParams, keep: list[str]) -> DataFrame:
    """Mean log ratio of each row's n-grams. ``rows`` has ``words``; ``ratio`` has at most ``buckets`` rows, so it is broadcast."""
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "words", *keep)
    grams = _grams(rows, params, ["row", *keep])
    one = F.broadcast(ratio.select(F.col("bucket").alias("uni"), F.col("llr").alias("llr_uni")))
    two = F.broadcast(ratio.select(F.col("bucket").alias("bi"), F.col("llr").alias("llr_bi")))
    found = grams.join(one, "uni", "left").join(two, "bi", "left")
    n = F.count("uni") + F.count("bi")
    mean = (F.coalesce(F.sum("llr_uni"), F.lit(0)) + F.coalesce(F.sum("llr_bi"), F.lit(0))) / F.lit(UNIT) / F.greatest(n, F.lit(1))
    return found.groupBy("row").agg(*[F.first(c).alias(c) for c in keep], mean.alias("score")).drop("row")


def fit_threshold(labelled: DataFrame, ratio: DataFrame, params: QualityParams = QualityParams()) -> float:
    """The score that best parts held-out good from bad labelled documents (largest sum of both rates).

    Without labels of both kinds there is nothing to part, and no document is rejected.
    """
    # documents that the counting rules reject anyway say nothing about the ratio
    held = base_rules(labelled.where("not fit"), params).where("not base_failed")
    scores = score(held, ratio, params, ["quality"])
    width = 20.0 / params.bins
    binned = scores.groupBy(F.floor(F.greatest(F.least("score", F.lit(10.0)), F.lit(-10.0)) / width).alias("bin"), "quality").count().collect()
    good = {r["bin"]: r["count"] for r in binned if r["quality"] == 1}
    bad = {r["bin"]: r["count"] for r in binned if r["quality"] == 0}
    if not good or not bad:
        return float("-inf")
    n_good, n_bad = sum(good.values()), sum(bad.values())
    lost = caught = 0
    best, ties = -1.0, []
    for b in range(min(*good, *bad), max(*good, *bad) + 2):
        gain = caught / n_bad - lost / n_good
        if gain > best + 1e-12:
            best, ties = gain, [b]
        elif gain > best - 1e-12:
            ties.append(b)
        lost += good.get(b, 0)
        caught += bad.get(b, 0)
    return (ties[0] + (ties[-1] - ties[0]) * 0.5) * width


def judge(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Verdict for every row of ``docs``: counting columns, ``base_failed``, ``score`` and ``kept``.

    Null or empty text: no words, ``base_failed``. Rows that repeat a doc_id are judged one by one.
    Empty tables give an empty result; other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text")
    labelled = settle(labelled_texts(docs, labels, params), "quality-labelled")
    ratio = settle(fit_ratio(docs, labelled, params), "quality-ratio")
    threshold = fit_threshold(labelled, ratio, params)
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "text_key"]
    rows = base_rules(docs.withColumn("text_key", F.xxhash64("text")), params)
    scored = score(rows, ratio, params, keep)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns."""
    kept = judge(docs, labels, params).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_key"]), "left_semi")
