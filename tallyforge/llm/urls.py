"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by vectorised binary search.

A rule is a host and a path prefix. It fits a url whose host is the rule's host
or a subdomain of it and whose path starts with the rule's path. The longest
rule that fits decides. Every candidate (host suffix, path prefix) of a url is
hashed and searched in the sorted keys; a hit counts only if the stored rule
string is the candidate itself, so that a digest collision can't decide.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import small_batches

#: Rules beyond this many bytes are not sent to the executors; ``judge`` then hands them to ``judge_by_join``.
MAX_INDEX_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """``verdict host/path`` per line. Repeated rules collapse; of two verdicts for one rule, block wins."""
    found: dict[str, Rule] = {}
    for line in lines:
        verdict, _, rest = line.strip().partition(" ")
        host, slash, path = rest.partition("/")
        rule = Rule(verdict, host.lower(), slash + path)
        if rule.text not in found or verdict == "block":
            found[rule.text] = rule
    return list(found.values())


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Sorted keys beside their rule strings. ``pack`` gives the file's bytes; ``load`` memory-maps them."""

    def __init__(self, keys: np.ndarray, texts: list[str], verdicts: list[str]):
        self.keys, self.texts, self.verdicts = keys, texts, verdicts
        self.path_lengths = sorted({len(t) - t.find("/") if "/" in t else 0 for t in texts})

    @classmethod
    def build(cls, rules: list[Rule]) -> DigestArray:
        keys = np.array([xxhash.xxh64_intdigest(r.text) for r in rules], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], [rules[i].text for i in order], [rules[i].verdict for i in order])

    @classmethod
    def load(cls, key_bytes: bytes, texts: list[str], verdicts: list[str]) -> DigestArray:
        if not key_bytes:
            return cls(np.empty(0, np.uint64), texts, verdicts)
        with tempfile.NamedTemporaryFile(suffix=".keys", delete=False) as f:
            f.write(key_bytes)
        keys = np.memmap(f.name, dtype=np.uint64, mode="r")
        os.unlink(f.name)
        return cls(keys, texts, verdicts)

    def probe(self, candidates: list[str]) -> np.ndarray:
        """Place of each candidate's rule, or -1."""
        if not candidates or not len(self.keys):
            return np.full(len(candidates), -1, dtype=np.int64)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), dtype=np.uint64, count=len(candidates))
        first = np.searchsorted(self.keys, digests)
        found = np.full(len(candidates), -1, dtype=np.int64)
        near = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == digests)
        for i in near.tolist():
            at = int(first[i])
            while at < len(self.keys) and self.keys[at] == digests[i]:
                if self.texts[at] == candidates[i]:
                    found[i] = at
                    break
                at += 1
        return found


def candidates_of(host: str, path: str, path_lengths: list[int]) -> list[str]:
    suffixes, at = ([host] if host else []), host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    prefixes = [path[:n] for n in path_lengths if n <= len(path)]
    return [s + p for s in suffixes if s for p in prefixes]


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``page_id`` of every page.

    A null url or one without ``://`` has an empty host and path, no rule and the default verdict, which
    is also the verdict of a url that is not in the digest array. Of equally long rules that fit, the one
    with the longer host wins. Urls of any length are judged whole. Repeated rows are judged one by one; other columns
    are ignored; an empty rule list gives every url the default, an empty table an empty result.
    """
    index = DigestArray.build(rules)
    if index.keys.nbytes + sum(len(t) for t in index.texts) > MAX_INDEX_BYTES:
        rows = pages.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules] or [], "verdict string, host string, path string")
        return judge_by_join(pages, rows, default)
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast((index.keys.tobytes(), index.texts, index.verdicts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = DigestArray.load(*sent.value)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            flat: list[str] = []
            owner: list[int] = []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                c = candidates_of(h, p, own.path_lengths)
                flat += c
                owner += [i] * len(c)
            rule: list[str | None] = [None] * len(hosts)
            verdict = [default] * len(hosts)
            hits = own.probe(flat)
            for j in np.flatnonzero(hits >= 0).tolist():
                i, at = owner[j], int(hits[j])
                text, best = own.texts[at], rule[i]
                if best is None or (len(text), text.find("/")) > (len(best), best.find("/")):
                    rule[i], verdict[i] = text, own.verdicts[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """As ``judge`` for rule tables of any size (``verdict, host, path``): candidates meet their rules in an equi-join.

    A host's rules say which lengths of path are worth a try, so every rule counts, however long its path. Each host and
    path is looked up once, not once per page.
    """
    texts = rules.select(F.lower("host").alias("rule_host"), "path", "verdict")
    # block sorts after allow, so that max() lets block win as parse_rules does
    texts = texts.withColumn("rule", F.concat("rule_host", "path")).groupBy("rule").agg(F.max("verdict").alias("verdict"), F.collect_set(F.struct("rule_host", F.length("path").alias("n"))).alias("at"))
    lengths = texts.select(F.inline("at")).groupBy("rule_host").agg(F.collect_set("n").alias("lengths"))
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    sites = rows.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("suffix")).where("suffix <> ''")
    tries = sites.join(lengths, sites["suffix"] == lengths["rule_host"]).select("host", "path", "suffix", F.explode("lengths").alias("n")).where("n <= length(path)")
    tries = tries.withColumn("rule", F.concat("suffix", F.expr("substring(path, 1, n)")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("suffix")))
    chosen = tries.join(texts.select("rule", "verdict"), "rule").groupBy("host", "path").agg(best.alias("b"))
    out = rows.join(chosen, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
