"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, fingerprint, html, language, manifest, neardup, packing, quality, search, secret_scan, substrings, toxicity, urls
from tallyforge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where the installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.grade(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return out.select("doc_id", "grade", "severity", "p_toxic", "toxic")


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


# The rules of the query's contract.
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.parse_rules(URL_RULES))


ORACLES["op6_url_filters"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rh, rp, verdict)
), best AS (
  SELECT p.page_id, arg_max(r.rh || r.rp, length(r.rh || r.rp)) AS rule, arg_max(r.verdict, length(r.rh || r.rp)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)
"""


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digests(docs, secret_scan.fit(docs))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove(table(spark, sf_dir, "documents"))


# Each round of ``tree`` halves the nodes of a group; the groups' roots are then the leaves of one more tree, ``crown``.
# ``sums`` is crc32 bit by bit: a number is a byte to take in, -1 a shift.
ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
         list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END) AS f,
         list_transform([doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END) AS g
  FROM documents
), sums AS (
  SELECT doc_id, xor(4294967295, list_reduce(
           list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents)
), leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS grp, sha256(array_to_string(f, '')) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(array_to_string(g, '')) ELSE sha256(array_to_string(f, '')) END AS start
  FROM fields LEFT JOIN sums USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS pos FROM leaves
), tree AS (
  SELECT grp, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY grp
  UNION ALL
  SELECT grp, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM tree WHERE len(nodes) > 1
), subroots AS (
  SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS gpos FROM tree WHERE len(nodes) = 1
), crown AS (
  SELECT 0 AS level, list(subroot ORDER BY gpos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM crown WHERE len(nodes) > 1
), path AS (
  SELECT p.grp, p.pos, t.level, (p.pos >> t.level) % 2 AS side, coalesce(t.nodes[xor(p.pos >> t.level, 1) + 1], '') AS sibling
  FROM placed p JOIN tree t ON p.grp = t.grp WHERE len(t.nodes) > 1
  UNION ALL
  SELECT p.grp, p.pos, 1000 + c.level, (s.gpos >> c.level) % 2, coalesce(c.nodes[xor(s.gpos >> c.level, 1) + 1], '')
  FROM placed p JOIN subroots s ON p.grp = s.grp CROSS JOIN crown c WHERE len(c.nodes) > 1
), steps AS (
  SELECT grp, pos, list(side || sibling ORDER BY level) AS up, coalesce(string_agg(sibling, '' ORDER BY level), '') AS proof FROM path GROUP BY grp, pos
), proved AS (
  SELECT p.*, coalesce(s.proof, '') AS proof, list_reduce(list_concat([p.start], coalesce(s.up, [])), lambda a, b:
           sha256(CASE WHEN b[1] = '1' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root
  FROM placed p LEFT JOIN steps s ON p.grp = s.grp AND p.pos = s.pos
)
SELECT p.doc_id, p.leaf, r.subroot, c.nodes[1] AS root, sha256(p.proof) AS proof_sha256, p.folded_root, p.folded_root = c.nodes[1] AS verified
FROM proved p JOIN subroots r ON p.grp = r.grp CROSS JOIN crown c WHERE len(c.nodes) = 1
"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term) CROSS JOIN totals
), norms AS (
  SELECT doc_id, 100 - 75 + ((75 * n * nn) // ll) AS m FROM lengths CROSS JOIN totals
), scores AS (
  SELECT a.item_id, t.doc_id, sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score
  FROM asked a JOIN tfs t ON a.term = t.term JOIN weights w ON a.term = w.term JOIN norms m ON t.doc_id = m.doc_id
  GROUP BY a.item_id, t.doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""
