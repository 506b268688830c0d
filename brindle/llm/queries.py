"""The queries opN_<name> with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import alignment, bpe, embeddings, fingerprints, licenses, minhash, mixing, neighbours, periodic, pii, toxicity, unigram, warc
from brindle.llm.common import shared_dir, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives to the shared folder and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or not folder.startswith("file:") else folder.replace("file:", "file://", 1)
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH rows AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
digests AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM rows),
bits AS (
    SELECT *, list_reduce(list_transform(range(40), lambda i: lpad(bin(('0x' || hex[i + 1])::INT), 4, '0')), lambda a, b: a || b) AS bits FROM digests
)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_reduce(list_transform(range(5), lambda j: (bits[i * 5 + j + 1])::INT), lambda a, b: a * 2 + b)]), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.98."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


OP3_SQL = r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id, vec_id AS seen FROM embeddings
    UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.seen = l.a
), components AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM links GROUP BY a)
SELECT vec_id, COALESCE(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode_documents(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


#: Stands for the secret that a real run reads from its own store.
PSEUDONYM_KEY = "brindle pseudonyms"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms, and how many of each kind were found."""
    done = pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY, findings=True)
    counts = [F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", "text", F.size("findings").cast("long").alias("n_found"), *counts)


def op6_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    import public_tokenizers

    return unigram.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document and the number of notices."""
    docs = table(spark, sf_dir, "documents")
    found = licenses.document_families(docs, licenses.fit(docs))
    return found.select("doc_id", F.array_join("families", ",").alias("families"), "n_notices")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a network trained on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, threshold=0.3)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH rows AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null') || '|' || COALESCE(text, '')), 1, 15))::BIGINT AS h
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
    FROM rows GROUP BY source
), weighed AS (
    SELECT source, source_size, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap FROM sources
), steps AS (
    SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER upto - cap)) / (sum(weight) OVER () - (sum(weight) OVER upto - weight)) AS level
    FROM weighed WINDOW upto AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)
), chosen AS (
    SELECT COALESCE(max(level), 0) AS level FROM steps
), targets AS (
    SELECT source, source_size, least(weight * chosen.level, cap) AS target,
           CASE WHEN source_size > 0 THEN floor(least(weight * chosen.level, cap) / source_size)::BIGINT ELSE 0 END AS passes
    FROM weighed, chosen
), summed AS (
    SELECT r.*, t.source_size, t.target, t.passes, t.target - t.passes * t.source_size AS budget,
           sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h RANGE UNBOUNDED PRECEDING) AS reached,
           sum(r.size) OVER (PARTITION BY r.source, r.h) AS own
    FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((passes + CASE WHEN reached < budget OR (reached - own < budget AND reached - budget < budget - (reached - own)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""

def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods or more in every document, of which a tenth has a repeated stretch planted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.periodic_runs(docs, least=6, times=4).withColumn("best", periodic.greatest_run(F.col("runs")))
    best = {k: F.col("best")[k] for k in ("start", "length", "period")}
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in best]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[c.alias(k) for k, c in best.items()],
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth id, by learned partitions."""
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document, and how frequent the linked pairs are."""
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.link_statistics(table(spark, sf_dir, "documents"), *paths)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_warc": op2_warc,
    "op3_embeddings": op3_embeddings,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_unigram_counts": op6_unigram_counts,
    "op7_licenses": op7_licenses,
    "op8_minhash": op8_minhash,
    "op9_toxicity": op9_toxicity,
    "op10_source_mixing": op10_source_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_neighbours": op12_neighbours,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {"op2_warc": OP2_SQL, "op3_embeddings": OP3_SQL, "op10_source_mixing": OP10_SQL}
