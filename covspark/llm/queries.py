"""The registered corpus queries and, where SQL can say it, their equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covspark.llm import langid, licences, lines, neardup, packing, pieces, quality, rtree, runs, sketches, tokenfile, topk, warc
from covspark.llm.common import bucket4, table, vocabulary_path
from covspark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@register()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those whose bucket isn't 2."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(bucket4(F.col("doc_id")) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(bucket4(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances and the verdict for every document."""
    return quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


@register()
def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text in the piece vocabulary, and what they decode to, as digests."""
    return pieces.encoded(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


@register()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=1)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@register()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from range-coded token files in id order."""
    at = shared_folder(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), at, vocabulary_path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register()
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion record of every page, by way of WARC files of the responses."""
    at = shared_folder(spark, "warc")
    warc.write(F.col("record"), warc.responses(table(spark, sf_dir, "pages")), at)
    made = warc.derive(warc.read(spark, at))
    return made.select(
        F.col("source_id").cast("long").alias("page_id"),
        "record_type",
        "record_id",
        "refers_to",
        "target_uri",
        F.col("headers")["WARC-Source-Payload-Digest"].alias("source_digest"),
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.octet_length("block").cast("long").alias("n_bytes"),
    )


@register(
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """
)
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register()
def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, from all its paragraphs."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("found")


@register()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and verdict of every line that isn't blank."""
    return lines.classify(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("line").cast("long").alias("line"), "class_id", "class_doc", F.col("class_line").cast("long").alias("class_line"), "kept"
    )


@register()
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, with the class's first document as its id."""
    return neardup.classify(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "n_links")


@register()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, and what is left when each keeps its first period."""
    return runs.digests(table(spark, sf_dir, "documents"))


@register()
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its text edited with the next one's, and how alike they are."""
    return sketches.edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register(
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
    ),
    p AS (
      SELECT anchor_id, vec_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ),
    n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS n
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 100 * s.score >= 30 * p.score AND 100 * s.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE n <= 10
    """
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score 30 to 90 percent of an anchor's positives; every seventh label is moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)
