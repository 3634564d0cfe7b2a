"""Registered queries of the engine's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.functions.vectors import norm, unit
from gritstone.operators import chunks as C
from gritstone.operators import embed as E
from gritstone.operators import inverted_file as I
from gritstone.operators import lsh as L
from gritstone.operators import prompts as P
from gritstone.operators import report as R
from gritstone.operators import search as Q
from gritstone.operators import sections as S
from gritstone.operators import units as U
from gritstone.operators import validate as V
from gritstone.plans import jobs
from gritstone.plans.fixture import TABLE_CONFIG as CFG
from gritstone.plans.fixture import benchmark_queries, patents, table
from gritstone.sources.scratch import Scratch
from gritstone.sources.table import bucket, collection, merged, read_collection, upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LAST_UNIT = replace(CFG, overlap_strategy="last_unit")
NO_OVERLAP = replace(CFG, overlap_strategy="none")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _units(spark, d):
    return U.units(S.sections(patents(spark, d), CFG), CFG)


def _chunks(spark, d, cfg=CFG):
    return jobs.built_chunks(patents(spark, d), cfg)


def _judged(spark, d):
    return V.judged(_chunks(spark, d), CFG, counted=True)


@query
def doc_lines(spark, d):
    return S.lines(patents(spark, d))


@query
def heading_lines(spark, d):
    rows = S.lines(patents(spark, d)).where(T.is_heading(F.col("line"), CFG))
    return rows.select("patent_id", "line_no", "line", T.is_caps(F.col("line"), CFG).alias("caps"), F.col("line").rlike(r":\s*$").alias("colon"))


@query
def heading_aliases(spark, d):
    rows = S.lines(patents(spark, d)).where(T.is_heading(F.col("line"), CFG))
    return rows.select("patent_id", "line_no", T.heading_name(F.col("line")).alias("section"), T.is_alias(F.col("line")).alias("is_standard"))


@query
def doc_sections(spark, d):
    return S.sections(patents(spark, d), CFG)


@query
def section_isolation(spark, d):
    """Chunks that reach beyond their section; none are expected."""
    own = S.sections(patents(spark, d), CFG).withColumn("body_end", F.col("body_start") + F.length("body"))
    rows = _chunks(spark, d).join(own.select("patent_id", "section_idx", "body_start", "body_end"), ["patent_id", "section_idx"])
    return rows.where("start_offset < body_start or end_offset > body_end").select("chunk_id")


@query
def paragraph_units(spark, d):
    parts = S.sections(patents(spark, d), CFG).select("patent_id", "section_idx", F.posexplode(U.paragraphs(F.col("body"), CFG)).alias("p", "piece"))
    return parts.select("patent_id", "section_idx", "p", T.strip_end(F.col("piece")).alias("text"))


@query
def sentence_units(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("s", "piece"))
    return rows.select("doc_id", "s", T.strip_end(F.col("piece")).alias("text"))


@query
def fragment_units(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.fragments(F.coalesce("text", F.lit("")), CFG.max_chunk_tokens)).alias("f", "piece"))


@query
def unit_hierarchy(spark, d):
    return _units(spark, d)


@query
def token_counts(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.token_count(text).alias("token_count"), T.word_count(text).alias("word_count"))


@query
def greedy_chunks(spark, d):
    return _chunks(spark, d, NO_OVERLAP).select("chunk_id", "first_unit", "unit_count", "token_count")


@query
def overlap_last_unit(spark, d):
    return _chunks(spark, d, LAST_UNIT).select("chunk_id", "first_unit", "unit_count", "overlap_tokens", "token_count")


@query
def overlap_last_sentence(spark, d):
    return _chunks(spark, d).select("chunk_id", "first_unit", "unit_count", "overlap_tokens", "token_count")


@query
def chunk_texts(spark, d):
    return _chunks(spark, d).select("patent_id", "section", "chunk_id", "text")


@query
def chunk_indexes(spark, d):
    return V.indexed(_judged(spark, d)).select("patent_id", "chunk_id", "section_chunk_index", "document_chunk_index", "total_chunks")


@query
def chunk_sizes(spark, d):
    return _chunks(spark, d).select("chunk_id", "token_count", "word_count")


@query
def chunk_offsets(spark, d):
    return _chunks(spark, d).select("chunk_id", "start_offset", "end_offset")


@query
def ws_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", T.collapse_whitespace(F.coalesce("text", F.lit(""))).alias("text"))


@query
def heading_only(spark, d):
    """Lines of the documents as chunks of their own, by the heading-only rule."""
    rows = S.lines(patents(spark, d)).withColumn("norm", T.collapse_whitespace(F.col("line")))
    return rows.where("norm <> ''").select("patent_id", "line_no", V.is_heading_only(F.col("norm"), CFG).alias("heading_only"))


@query
def alpha_ratio(spark, d):
    ratio = F.round(T.alpha_ratio(F.coalesce("text", F.lit(""))), 6)
    return table(spark, d, "documents").select("doc_id", ratio.alias("alpha_ratio"), (ratio < CFG.low_info_threshold).alias("rejected"))


@query
def overlap_novelty(spark, d):
    return _judged(spark, d).select("chunk_id", F.round("novelty", 6).alias("novelty"), F.coalesce(F.col("novelty") < CFG.min_novelty, F.lit(False)).alias("rejected"))


@query
def novelty_in_section(spark, d):
    """Novelty against all chunks before in the section."""
    rows = V.judged(_chunks(spark, d), replace(CFG, novelty_against="section"), counted=True)
    return rows.select("chunk_id", F.round("novelty", 6).alias("novelty"), F.coalesce(F.col("novelty") < CFG.min_novelty, F.lit(False)).alias("rejected"))


@query
def min_tokens(spark, d):
    return _judged(spark, d).where(F.col("token_count") < CFG.min_chunk_tokens).select("chunk_id", "token_count")


@query
def duplicate_chunks(spark, d):
    return _judged(spark, d).where("reject_reason = 'duplicate'").select("chunk_id", "patent_id")


@query
def reject_reasons(spark, d):
    return _judged(spark, d).select("chunk_id", "reject_reason")


@query
def validation_report(spark, d):
    return V.validation_report(_judged(spark, d))


def _collection(spark, d):
    return jobs.embedded_chunks(patents(spark, d), CFG)


@query
def hash_embeddings(spark, d):
    rows = _collection(spark, d).select("chunk_id", F.posexplode("vector").alias("bucket", "weight"))
    return rows.where("weight > 0").select("chunk_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query
def unit_norms(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("dim"), F.round(norm(unit(F.col("embedding"))), 6).alias("unit_norm"))
    return rows


def _vectors(spark, d):
    """Every row as a point, and every row whose id is divisible by 20 as a query."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), rows


@query
def cosine_scores(spark, d):
    """Per query and label: points, and the least, mean and greatest cosine."""
    asked, rows = _vectors(spark, d)
    return Q.score_stats(asked, rows, "label", CFG).withColumn("mean", F.round("mean", 4))


@query
def vector_top_k(spark, d):
    asked, rows = _vectors(spark, d)
    return Q.vector_search(asked, rows, CFG)


def _label_hits(spark, d):
    asked, rows = _vectors(spark, d)
    return Q.vector_search(asked, rows, CFG).join(rows.select("id", "label"), "id")


@query
def hits_with_payload(spark, d):
    return _label_hits(spark, d).select("query_id", "id", "label", "vector_rank")


@query
def label_results(spark, d):
    """Vector hits by label: best score, best point and number of hits."""
    return _label_hits(spark, d).groupBy("query_id", "label").agg(F.max("vector_score").alias("score"), F.min_by("id", "vector_rank").alias("best_id"), F.count("*").alias("hits"))


def _index(spark, d):
    """An inverted file of all rows, and the queries of ``_vectors``."""
    asked, rows = _vectors(spark, d)
    points = rows.select(F.col("id").alias("chunk_id"), F.col("label").alias("patent_id"), "vector", F.lit(0).alias("home"))
    return asked, I.build_index(spark, points, f"{Scratch(spark, 'index').base}/index", CFG)


@query
def inverted_file_top_k(spark, d):
    """Nearest rows from as many lists a query as the index was measured to need."""
    asked, index = _index(spark, d)
    return I.approximate_search(asked, index, CFG).drop("part")


@query
def inverted_file_all_lists(spark, d):
    """The same with all lists probed, which is exact."""
    asked, index = _index(spark, d)
    return I.approximate_search(asked, index, CFG, len(index.centroids)).drop("part")


@query
def inverted_file_recall(spark, d):
    """Share of the exact hits of ``vector_top_k`` that the index finds, and the lists it looks in for that."""
    asked, index = _index(spark, d)
    exact = vector_top_k(spark, d).select("query_id", "id")
    found = I.approximate_search(asked, index, CFG).select("query_id", "id", F.lit(1).alias("hit"))
    counts = exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("hits"), F.count("hit").alias("found"))
    lists, probes = F.lit(len(index.centroids)).alias("lists"), F.lit(index.probes(CFG.index_recall)).alias("probes")
    return counts.select(lists, probes, "hits", "found", F.round(F.col("found") / F.nullif("hits", F.lit(0)), 6).alias("recall"))


def _stored(spark, d):
    """All chunks in a collection, as ingest stores them."""
    table = collection(spark, f"{Scratch(spark, 'collection').base}/table", CFG)
    table.upsert(_collection(spark, d).withColumn("bucket", bucket(CFG)))
    return table


def _pairs(spark, d):
    """Hits of every benchmark text with their chunk's payload."""
    table, asked = _stored(spark, d), benchmark_queries(spark, d)
    rows = table.rows().select(F.col("chunk_id").alias("id"), "vector", F.col("bucket").alias("part"))
    hits = Q.vector_search(E.embed(asked, CFG, "query_text", "query_vector"), rows, CFG)
    return Q.with_payload(hits, table, asked)


def _reranked(spark, d):
    return Q.rerank(_pairs(spark, d), CFG)


def _results(spark, d):
    return Q.by_patent(_reranked(spark, d))


@query
def rerank_pairs(spark, d):
    return _pairs(spark, d).select("query_id", "chunk_id", "vector_score", "vector_rank", F.length("query_text").alias("query_chars"), F.length("text").alias("text_chars"))


@query
def rerank_scores(spark, d):
    every = replace(CFG, final_top_k=CFG.vector_top_k)
    return Q.rerank(_pairs(spark, d), every).select("query_id", "chunk_id", "rerank_score")


@query
def rerank_top_k(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", "rerank_score", "rerank_rank")


@query
def patent_scores(spark, d):
    return _results(spark, d).select("query_id", "patent_id", "score")


@query
def best_chunk(spark, d):
    return _results(spark, d).select("query_id", "patent_id", F.col("best_chunk.chunk_id").alias("chunk_id"), F.col("best_chunk.rerank_score").alias("rerank_score"))


@query
def matching_chunks(spark, d):
    rows = _results(spark, d).select("query_id", "patent_id", F.posexplode("matching_chunks").alias("place", "c"))
    return rows.select("query_id", "patent_id", "place", F.col("c.chunk_id").alias("chunk_id"), F.col("c.rerank_score").alias("rerank_score"))


@query
def patent_results(spark, d):
    return _results(spark, d).select(
        "query_id", "patent_id", "score", F.size("matching_chunks").alias("chunks"), F.col("metadata.lang").alias("lang"), F.col("metadata.source").alias("source"), "patent_rank",
    )


@query
def context_blocks(spark, d):
    return P.context_blocks(_results(spark, d))


@query
def prompts(spark, d):
    return P.prompts(_results(spark, d), benchmark_queries(spark, d))


@query
def indexed_summary(spark, d):
    rows = R.indexed_summary(jobs.valid_chunks(patents(spark, d), CFG).join(patents(spark, d).select("patent_id", "metadata"), "patent_id"))
    return rows.select("patent_id", "chunks", "sections", "tokens", F.col("metadata.lang").alias("lang"), F.col("metadata.source").alias("source"))


@query
def section_breakdown(spark, d):
    return R.section_breakdown(jobs.valid_chunks(patents(spark, d), CFG))


@query
def collection_report(spark, d):
    return R.collection_report(jobs.valid_chunks(patents(spark, d), CFG))


@query
def upsert_merge(spark, d):
    """Chunks of all documents, with those of every document in English replaced by a second build without overlap."""
    old = _chunks(spark, d).select("chunk_id", "patent_id", "token_count", F.lit(1).alias("version"))
    english = patents(spark, d).where("metadata.lang = 'en'")
    new = jobs.built_chunks(english, NO_OVERLAP).select("chunk_id", "patent_id", "token_count", F.lit(2).alias("version"))
    return merged(old, new)


@query
def collection_upsert(spark, d):
    """The same two builds through the collection table: written in buckets, upserted, and read back."""
    old = _chunks(spark, d).select("chunk_id", "patent_id", "token_count", F.lit(1).alias("version"))
    english = patents(spark, d).where("metadata.lang = 'en'")
    new = jobs.built_chunks(english, NO_OVERLAP).select("chunk_id", "patent_id", "token_count", F.lit(2).alias("version"))
    path = f"{Scratch(spark, 'collection').base}/table"
    upsert(spark, old, path, CFG)
    upsert(spark, new, path, CFG)
    return read_collection(spark, path)


@query
def document_metadata_join(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


@query
def lsh_candidates(spark, d):
    """Approximate neighbours within distance 1.3 by random projections, for every row whose id is divisible by 20."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=1.5, numHashTables=4, seed=11).fit(rows)
    hashes = F.array(*[vector_to_array(F.get("hashes", F.lit(i)))[0] for i in range(model.getNumHashTables())])
    # a row once, as in Spark's join; dealt out by number, for the pairs of a few MB of rows are work for all tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = model.transform(rows).select(F.col("vec_id").alias("id"), vector_to_array("v").alias("vector"), hashes.alias("hashes")).repartition(parts, "id").distinct()
    found = L.hashed_pairs(hashed.where("id % 20 = 0").withColumnRenamed("id", "query_id"), hashed, 1.3, CFG)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance")).where("query_id <> vec_id")
