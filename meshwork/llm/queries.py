"""The registered queries opN_<name> and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import chat, decontam, dedup, fingerprint, html, jaccard, kmeans, langid, packing, quality, sentencepiece, sharding, spelling
from meshwork.llm.common import LOWER, UPPER, id_crc, table
from meshwork.store import shared_dir


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece.encode(docs, tokenizer_path("piece_bpe_32k.model"), ids=False, digest=True)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{shared_dir(spark)}/shard-map-{hashlib.sha256(sf_dir.encode()).hexdigest()[:32]}"
    placed, _ = sharding.assign(table(spark, sf_dir, "documents"), 24, store)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs, id_crc("doc_id", 4) != 2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", (id_crc("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    return quality.fit(docs, labels, id_crc("doc_id", 3) != 1)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (id_crc("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), misspelt=199)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontam.hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sharding": op3_sharding,
    "op4_fingerprints": op4_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_chat_format": op10_chat_format,
    "op11_spelling": op11_spelling,
    "op12_clusters": op12_clusters,
    "op13_decontamination": op13_decontamination,
}

def _clusters_sql(rounds: int = kmeans.ROUNDS) -> str:
    """The rounds of ``kmeans.cluster`` unrolled, over one row a component."""
    assigned = """d{r} AS MATERIALIZED (SELECT vec_id, c, sum((v.q - m.q) * (v.q - m.q)) AS d FROM v JOIN m{r} m USING (dim) GROUP BY vec_id, c),
        a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY vec_id),"""
    moved = """m{s} AS MATERIALIZED (SELECT m.c, m.dim, coalesce((t.total - ((t.total % t.n) + t.n) % t.n) // t.n, m.q) AS q FROM m{r} m
            LEFT JOIN (SELECT c, dim, sum(q)::BIGINT AS total, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, dim) t USING (c, dim)),"""
    steps = "".join(assigned.format(r=r) + moved.format(r=r, s=r + 1) for r in range(rounds)) + assigned.format(r=rounds)
    return f"""
        WITH kept AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
                      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS dim, floor(1024 * unnest(x))::BIGINT AS q FROM kept),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept QUALIFY c < 8),
        m0 AS MATERIALIZED (SELECT c, dim, q FROM v JOIN f USING (vec_id)),
        {steps}
        s AS (SELECT c, sum(d) AS inertia FROM a{rounds} GROUP BY c),
        h AS (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY dim)) AS digest FROM m{rounds} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, s.inertia::BIGINT AS cluster_inertia, (SELECT sum(inertia)::BIGINT FROM s) AS inertia, h.digest AS centroid_sha256
        FROM a{rounds} JOIN s USING (c) JOIN h USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op12_clusters": _clusters_sql(),
    "op13_decontamination": rf"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS MATERIALIZED (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS words
            FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
        runs AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS words
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        hits AS MATERIALIZED (SELECT doc_id, item_id, k, size FROM runs JOIN windows USING (size, words)),
        hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
}
