"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, knn, language, maxent, minhash, packing, pieces, resampling, secrets, suffixes, toxicity, vectors
from .common import crc_mod, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"), shorter=suffixes.PASSAGE).drop("spans", "passages", "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = maxent.fit(docs.where(crc_mod("doc_id", 7) != 2))
    scored = maxent.score(docs, model, counts)
    return scored.withColumn("held_out", crc_mod("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_rotation_code_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(rows))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    found = language.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.array_join("lang_set", ",").alias("lang_set"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), PIECES)


def op13_walsh_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_array_repeats": op1_suffix_array_repeats,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_maxent_scores": op3_maxent_scores,
    "op4_rotation_code_duplicates": op4_rotation_code_duplicates,
    "op5_minhash_near_duplicates": op5_minhash_near_duplicates,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_language_mixture": op8_language_mixture,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_voronoi_top_k": op10_voronoi_top_k,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_piece_round_trip": op12_piece_round_trip,
    "op13_walsh_centroids": op13_walsh_centroids,
}

# SQL of the contracts that other engines can state in full.

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""

# crc32 (reflected, polynomial 0xEDB88320), eight shifts a byte.
_SHIFT = "xor({} >> 1, 3988292384 * ({} & 1))"
_BYTE = "list_reduce(list_prepend(xor({}, {}), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, i: " + _SHIFT.format("r", "r") + ")"
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), "
    "lambda k: ('0x' || substr(hex(encode(w)), 2 * k - 1, 2))::BIGINT)), lambda c, b: " + _BYTE.format("c", "b") + "), 4294967295::BIGINT)"
)

_RESAMPLING_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT {_WORDS} AS words FROM benchmark),
dw AS (SELECT row, unnest(words) AS w FROM d),
bw AS (SELECT unnest(words) AS w FROM b),
h AS MATERIALIZED (SELECT w, {_CRC32} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
sc AS (SELECT bucket, count(*) AS n FROM dw JOIN h USING (w) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS n FROM bw JOIN h USING (w) GROUP BY bucket),
al AS (SELECT (SELECT coalesce(sum(n), 0) FROM sc) AS s, (SELECT coalesce(sum(n), 0) FROM tc) AS t),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(tc.n, 0) + 1)::DOUBLE * (al.s + 10000)::DOUBLE
    / ((coalesce(sc.n, 0) + 1)::DOUBLE * (al.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket), al),
sums AS (SELECT row, sum(gain)::BIGINT AS total FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY row),
w AS (
  SELECT row, doc_id, len(words)::BIGINT AS n, CASE WHEN len(words) = 0 THEN 0
    ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END::BIGINT AS weight
  FROM d LEFT JOIN sums USING (row)),
scored AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
    + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM w),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n >= 20)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (row)
"""


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    def assigned(i: int) -> str:
        # arg_min keeps one of several minima, so the number is part of the key
        return f"""
a{i} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, min({{'distance': distance, 'cluster': cluster}}) AS best
  FROM (SELECT row, vec_id, cluster, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM v, c{i}) GROUP BY row)"""

    def moved(i: int) -> str:
        return f"""
m{i} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS c FROM (
    SELECT best.cluster AS cluster, k, sum(e[k])::BIGINT AS s, count(*) AS n
    FROM a{i - 1} JOIN v USING (row), (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2) GROUP BY cluster),
c{i} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i - 1}.c) AS c FROM c{i - 1} LEFT JOIN m{i} USING (cluster))"""

    steps = ["""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1)::INT AS cluster, e AS c FROM v QUALIFY cluster < %d)""" % k]
    for i in range(rounds + 1):
        steps += ([moved(i)] if i else []) + [assigned(i)]
    return f"""
WITH {",".join(steps)}
SELECT vec_id, best.cluster AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
  (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster
"""


#: The other contracts are tested against brute force, exact round trips or held-out accuracy.
SQL: dict[str, str] = {
    "op10_voronoi_top_k": _TOP_K_SQL,
    "op11_importance_resampling": _RESAMPLING_SQL,
    "op13_walsh_centroids": _clustering_sql(),
}
