"""Queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.llm import ball_kmeans, decontamination, embeddings, fingerprints, near_copies, packing, pii, quality, secret_scan, snapshots, token_files, toxicity, warc
from tindra.llm.shared import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def _with_decision(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out("doc_id", 4, 2))
    return _with_decision(toxicity.score(docs, model), 4, 2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", "entity_kinds")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out("doc_id", 5, 0))
    return _with_decision(quality.score(docs, forest), 5, 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(table(spark, sf_dir, "documents"))
    # explode would add a filter on the array, and with it all expressions of the scan once more
    return scanned.select("doc_id", F.explode_outer("findings").alias("f")).where("f IS NOT NULL").select("doc_id", "f.*")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid", F.sha2(F.array_join("centroid", ","), 256)).withColumnRenamed("centroid", "centroid_sha256")


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round; doubles hold these integers exactly."""
    parts = ["kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)"]
    parts.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || cast(vec_id AS varchar)), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})")
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, min(struct_pack(d := cast(list_inner_product(kept.v, kept.v) - 2 * list_inner_product(kept.v, q.v) + list_inner_product(q.v, q.v) AS bigint), c := q.c)) AS near FROM kept, c{r} q GROUP BY n)")
        if r < rounds:
            mean = "list(floor(s / m) ORDER BY p)"
            parts.append(f"m{r} AS (SELECT c, {mean} AS v FROM (SELECT near.c AS c, p, sum(x) AS s, count(*) AS m FROM (SELECT near, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept JOIN a{r} USING (n)) u GROUP BY near.c, p) y GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT q.c, coalesce(m.v, q.v) AS v FROM c{r} q LEFT JOIN m{r} m ON m.c = q.c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, cast(near.c AS integer) AS cluster, near.d AS distance, cast(sum(near.d) OVER (PARTITION BY near.c) AS bigint) AS cluster_inertia, cast(sum(near.d) OVER () AS bigint) AS inertia,
      sha256(array_to_string(list_transform(q.v, lambda x: cast(x AS bigint)), ',')) AS centroid_sha256 FROM kept JOIN a{rounds} USING (n) JOIN c{rounds} q ON q.c = near.c"""


def op12_snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = snapshots.difference(docs, later_documents(docs), "doc_id", ("text", "lang", "source"))
    return found.withColumn("changed", F.array_join("changed", ","))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_next(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def later_documents(docs: DataFrame) -> DataFrame:
    """The later snapshot of op12: a fixed tenth of the rows each dropped, edited, swapped, rekeyed,
    rekeyed without source, or copied."""
    m = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    keys = F.when(m.isin(3, 4), F.array(-1 - F.col("doc_id"))).when(m == 5, F.array("doc_id", -1 - F.col("doc_id"))).otherwise(F.array("doc_id"))
    return docs.where(F.coalesce(m != 0, F.lit(True))).select(
        F.explode(keys).alias("doc_id"),
        F.when(m == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(m == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(m == 2, F.col("lang")).when(m != 4, F.col("source")).when(m.isNull(), F.col("source")).alias("source"),
    )


# CRC-32 of an ASCII text s, bit by bit
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, range(8 * length(s))), lambda c, i: xor((xor(c, if(i % 8 = 0, ascii(substr(s, i // 8 + 1, 1)), 0)) >> 1), 3988292384 * (xor(c, if(i % 8 = 0, ascii(substr(s, i // 8 + 1, 1)), 0)) & 1))))"
_SHA = "sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~'))"
SNAPSHOT_SQL = f"""WITH c AS (SELECT doc_id, text, lang, source, ({_CRC}) % 10 AS m FROM (SELECT *, cast(doc_id AS varchar) AS s FROM documents) x),
  e AS (SELECT doc_id AS k, text, lang, source FROM c),
  l AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m IS DISTINCT FROM 4 THEN source END AS source FROM c WHERE m IS DISTINCT FROM 0
        UNION ALL SELECT -1 - doc_id, text, lang, source FROM c WHERE m = 5),
  p AS (SELECT l.*, concat_ws(',', CASE WHEN l.text IS DISTINCT FROM e.text THEN 'text' END, CASE WHEN l.lang IS DISTINCT FROM e.lang THEN 'lang' END, CASE WHEN l.source IS DISTINCT FROM e.source THEN 'source' END) AS changed FROM l JOIN e ON e.k = l.k),
  a AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY k) AS r FROM e ANTI JOIN l ON e.k = l.k),
  b AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY k DESC) AS r FROM l ANTI JOIN e ON e.k = l.k)
  SELECT k AS key, k AS old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, {_SHA} AS row_sha256 FROM p
  UNION ALL SELECT coalesce(b.k, a.k), a.k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'rekey' END, '', CASE WHEN b.k IS NOT NULL THEN {_SHA.replace("(text", "(b.text").replace("(lang", "(b.lang").replace("(source", "(b.source")} END
  FROM a FULL JOIN b ON a.r = b.r AND a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source"""


def queries() -> dict[str, Query]:
    return {"op1_toxicity": op1_toxicity, "op2_decontamination": op2_decontamination, "op3_pii_surrogates": op3_pii_surrogates, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_ngram_join": op6_ngram_join, "op7_token_files": op7_token_files, "op8_secret_scan": op8_secret_scan, "op9_embedding_near_dedup": op9_embedding_near_dedup, "op10_warc": op10_warc, "op11_ball_kmeans": op11_ball_kmeans, "op12_snapshot_difference": op12_snapshot_difference, "op13_fingerprints": op13_fingerprints}


def oracle_sql() -> dict[str, str]:
    return {"op11_ball_kmeans": _kmeans_sql(), "op12_snapshot_difference": SNAPSHOT_SQL}
