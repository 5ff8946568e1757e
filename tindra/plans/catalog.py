"""The catalogue view: items, areas and their bridge over the synthetic tables, by arithmetic.

The statements are portable SQL, so an independent engine can build the same view for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN, LODGING = "src7", "src9"  # tags that play the hidden and the lodging tag
LEGEND_MARK = ",-þjóðsaga"

_COORDINATE = "cast(cast(floor(lat_m / 1000.0) as bigint) as string) || '.' || lpad(cast(lat_m % 1000 as string), 3, '0') || sep || '-' || cast(cast(floor(lon_m / 1000.0) as bigint) as string) || '.' || lpad(cast(lon_m % 1000 as string), 3, '0')"
ITEMS = f"""
SELECT doc_id AS id,
  CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 59 = 0 THEN '' WHEN doc_id % 37 = 0 THEN '*' || base WHEN doc_id % 41 = 0 THEN '+' || base WHEN doc_id % 10 = 3 THEN base || '{LEGEND_MARK}' ELSE base END AS name,
  CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 43 = 0 THEN 'NOLOC' WHEN doc_id % 67 = 0 THEN 'noloc' WHEN doc_id % 47 = 0 THEN 'x,y' WHEN doc_id % 61 = 0 THEN '1,2,3' ELSE {_COORDINATE} END AS gps,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN source || ';src1' ELSE source END AS tag,
  text AS story,
  CASE WHEN lang = 'en' THEN text WHEN doc_id % 3 = 0 THEN '' END AS story_eng,
  CASE WHEN lang = 'en' AND doc_id % 4 > 0 THEN base WHEN doc_id % 5 = 0 THEN '' END AS name_eng,
  'ref ' || cast(doc_id % 7 as string) AS ref, source,
  CASE WHEN doc_id % 19 > 0 THEN 'https://site.example/' || cast(doc_id as string) END AS link,
  CASE WHEN lang = 'en' THEN 'https://site.example/en/' || cast(doc_id as string) END AS link_eng,
  coalesce(cast(quality as bigint), 0) AS visibility, lang
FROM (SELECT d.*, l.quality,
        CASE WHEN d.doc_id % 11 = 0 THEN 'Place ' || cast(d.doc_id % 23 as string) ELSE left(split_part(d.text, chr(10), 1), 40) END AS base,
        64000 + ((CASE WHEN d.doc_id % 11 = 0 THEN d.doc_id % 23 ELSE d.doc_id END) * 7919) % 400 AS lat_m,
        21000 + ((CASE WHEN d.doc_id % 11 = 0 THEN d.doc_id % 23 ELSE d.doc_id END) * 104729) % 1200 AS lon_m,
        CASE WHEN d.doc_id % 2 = 0 THEN ', ' ELSE ',' END AS sep
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x
"""
AREAS = """
SELECT cast(n_nationkey as bigint) AS id, CASE WHEN n_nationkey % 9 = 4 THEN '*' || n_name ELSE n_name END AS caption, lower(n_name) AS caption_eng,
  CASE WHEN n_nationkey % 3 > 0 THEN 'About ' || n_name END AS description, CASE WHEN n_nationkey % 4 > 0 THEN 'on ' || lower(n_name) END AS description_eng,
  CASE WHEN n_nationkey % 6 = 0 THEN 'picture' END AS media,
  CASE WHEN n_nationkey % 7 = 5 THEN 'NOLOC' ELSE '64.' || cast(n_nationkey + 10 as string) || ', -21.' || cast(n_nationkey + 30 as string) END AS gps,
  cast(n_nationkey % 2 as bigint) AS visibility, cast(1000 + n_nationkey * 130 as bigint) AS radius
FROM nation
"""
BRIDGE = """
SELECT DISTINCT area_id, item_id FROM (
  SELECT doc_id % 25 AS area_id, doc_id AS item_id FROM documents WHERE doc_id % 4 > 0
  UNION ALL SELECT (doc_id * 7) % 25, doc_id FROM documents WHERE doc_id % 8 = 1) b
"""
POINTS = "SELECT c_custkey AS id, 63 + (c_custkey * 7919 % 4000) / 1000.0D AS lat, -25 + (c_custkey * 104729 % 12000) / 1000.0D AS lon FROM customer"


def _sql(spark: SparkSession, sf_dir: str, statement: str, *tables: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    named = statement
    for t in tables:
        named = named.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(named, **frames)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ITEMS, "documents", "labels")


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' id, name, name_eng and gps.  Names need the beginning of a text only, so texts are cut
    before they meet the labels."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.expr("left(split_part(text, chr(10), 1), 40)"))
    named = ITEMS.replace("FROM documents", "FROM {documents}").replace("JOIN labels", "JOIN {labels}")
    return spark.sql(named, documents=documents, labels=spark.read.parquet(f"{sf_dir}/labels.parquet")).select("id", "name", "name_eng", "gps")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, AREAS, "nation")


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, BRIDGE, "documents")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, POINTS, "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(df: DataFrame) -> DataFrame:
    """Items with materialised search columns, to be stored with them where searches are frequent."""
    from tindra.functions import text

    return df.withColumns({"name_fold": text.fold(F.col("name")), "story_fold": text.fold(F.col("story"))})
