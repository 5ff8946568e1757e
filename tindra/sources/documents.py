"""JSON documents in and out, stores read through JDBC or the standard library, settings, archives."""

from __future__ import annotations

import io
import os
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def items_document(spark: SparkSession, path: str, schema: str | StructType, member: str = "items") -> DataFrame:
    """Rows of a document ``{member: [...]}``."""
    inner = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType().add(member, ArrayType(inner))
    return spark.read.schema(whole).json(path, multiLine=True).select(F.explode(member).alias("r")).select("r.*")


def array_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a document that is an array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def fenced_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an array that may stand inside Markdown code fences."""
    texts = spark.read.text(path, wholetext=True)
    bare = F.regexp_replace(F.col("value"), r"^\s*```\w*\s*|\s*```\s*$", "")
    return texts.select(F.explode(F.from_json(bare, ArrayType(StructType.fromDDL(schema)))).alias("r")).select("r.*")


def tagged_union(parts: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Union by name of tables with constants of their own."""
    return reduce(DataFrame.unionByName, [df.withColumns({k: F.lit(v) for k, v in constants.items()}) for df, constants in parts])


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Constants where a column is null or missing; the empty text stays."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table read in ranges of its key; filters and columns are pushed to the store."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def write_json_document(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    df.write.mode("overwrite").json(path)


def as_one_document(df: DataFrame, order: str) -> DataFrame:
    """One row with the whole table as a JSON array in key order; for exports of bounded size."""
    return df.select(F.struct(F.col(order).alias("_k"), F.struct(*df.columns).alias("_r")).alias("s")).agg(F.to_json(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["_r"])).alias("document"))


def export_archive(members: dict[str, DataFrame], order: str = "id") -> bytes:
    """A ZIP with a JSON document per table; for exports of bounded size, at the driver's edge."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in members.items():
            z.writestr(name, as_one_document(df, order).first()["document"])
    return out.getvalue()


def export_names(lang: str) -> tuple[str, str]:
    """Member names of an export: items and areas."""
    return ("travel_eng.json", "areas_eng.json") if lang == "ENG" else ("travel.json", "areas.json")


def settings(path: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of a file of ``name=value`` lines; blank lines and comments are skipped, quotes around
    values dropped, and what the environment has wins."""
    out: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        name, eq, value = line.strip().partition("=")
        if eq and name and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    env = os.environ if environment is None else environment
    return {k: env.get(k, v) for k, v in out.items()}
