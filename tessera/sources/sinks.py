"""Sinks that never replace what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.splits import manifest_digest


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def snapshot(df: DataFrame, path: str, part: str = "split") -> DataFrame:
    """Parts below ``path`` and a manifest (part, rows, digest of the rows in any order) beside them, which is returned."""
    df.write.mode("errorifexists").partitionBy(part).parquet(f"{path}/data")
    line = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    low = F.conv(F.substring("__h", 1, 15), 16, 10).cast("decimal(38,0)")
    manifest = df.select(part, line.alias("__h")).groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.sum(low).cast("string").alias("digest_sum"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return df.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def audit(df: DataFrame, path: str, key: str, text: str) -> None:
    """Append id and hash of each row; the text itself is never written."""
    df.select(key, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("content_sha256"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def ordered_csv(df: DataFrame, ids: DataFrame, path: str, key: str, value: str) -> int:
    """One CSV file in the order of ``ids`` (key, position): a submission; every id exactly once, values finite and not negative."""
    rows = ids.join(df, key, "left")
    v = F.col(value)
    bad = rows.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)).limit(1).count() or ids.count() != rows.count()
    if bad:
        raise ValueError("values are missing, repeated, infinite or negative")
    rows.orderBy("position").select(key, value).coalesce(1).write.mode("errorifexists").csv(path, header=True)
    return rows.count()


def frozen_manifest(df: DataFrame, folder: str, columns: list[str]) -> str:
    """A CSV manifest whose name holds the beginning of its digest; its path. One with this content that is there already is left as it is."""
    digest = manifest_digest(df, columns).first()["digest"]
    path = f"{folder}/manifest-{digest[:16]}.csv"
    df.select(*columns).write.mode("ignore").csv(path, header=True)
    return path


def frozen_scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a manifest; raises if they don't have the digest that its name holds."""
    rows = spark.read.schema(schema).csv(path, header=True)
    named = path.rstrip("/").rpartition("manifest-")[2].removesuffix(".csv")
    if not manifest_digest(rows, rows.columns).first()["digest"].startswith(named):
        raise ValueError(f"{path}: rows don't have the digest of the name")
    return rows


def index(cards: DataFrame, vectors: DataFrame, path: str, key: str, owner: str, vector: str) -> DataFrame:
    """Cards by owner, vectors and a manifest of one row, which is returned: counts, dimensions, and the digest of all ids. Each vector has to have its card."""
    if vectors.join(cards, key, "left_anti").limit(1).count():
        raise ValueError("a vector has no card")
    cards.write.mode("errorifexists").partitionBy(owner).parquet(f"{path}/cards")
    vectors.write.mode("errorifexists").parquet(f"{path}/vectors")
    counted = cards.agg(F.count(F.lit(1)).alias("cards"))
    shape = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size(vector)).alias("least_dim"), F.max(F.size(vector)).alias("most_dim"))
    manifest = counted.crossJoin(shape).crossJoin(manifest_digest(cards, [key]).select("digest"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return cards.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")
