"""Static centroids from files, guarded against other models' vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("feature_dim", T.IntegerType()),
        T.StructField("n_images", T.LongType()),
        T.StructField("extracted_at", T.StringType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
    ]
)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """Centroids of JSON files, one object each; a bad file gives a row that the guard drops."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("source", F.input_file_name())


def usable_centroids(raw: DataFrame, model: str, dim: int) -> DataFrame:
    """Rows of the model and dimension with a name; of a name the first by source counts."""
    ok = raw.where((F.trim("name") != "") & (F.col("model") == model) & (F.col("feature_dim") == dim) & (F.size("centroid") == dim))
    first = ok.groupBy("name").agg(F.min_by(F.struct(*[c for c in raw.columns if c != "name"]), "source").alias("r"))
    return first.select("name", "r.*")


def by_name(centroids: DataFrame, name: str) -> DataFrame:
    """The centroid of exactly this name, or else the first that differs in case alone."""
    hits = centroids.where(F.lower("name") == name.lower())
    return hits.orderBy((F.col("name") != name).cast("int"), "name").limit(1)
