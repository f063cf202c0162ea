"""Edges as one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "src_fqn string, src_file string, site_line int, edge_type string, dst_fqn string, dst_file string, dst_start_line int, dst_end_line int, resolution string, confidence double"


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").json(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a dump; lines that aren't objects are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
