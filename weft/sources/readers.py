"""Sources with declared schemas, and sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "node_id string, name string, description string, url string, wikidata_id string"
ERA_NODES = "node_id string, name string, era string, description string, url string"
ALIASES = "map<string, struct<label: string, aliases: array<string>>>"


def nodes_tsv(spark: SparkSession, path: str, schema: str = NODES, quoted: bool = True, escape: str = "\\") -> DataFrame:
    """A roster with a header; lines that start with # are comments."""
    return spark.read.option("sep", "\t").option("escape", escape).option("comment", "#").option("header", True).option("quote", '"' if quoted else "").schema(schema).csv(path)


def edges_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Edges without a header; a header line that starts with # is a comment like any other."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("src string, dst string").csv(path)


def weighted_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema("src string, dst string, weight long").csv(path)


def unzipped(archives: DataFrame) -> DataFrame:
    """page, text of the .txt files in zip archives (content), READMEs left out; a page's name is its URL-decoded file name."""

    def run(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".txt") and "README" not in name:
                            rows.append((unquote(name.rsplit("/", 1)[-1][:-4]), z.read(name).decode("utf-8")))
            yield pd.DataFrame(rows, columns=["page", "text"])

    return archives.select("content").mapInPandas(run, "page string, text string")


def zip_text(spark: SparkSession, path: str) -> DataFrame:
    return unzipped(spark.read.format("binaryFile").load(path))


def json_map(spark: SparkSession, path: str, schema: str = ALIASES) -> DataFrame:
    """key, value of one JSON object with dynamic keys (gzip by its extension)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schema)).alias("key", "value"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """node, label, alias: a row of each alias, one with a null alias where there is none."""
    rows = json_map(spark, path)
    return rows.select(F.col("key").alias("node"), F.col("value.label").alias("label"), F.explode_outer("value.aliases").alias("alias"))


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.option("compression", "gzip" if gzip else "none").json(path)


def document(df: DataFrame) -> DataFrame:
    """value: each row as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first where it is missing."""
    make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
