"""One metadata.json for each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import repo_key
from codequarry.schema import SCHEMAS

_ENDPOINTS = ", api_endpoints array<struct<method:string,path:string,handler:string,framework:string,file:string,line:int>>"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories with their key and endpoints; <repo>/metadata.json and <repo>/<branch>/metadata.json."""
    df = spark.read.schema(SCHEMAS["repos"] + _ENDPOINTS).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(folder)
    return df.withColumn("key", repo_key(F.col("repo_id"), F.col("branch")))


def write(repos: DataFrame, folder: str) -> None:
    """One folder for each repository id."""
    repos.withColumn("_dir", F.col("repo_id")).write.mode("overwrite").partitionBy("_dir").json(folder)
