"""An index on disk: one Parquet folder per lane and a manifest."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
MANIFEST = "version int, model_id string, dim int, lanes array<string>, folder string, number long"
LANES = ("chunks", "vectors", "postings", "doc_len", "qa", "claims")


def check_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """df; reading it fails where a vector isn't of the index's size."""
    return df.filter(F.coalesce(F.assert_true(F.size(vector) == dim, F.lit(f"a vector isn't {dim} long")).cast("boolean"), F.lit(True)))


def write_index(root: str, model_id: str, dim: int, **lanes: DataFrame) -> None:
    """Writes the given lanes into a folder of their own, then adds a row to the manifest, which makes them the index: a write that
    fails leaves the index before it as it was. Postings are sorted by term, so that a search reads few row groups."""
    spark = next(iter(lanes.values())).sparkSession
    number = time.time_ns()
    folder = f"version={number}-{uuid.uuid4().hex[:8]}"
    for name, df in lanes.items():
        if name not in LANES:
            raise ValueError(f"unknown lane {name}")
        if "embedding" in df.columns:
            df = check_vectors(df, dim)
        if name == "postings":
            df = df.repartitionByRange("term", df.columns[1]).sortWithinPartitions("term", df.columns[1])
        df.write.option("compression", "zstd").parquet(f"{root}/{folder}/lane={name}")
    manifest = spark.createDataFrame([(VERSION, model_id, dim, sorted(lanes), folder, number)], MANIFEST)
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def drop_old_versions(spark: SparkSession, root: str) -> None:
    """Removes the lanes of all but the current index; searches that still read them fail."""
    current = read_manifest(spark, root)["folder"]
    for (folder,) in spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("folder").distinct().collect():
        if folder != current:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_manifest(spark: SparkSession, root: str) -> dict:
    """The latest row of the manifest alone, without touching a lane."""
    row = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("number")).first().asDict()
    if row["version"] != VERSION:
        raise ValueError(f"index version {row['version']} isn't {VERSION}")
    return row


def read_lane(spark: SparkSession, root: str, name: str) -> DataFrame:
    known = read_manifest(spark, root)
    if name not in known["lanes"]:
        raise ValueError(f"the index has no lane {name}")
    return spark.read.parquet(f"{root}/{known['folder']}/lane={name}")
