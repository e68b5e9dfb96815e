"""Rule files in, results out, and tables that are published to.

Tables are Parquet folders partitioned by what is replaced together, so a replacement is a
dynamic partition overwrite and an insert that ignores what is there is an anti-join.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import RuleSet
from ..operators.project import TopicMap


def _lower_keys(value):
    """JSON names are matched whatever the case of their first letter."""
    if isinstance(value, dict):
        return {k[:1].lower() + k[1:]: _lower_keys(v) for k, v in value.items()}
    return [_lower_keys(v) for v in value] if isinstance(value, list) else value


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].lstrip("\ufeff")


def load_json(spark: SparkSession, path: str):
    return json.loads(_read_text(spark, path))


def save_json(spark: SparkSession, value, path: str) -> None:
    """One JSON file, pretty-printed, wherever Spark's file systems reach; an older one is replaced."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(there, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def load_ruleset(spark: SparkSession, path: str) -> RuleSet:
    return RuleSet.from_json(_lower_keys(json.loads(_read_text(spark, path))))


def load_topic_map(spark: SparkSession, path: str) -> TopicMap:
    return TopicMap.from_json(json.loads(_read_text(spark, path)))


def newest(names: list[str], spec: str) -> str | None:
    """The exact id, else the newest ``spec.*``."""
    return spec if spec in names else max((n for n in names if n.startswith(f"{spec}.")), default=None)


def load_overlay(spark: SparkSession, path: str, rules: RuleSet) -> DataFrame:
    """(rule_id, reason) of an overlay that has to be for exactly this rule set and version."""
    spec = _lower_keys(json.loads(_read_text(spark, path)))
    if (spec.get("ruleSetId"), spec.get("ruleSetVersion")) != (rules.id, rules.version):
        raise ValueError(f"overlay is for {spec.get('ruleSetId')} {spec.get('ruleSetVersion')}, not {rules.id} {rules.version}")
    return spark.createDataFrame([(d["ruleId"], d.get("reason", "")) for d in spec.get("disabled", [])], "rule_id string, reason string")


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line, in column order."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def publish(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that ``df`` holds and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def insert_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys are not there yet."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(conf).exists(there):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.dropDuplicates(keys).write.mode("append").parquet(path)


def cached(wanted: DataFrame, path: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the table at ``path`` holds for the keys of ``wanted``; ``make`` makes the rows of those that it lacks, which are
    added first. Made rows carry their keys; a key may have any number of them."""
    spark = wanted.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        make(wanted.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")).write.mode("append").parquet(path)
    else:
        make(wanted).write.parquet(path)
    return spark.read.parquet(path).join(wanted.select(*keys).distinct(), keys, "left_semi")


def latest(table: DataFrame, by: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return table.groupBy(by).agg(F.max_by(F.struct(*table.columns), order).alias("r")).select("r.*")


def checked_vectors(wanted: DataFrame, vectors: DataFrame) -> DataFrame:
    """``wanted(key)`` with its vectors; a missing one stops the job with its name."""
    joined = wanted.join(vectors, "key", "left")
    return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col("key")))).otherwise(F.col("embedding")))


def sidecar(table: DataFrame, expected: str) -> DataFrame:
    """Stored facts (…, fingerprint); those of another fingerprint stop the job."""
    ok = F.assert_true(F.col("fingerprint") == expected, F.lit("facts were extracted under another schema"))
    return table.where(ok.isNull()).drop("fingerprint")
