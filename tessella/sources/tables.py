"""Reading and writing the engine's files: separated text, lists, manifests, checksums."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = SOURCE, quoted: bool = False) -> DataFrame:
    """A tab-separated file of strings with a header, quotes being ordinary characters unless ``quoted``; empty fields are empty, not null.

    The header must hold the schema's names in their order.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema(schema)
    reader = reader.option("escape", '"') if quoted else reader.option("quote", "")
    return reader.csv(path).na.fill("")


def with_source(df: DataFrame, number: int) -> DataFrame:
    return df.withColumn("source", F.lit(number).cast("byte"))


def read_sources(spark: SparkSession, paths: dict[int, str], columns: Sequence[str] | None = None) -> DataFrame:
    """The Parquet tables of several sources as one, with a source column; only ``columns`` are read."""
    parts = [with_source(spark.read.parquet(p).select(*columns) if columns else spark.read.parquet(p), n) for n, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def truth_long(wide: DataFrame) -> DataFrame:
    """(s1_id, match_id) from comma lists (s1_id, ids): a row for each match, one with null where there is none."""
    return wide.select("s1_id", F.explode_outer(F.split(F.nullif(F.col("ids"), F.lit("")), ",")).alias("match_id"))


def list_output(pairs: DataFrame, s1_ids: DataFrame) -> DataFrame:
    """(s1_id, ids): the sorted distinct candidates of every query as a comma list, empty where there are none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))
    return s1_ids.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("ids"))


def write_lists(lists: DataFrame, path: str, id_name: str, list_name: str) -> None:
    """A folder of tab-separated files with a header; existing ones are not overwritten."""
    out = lists.select(F.col("s1_id").alias(id_name), F.col("ids").alias(list_name))
    out.write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Writes zstd Parquet by way of the commit protocol and returns the rows that can be read back."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def opened(spark: SparkSession, path: str):
    """The path and its file system, whatever kind it is, and the JVM."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def exists(spark: SparkSession, path: str) -> bool:
    target, fs, _ = opened(spark, path)
    return fs.exists(target)


def removed(spark: SparkSession, path: str) -> None:
    target, fs, _ = opened(spark, path)
    fs.delete(target, True)


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """A JSON file beside a dataset, on whatever file system it is: written under another name, then renamed."""
    target, fs, jvm = opened(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True, indent=1).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def check_manifest(spark: SparkSession, path: str, **expected) -> None:
    """Raises unless the manifest says what is expected, as before work is resumed on other settings."""
    found = read_manifest(spark, path)
    wrong = {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v}
    if wrong:
        raise ValueError(f"{path} doesn't fit (found, expected): {wrong}")


#: Bytes up to which a file is read as one value of a row; larger ones are read as streams.
ONE_VALUE = 1 << 30


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder.

    Files of ordinary size are read by the executors; those above ONE_VALUE, which no row can hold, as streams by the driver's JVM.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= ONE_VALUE).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    found = []
    for row in files.where(F.col("length") > ONE_VALUE).select("path", "length").collect():
        target, fs, jvm = opened(spark, row.path)
        stream = fs.open(target)
        found.append((row.path, row.length, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        stream.close()
    return small.unionByName(spark.createDataFrame(found, "path string, bytes long, sha256 string")) if found else small


def compare_checksums(found: DataFrame, reference: DataFrame) -> DataFrame:
    """(path, status) of two tables of checksums: MATCH, DIFFER, MISSING or NOT IN REFERENCE."""
    r = reference.select("path", F.col("sha256").alias("want"))
    status = F.when(F.col("want").isNull(), "NOT IN REFERENCE").when(F.col("sha256").isNull(), "MISSING").when(F.col("want") == F.col("sha256"), "MATCH").otherwise("DIFFER")
    return found.join(r, "path", "full").select("path", status.alias("status"))


def write_ids(ids: DataFrame, path: str) -> None:
    """A frozen list of ids as text, sorted; refuses to overwrite."""
    ids.select(ids.columns[0]).distinct().orderBy(ids.columns[0]).write.mode("errorifexists").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("s1_id"))
