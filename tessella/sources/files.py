"""Raw files and datasets: byte checks, line diffs, merged parts, shards, cached and derived datasets, registries."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ordering import row_index
from tessella.sources import tables

SPLITS, SOURCES = ("train", "test"), (1, 2, 3)


def load_source(spark: SparkSession, pattern: str, split: str, source: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The Parquet table of a split and source; ``pattern`` has the fields {split} and {source}. Others are refused."""
    if split not in SPLITS or source not in SOURCES:
        raise ValueError(f"split must be one of {SPLITS} and source one of {SOURCES}, not {split!r} and {source!r}")
    df = spark.read.parquet(pattern.format(split=split, source=source))
    return df.select(*columns) if columns else df


def read_all(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Several Parquet files, folders or patterns as one table; columns that some lack are null there."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    return df.select(*columns) if columns else df


def rows_with(spark: SparkSession, path: str, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``ids`` (one column): a semi-join; a few ids are pushed down to the files' statistics too."""
    wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
    df = spark.read.parquet(path)
    few = [r[0] for r in wanted.limit(11).collect()]
    if len(few) <= 10:
        df = df.where(F.col(column).isin(few))
    return df.join(wanted, column, "left_semi")


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, rows) of Parquet datasets; no column is read, the counts come from the files' footers."""
    out = None
    for name, path in sorted(paths.items()):
        row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet dataset at ``path``, which is made and written if it isn't there whole."""
    target, fs, jvm = tables.opened(spark, path + "/_SUCCESS")
    if not fs.exists(target):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the lines of text files, cut at line feeds only; ``value`` keeps the file's bytes, valid UTF-8 or not."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def byte_checks(lines: DataFrame, separator: str = "\t", fields: int | None = None) -> DataFrame:
    """By file (path): lines, those that aren't UTF-8, end with a carriage return, hold a quote or have another number of fields.

    Files are read in splits, so their size doesn't matter. A byte order mark is not part of a line: see :func:`byte_order_marks`.
    """
    raw = F.col("value").cast("binary")
    n = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(separator))) + 1
    checks = {
        "invalid_utf8": ~F.is_valid_utf8("value"), "carriage_return": F.endswith(F.hex(raw), F.lit("0D")),
        "quotes": F.contains("value", F.lit('"')), **({"wrong_fields": n != fields} if fields else {}),
    }
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), *[F.count_if(c).alias(k) for k, c in checks.items()])


def byte_order_marks(spark: SparkSession, paths: Sequence[str]) -> dict[str, bool]:
    """Whether each file begins with a UTF-8 byte order mark: three bytes are read of each."""
    out = {}
    for path in paths:
        target, fs, _ = tables.opened(spark, path)
        stream = fs.open(target)
        out[path] = [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
        stream.close()
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file: lines are numbered from 1 by the place of their split, then by their order in it."""
    read = spark.read.option("lineSep", "\n").text(path)
    placed = read.select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"))
    return row_index(placed, ["_at", "_i"], "line").select((F.col("line") + 1).alias("line"), "value")


def line_diff(spark: SparkSession, one: str, other: str) -> DataFrame:
    """(line, a, b) of the lines in which two files differ, null where one has ended."""
    a, b = (numbered_lines(spark, p).withColumnRenamed("value", c) for p, c in ((one, "a"), (other, "b")))
    return a.join(b, "line", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def merge_parts(spark: SparkSession, parts: Sequence[str], expected: int, out: str, partition_by: Sequence[str] = ()) -> int:
    """One dataset from several, removed once it is written; raises and removes nothing unless all are there with ``expected`` rows."""
    missing = [p for p in parts if not tables.exists(spark, p + "/_SUCCESS")]
    if missing:
        raise ValueError(f"parts aren't complete: {missing}")
    rows = tables.write_parquet(spark.read.parquet(*parts), out, partition_by)
    if rows != expected:
        raise ValueError(f"{out} has {rows} rows, not {expected}")
    for p in parts:
        tables.removed(spark, p)
    return rows


def write_shards(postings: DataFrame, path: str, **facts: str) -> None:
    """Postings as a dataset partitioned by country, with the document frequencies beside them and a manifest."""
    postings.write.mode("overwrite").option("compression", "zstd").partitionBy("country").parquet(f"{path}/postings")
    df = postings.groupBy("country", "gram").agg(F.count(F.lit(1)).alias("df"))
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("country").parquet(f"{path}/df")
    tables.write_manifest(postings.sparkSession, f"{path}/manifest.json", {"rows": postings.count(), **facts})


def read_shard(spark: SparkSession, path: str, country: str, ids: DataFrame | None = None) -> DataFrame:
    """A country's postings, only its partition being read; with ``ids`` (entity_id) those of some records."""
    df = spark.read.parquet(f"{path}/postings").where(F.col("country") == country)
    return df.join(ids.select("entity_id"), "entity_id", "left_semi") if ids is not None else df


def dev_sample(spark: SparkSession, sources: dict[int, str], truth: DataFrame, s1_ids: DataFrame, out: str, per_mille: int = 10) -> None:
    """A small copy that fits together: the given queries, all their matches, and a share of the other pool records (entity_id)."""
    keep = truth.join(s1_ids.select("s1_id"), "s1_id", "left_semi")
    keep.write.mode("overwrite").parquet(f"{out}/truth")
    matched = keep.where("match_id IS NOT NULL").select(F.col("match_id").alias("entity_id"), F.lit(True).alias("_m")).distinct()
    for number, path in sources.items():
        df = spark.read.parquet(path)
        if number == 1:
            part = df.join(s1_ids.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
        else:
            part = df.join(matched, "entity_id", "left").where(F.col("_m") | (F.pmod(F.xxhash64("entity_id"), F.lit(1000)) < per_mille)).drop("_m")
        part.write.mode("overwrite").parquet(f"{out}/s{number}")


def packed(spark: SparkSession, path: str, manifest: str) -> None:
    """Writes a manifest with the path, size and digest of every file below a folder, for :func:`verified`."""
    entries = [r.asDict() for r in tables.checksums(spark, path).orderBy("path").collect()]  # a row for each file
    tables.write_manifest(spark, manifest, {"files": len(entries), "total_bytes": sum(e["bytes"] for e in entries), "entries": entries})


def verified(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """(path, status) of the files below a folder against a manifest; see :func:`tables.compare_checksums`."""
    facts = tables.read_manifest(spark, manifest)
    want = spark.createDataFrame([(e["path"], e["sha256"]) for e in facts["entries"]], "path string, sha256 string")
    return tables.compare_checksums(tables.checksums(spark, path), want)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header, in a folder; an existing one is replaced."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_ids(ids: DataFrame, path: str) -> str:
    """:func:`tables.write_ids` with a digest of the sorted ids beside them; returns it."""
    tables.write_ids(ids, path)
    digest = tables.read_ids(ids.sparkSession, path).agg(F.bit_xor(F.xxhash64("s1_id")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    facts = {"ids": digest.n, "xor": f"{(digest.x or 0) & (1 << 64) - 1:016x}"}
    tables.write_manifest(ids.sparkSession, path.rstrip("/") + ".json", facts)
    return facts["xor"]


def named_ids(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A frozen list of ids by its name; an unknown name raises with those that are there."""
    target, fs, _ = tables.opened(spark, folder)
    there = sorted(s.getPath().getName() for s in fs.listStatus(target) if not s.getPath().getName().endswith(".json")) if fs.exists(target) else []
    if name not in there:
        raise ValueError(f"no list of ids {name!r} in {folder}; there are {there}")
    return tables.read_ids(spark, f"{folder}/{name}")


def newest_model(spark: SparkSession, folder: str, holding: str) -> str:
    """The folder of the last written model below ``folder`` that has a file ``holding``."""
    target, fs, _ = tables.opened(spark, folder)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(target) if tables.exists(spark, f"{s.getPath()}/{holding}")]
    if not found:
        raise ValueError(f"no model with {holding} in {folder}")
    return max(found)[1]


def run_once(spark: SparkSession, path: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The dataset that ``make`` gives for ``settings``: made anew if the manifest at ``path`` names others, else read.

    The manifest is written last, so a run that ended early is repeated.
    """
    manifest = path.rstrip("/") + ".json"
    same = tables.exists(spark, manifest) and tables.read_manifest(spark, manifest) == json.loads(json.dumps(settings))
    if not same:
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        tables.write_manifest(spark, manifest, settings)
    return spark.read.parquet(path)
