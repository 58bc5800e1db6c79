"""Batch sources and sinks on files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from gaugeflow.operators.dedup import insert_absent


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; FileNotFoundError if nothing is there, ValueError for another kind of file."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in last and not last.endswith((".parquet", ".pq")):
        raise ValueError(f"not a parquet file: {path}")
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def read_or(spark: SparkSession, path: str, otherwise: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """(the table, 'offline_parquet') if it is there, else (the other frame, 'synthetic')."""
    try:
        return read_parquet(spark, path), "offline_parquet"
    except FileNotFoundError:
        return otherwise(), "synthetic"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the schema if it can't be read."""
    try:
        return read_parquet(spark, path)
    except (FileNotFoundError, AnalysisException):
        return spark.createDataFrame([], schema)


def read_since(spark: SparkSession, path: str, time: str, bound: Any, columns: tuple[str, ...]) -> DataFrame:
    """Some columns of the rows at or after a time; filter and columns reach the scan."""
    return spark.read.parquet(path).where(F.col(time) >= F.lit(bound)).select(*columns)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("event_date",)) -> None:
    """Append, partitioned."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("event_date", "window_duration")) -> None:
    """Replace the partitions that the frame has and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def batch_mark(batch_id: int) -> str:
    """How the names of a micro-batch's files begin."""
    return f"b{batch_id:012d}-"


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ("event_date",), repeat: bool = True) -> None:
    """Append one micro-batch to a table partitioned by date; a batch that is repeated replaces what it wrote.

    The batch is written aside and its files are then moved to their partitions under names that begin with its id. With
    ``repeat`` files of that id are removed first; only the first batch after a start can be a repetition.
    """
    spark = df.sparkSession
    mark = batch_mark(batch_id)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path}/_batch-{batch_id}"
    fs.mkdirs(jvm.Path(path))
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(aside)
    deep = "/*" * len(partition_by)
    if repeat:
        for f in fs.globStatus(jvm.Path(f"{path}{deep}/{mark}*")) or ():
            fs.delete(f.getPath(), False)
    for f in fs.globStatus(jvm.Path(f"{aside}{deep}/part-*")) or ():
        home = f.getPath().getParent().toString().split(f"/_batch-{batch_id}/", 1)[1]
        fs.mkdirs(jvm.Path(f"{path}/{home}"))
        fs.rename(f.getPath(), jvm.Path(f"{path}/{home}/{mark}{f.getPath().getName()}"))
    fs.delete(jvm.Path(aside), True)


#: More dates than these are not worth a list in the scan's filter.
MAX_DATES = 1_000


def upsert_absent(spark: SparkSession, source: DataFrame, path: str, keys: tuple[str, ...] = ("machine_id", "ts"), partition_by: tuple[str, ...] = ("event_date",)) -> None:
    """Insert the rows of ``source`` whose key the stored table lacks; the first run creates it.

    Whether the table exists is tested on its own, so an error of the merge never falls through to an overwrite. Equal
    keys lie in the same partition, so of the stored table only the keys of the partitions that the source has are read.
    """
    if not path_exists(spark, path):
        source.write.partitionBy(*partition_by).parquet(path)
        return
    target = spark.read.parquet(path)
    days = [r[0] for r in source.select(partition_by[0]).distinct().limit(MAX_DATES + 1).collect()]
    kept = target if len(days) > MAX_DATES else target.where(F.col(partition_by[0]).isin([d for d in days if d is not None]) | F.col(partition_by[0]).isNull())
    insert_absent(kept, source.select(*target.columns), keys).write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_quarantine(df: DataFrame, path: str, partition_by: str = "event_date") -> None:
    """Write the quarantine of a whole run, which replaces the one before; a clean run leaves an empty table."""
    if df.isEmpty():
        df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition_by).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a whole table in place of the one before: offline features, predictions, reference snapshots."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON record per line, replacing what was there."""
    df.write.mode("overwrite").json(path)


def print_lines(df: DataFrame) -> None:
    """Every record as JSON on standard output, one partition in the driver at a time."""
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(row["j"])


def write_kafka(df: DataFrame, servers: str, topic: str, key: str = "machine_id") -> None:
    """Records as JSON keyed by machine; needs Spark's Kafka connector on the class path."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.linger.ms", "50").option("kafka.compression.type", "snappy").option(
        "kafka.enable.idempotence", "true"
    ).save()


class Sink:
    """Where records go: write() as often as wanted, then close(); also as a context manager."""

    def write(self, df: DataFrame) -> None:
        raise NotImplementedError

    def write_many(self, frames: Iterable[DataFrame]) -> None:
        """Write one frame after the other."""
        for df in frames:
            self.write(df)

    def flush(self) -> None:
        """Nothing is held back: every write is complete when it returns."""

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Sink:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class StdoutSink(Sink):
    """JSON lines on standard output."""

    def write(self, df: DataFrame) -> None:
        print_lines(df)


class FileSink(Sink):
    """JSON lines in a folder; the first write replaces what was there, later ones append."""

    def __init__(self, path: str) -> None:
        self.path, self._begun = path, False

    def write(self, df: DataFrame) -> None:
        df.write.mode("append" if self._begun else "overwrite").json(self.path)
        self._begun = True


class TableSink(Sink):
    """A parquet table partitioned by date, appended to."""

    def __init__(self, path: str, partition_by: tuple[str, ...] = ("event_date",)) -> None:
        self.path, self.partition_by = path, partition_by

    def write(self, df: DataFrame) -> None:
        append(df, self.path, self.partition_by)


class KafkaSink(Sink):
    """Messages of a topic, keyed by machine."""

    def __init__(self, servers: str, topic: str, key: str = "machine_id") -> None:
        self.args = (servers, topic, key)

    def write(self, df: DataFrame) -> None:
        write_kafka(df, *self.args)


SINKS: dict[str, Callable[..., Sink]] = {"stdout": StdoutSink, "file": FileSink, "kafka": KafkaSink, "append": TableSink}


def sink(kind: str, **options: Any) -> Sink:
    """The sink of a name with its options; ValueError for an unknown one."""
    if kind not in SINKS:
        raise ValueError(f"unknown sink: {kind}")
    return SINKS[kind](**options)


def json_summary(df: DataFrame, path: str | None = None) -> str:
    """A one-row frame as JSON, also written to a file of the driver if ``path`` is given."""
    row = df.first()
    text = json.dumps(row.asDict() if row else {}, default=str, sort_keys=True)
    if path:
        Path(path).write_text(text)
    return text
