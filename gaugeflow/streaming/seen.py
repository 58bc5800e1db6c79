"""Keyed state store of seen identifiers for messages delivered more than once.

Every delivery carries up to two identifiers: its place in the log (topic, partition, offset) and its machine and time.
The state is kept in blocks of identifiers (a range of offsets of one partition; an hour of event time in one hash
bucket), so one call of the state function settles thousands of identifiers with sorted arrays. Two deliveries that
share an identifier always meet in the same block. The state lives in RocksDB, off the heap.

A block is closed by an event-time timer once the watermark has passed everything in it, and its identifiers go to the
archive. A block of event time is known to be closed by its key alone and keeps no state; a block of offsets keeps a
marker of a few bytes for a while (``forget``). Deliveries that come to a closed block are handed out as late and looked
up in the archive instead, so an expired state costs no correctness. Whoever comes after the marker opens the block a
second time, which the output shows, and such blocks are looked up as a whole.

The clock of the watermark travels on rows of its own. Spark drops rows that are older than the watermark before a state
function with event-time timers; identifiers have no clock and are never dropped, and the rows with a clock end behind
the watermark.

Each micro-batch writes its output to a folder named by its id, which a repeated batch overwrites; offsets and state are
committed with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.session import delete_path, scratch_path

HOUR_US = 3_600_000_000
LINK, LATE, ARCHIVE, OPEN = 0, 1, 2, 3
MERGE_ROWS = 200_000
#: Identifiers that a block of event time should hold; from it follows the number of buckets of an hour.
BLOCK_IDS = 20_000
#: Offsets in a block of offsets.
BLOCK_OFFSETS = 16_384

OUTPUT = "tag int, kind string, space string, a long, b long, r1 long, i1 long, o1 long, r2 long, i2 long, o2 long"
STATE = T.StructType([T.StructField("closed", T.BooleanType()), T.StructField("until_ms", T.LongType()), T.StructField("ids", T.BinaryType())])


def identifiers(df: DataFrame, buckets: int, block_offsets: int = BLOCK_OFFSETS) -> DataFrame:
    """One row per delivery and identifier: kind 'p' (place in the log) or 'm' (machine and time).

    An identifier with a NULL part is none. Columns: kind, space, block, bucket (the state's key), a, b (the identifier
    within its space), row_id, ing, off, at_ms (when it was delivered); and one row of kind 't' per delivery with nothing
    but its time as ``clock``.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    machine = F.xxhash64("machine_id")
    place = F.struct(
        F.lit("p").alias("kind"),
        F.concat_ws("|", F.col("_topic"), F.col("_partition").cast("string")).alias("space"),
        F.floor(F.col("_offset") / block_offsets).cast("long").alias("block"),
        F.lit(0).alias("bucket"),
        F.col("_offset").alias("a"),
        F.lit(0).cast("long").alias("b"),
    )
    moment = F.struct(
        F.lit("m").alias("kind"),
        F.lit("").alias("space"),
        F.floor(us / HOUR_US).cast("long").alias("block"),
        F.pmod(F.xxhash64("machine_id", us), F.lit(buckets)).cast("int").alias("bucket"),
        us.alias("a"),
        machine.alias("b"),
    )
    tick = F.struct(F.lit("t").alias("kind"), F.lit(None).cast("string").alias("space"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    has_place = F.col("_topic").isNotNull() & F.col("_partition").isNotNull() & F.col("_offset").isNotNull()
    has_moment = F.col("machine_id").isNotNull() & F.col("ts").isNotNull()
    at = F.coalesce(F.col("_kafka_ts"), F.col("_ingest_ts")).cast("timestamp")
    ids = F.array_compact(F.array(F.when(has_place, place), F.when(has_moment, moment), F.when(at.isNotNull(), tick)))
    rows = df.select(F.explode(ids).alias("x"), "row_id", F.unix_micros(F.col("_ingest_ts").cast("timestamp")).alias("ing"), F.col("_offset").alias("off"), at.alias("at"))
    return rows.select("x.*", "row_id", "ing", "off", F.unix_millis("at").alias("at_ms"), F.when(F.col("x.kind") == "t", F.col("at")).alias("clock"))


#: NULL ranks lowest in the choice of the row that stays.
LOWEST = np.iinfo(np.int64).min


def _longs(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([pdf[c].fillna(LOWEST).to_numpy(dtype="int64") if pdf[c].isna().any() else pdf[c].to_numpy(dtype="int64") for c in ("a", "b", "row_id", "ing", "off")])


def merge_seen(seen: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers with their first delivery, links of the new deliveries that repeat one: first then repeated)."""
    both = np.concatenate([seen, new])
    order = np.lexsort((np.arange(len(both)), both[:, 1], both[:, 0]))
    ranked = both[order]
    first = np.ones(len(ranked), dtype=bool)
    first[1:] = (ranked[1:, 0] != ranked[:-1, 0]) | (ranked[1:, 1] != ranked[:-1, 1])
    heads = ranked[first]
    owner = np.cumsum(first) - 1
    again = ~first
    return heads, np.column_stack([heads[owner[again]], ranked[again][:, 2:]])


def _frame(tag: int, key: tuple, rows: np.ndarray) -> pd.DataFrame:
    n, wide = len(rows), rows.shape[1] == 8
    blank = np.full(n, LOWEST)
    cols = [rows[:, i] for i in range(5)] + ([rows[:, i] for i in range(5, 8)] if wide else [blank] * 3)
    out = pd.DataFrame(dict(zip(("a", "b", "r1", "i1", "o1", "r2", "i2", "o2"), cols, strict=True)))
    out.insert(0, "space", key[1])
    out.insert(0, "kind", key[0])
    out.insert(0, "tag", np.int32(tag))
    return out


def to_state(ids: np.ndarray) -> bytes:
    """Identifiers sorted by value as column-wise differences, compressed: neighbours differ little."""
    with np.errstate(over="ignore"):
        return zlib.compress(np.ascontiguousarray(np.diff(ids, axis=0, prepend=np.zeros((1, 5), dtype=np.int64)).T).tobytes(), 1)


def from_state(blob: bytes) -> np.ndarray:
    """The identifiers of to_state(); none for an empty state."""
    if not blob:
        return np.zeros((0, 5), dtype=np.int64)
    with np.errstate(over="ignore"):
        return np.cumsum(np.frombuffer(zlib.decompress(blob), dtype=np.int64).reshape(5, -1).T, axis=0)


def _settle(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState, forget_ms: int) -> Iterator[pd.DataFrame]:
    closed, until, blob = state.get if state.exists else (False, 0, b"")
    clock = state.getCurrentWatermarkMs()
    moments = key[0] == "m"
    hour_end = (int(key[2]) + 1) * HOUR_US // 1000
    if state.hasTimedOut:
        if closed or moments:
            state.remove()
        else:
            state.update((True, until, b""))
            state.setTimeoutTimestamp(max(until, clock) + forget_ms)
        if not closed:
            yield _frame(ARCHIVE, key, from_state(blob))
        return
    # An hour that the watermark has passed is closed for all; where it still has state, its timer fires after this batch.
    closed = closed or (moments and not state.exists and clock > hour_end)
    if not closed and not state.exists and not moments:
        yield _frame(OPEN, key, np.array([[key[2], 0, LOWEST, LOWEST, LOWEST]], dtype=np.int64))
    seen = from_state(blob)
    pending: list[np.ndarray] = []
    waiting = 0
    for pdf in pdfs:
        if not len(pdf):
            continue
        rows = _longs(pdf)
        if closed:
            yield _frame(LATE, key, rows)
            continue
        latest = pdf["at_ms"].max()
        if pd.notna(latest):
            until = max(until, int(latest))
        pending.append(rows)
        waiting += len(rows)
        if waiting >= MERGE_ROWS:
            seen, links = merge_seen(seen, np.concatenate(pending))
            pending, waiting = [], 0
            yield _frame(LINK, key, links)
    if closed:
        if state.exists:
            state.setTimeoutTimestamp(max(until, clock) + forget_ms)
        return
    if pending:
        seen, links = merge_seen(seen, np.concatenate(pending))
        yield _frame(LINK, key, links)
    if moments:
        until = hour_end
    state.update((False, until, to_state(seen)))
    state.setTimeoutTimestamp(max(until, clock) + 1)


def seen_links(deliveries: DataFrame, buckets: int, watermark: str = "6 hours", forget: str = "1 day", block_offsets: int = BLOCK_OFFSETS) -> DataFrame:
    """The stateful stream: links between deliveries of one identifier, late deliveries, archived identifiers, opened blocks."""
    forget_ms = int(span_seconds(forget) * 1000)

    def settle(key, pdfs, state):  # noqa: ANN001, ANN202
        return _settle(key, pdfs, state, forget_ms)

    return (
        identifiers(deliveries, buckets, block_offsets)
        .withWatermark("clock", watermark)
        .where(F.col("clock").isNull())
        .groupBy("kind", "space", "block", "bucket")
        .applyInPandasWithState(settle, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def span_seconds(text: str) -> float:
    """Seconds of '<n> <unit>' with second, minute, hour or day."""
    n, unit = text.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.rstrip("s")]


NEEDED = ("row_id", "machine_id", "ts", "_topic", "_partition", "_offset", "_kafka_ts", "_ingest_ts")
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def replay(stored: DataFrame, files: int, name: str = "replay") -> str:
    """A folder with the deliveries of a stored table in the order of their ingestion, for a stream to read.

    The file source takes files by the time of their change, so the files get times in their order; where a file system
    keeps none, batches mix times, which costs state but no correctness.
    """
    spark = stored.sparkSession
    path = scratch_path(spark, name)
    order = F.coalesce(F.col("_ingest_ts"), F.col("_kafka_ts"))
    stored.select(*NEEDED).repartitionByRange(files, order).write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f) for f in fs.listStatus(hadoop) if f.getPath().getName().startswith("part-"))
    newest = max((f.getModificationTime() for _, f in found), default=0)
    for i, (_, f) in enumerate(found):
        fs.setTimes(f.getPath(), newest - (len(found) - i) * 1000, -1)
    return path


def run_seen_links(spark: SparkSession, path: str, watermark: str = "6 hours", batches: int = 12, bytes_per_batch: int = 4 << 30, files_per_batch: int = 4, forget: str = "1 day", block_ids: int = BLOCK_IDS, block_offsets: int = BLOCK_OFFSETS) -> DataFrame:
    """Replay a stored table through the stream in order of ingestion; returns the stream's output table.

    There are at least ``batches`` micro-batches, and more where one would exceed ``bytes_per_batch``. The replayed copy and
    the state are deleted at the end.
    """
    stored = spark.read.parquet(path)
    size = sum(_sizes(spark, stored))
    files = max(batches, -(-size // bytes_per_batch)) * files_per_batch
    peak = stored.where(F.col("ts").isNotNull()).groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / HOUR_US).alias("h")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(8, -(-int(peak) // block_ids))
    source_path = replay(stored, files)
    out, state = scratch_path(spark, "seen"), scratch_path(spark, "seen-state")
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch_id:09d}")

    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(stored.select(*NEEDED).schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(source_path)
        query = seen_links(source, buckets, watermark, forget, block_offsets).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ran = bool(query.lastProgress)
    for gone in (source_path, state):
        delete_path(spark, gone)
    table = T._parse_datatype_string(OUTPUT)
    if not ran:
        return spark.createDataFrame([], table)
    output = spark.read.schema(table).parquet(out + "/batch=*")
    again = reopened(output)
    return output if again.isEmpty() else output.unionByName(whole_blocks(stored, again, buckets, block_offsets))


def _sizes(spark: SparkSession, stored: DataFrame) -> list[int]:
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in stored.inputFiles()]
    return [p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths]


def reopened(output: DataFrame) -> DataFrame:
    """(space, block) of the blocks of offsets that were opened more than once, as their marker had been forgotten."""
    return output.where(F.col("tag") == OPEN).groupBy("space", F.col("a").alias("block")).agg(F.count("*").alias("n")).where("n > 1").select("space", "block")


def whole_blocks(deliveries: DataFrame, blocks: DataFrame, buckets: int, block_offsets: int = BLOCK_OFFSETS) -> DataFrame:
    """Links within blocks of offsets, looked up over all deliveries: output rows of the stream."""
    own = identifiers(deliveries, buckets, block_offsets).where("kind = 'p'").join(blocks, ["space", "block"], "left_semi").select("kind", "space", "a", "b", F.struct(F.col("row_id").alias("r"), F.col("ing").alias("i"), F.col("off").alias("o")).alias("d"))
    first = own.groupBy("kind", "space", "a", "b").agg(F.min("d").alias("f"))
    lowest = lambda c: F.coalesce(F.col(c), F.lit(int(LOWEST)))
    hits = own.join(first, ["kind", "space", "a", "b"]).where("d.r <> f.r")
    return hits.select(F.lit(LINK).alias("tag"), "kind", "space", "a", "b", F.col("f.r").alias("r1"), lowest("f.i").alias("i1"), lowest("f.o").alias("o1"), F.col("d.r").alias("r2"), lowest("d.i").alias("i2"), lowest("d.o").alias("o2"))
