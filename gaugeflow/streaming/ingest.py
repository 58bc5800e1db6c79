"""Streaming ingest: parse, stamp, split and store, and the alert job on the same source."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.functions.columns import us
from gaugeflow.operators.alerts import ALERT_COLUMNS, COOLDOWN, THRESHOLD, ModelTag, alert_rows, last_alerts, throttle
from gaugeflow.schema import wire_schema
from gaugeflow.session import delete_path
from gaugeflow.sources.files import batch_mark, write_batch

MESSAGE = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", per_trigger: int = 50_000) -> DataFrame:
    """Messages of a topic; needs Spark's Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false"}
    return spark.readStream.format("kafka").options(**options).load()


def file_source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Messages as JSON lines in a folder, in the columns of the broker's source."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", str(files_per_trigger)).json(path)


def to_wire(records: DataFrame, key: str = "machine_id") -> DataFrame:
    """(key, value): records as the JSON text on the wire."""
    return records.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[f.name for f in wire_schema()])).alias("value"))


def parse(messages: DataFrame) -> DataFrame:
    """The record's fields with the message's lineage, raw text, ingest time and date.

    Text that is no record gives NULL in every field; a field of the wrong type is NULL alone.
    """
    data = F.from_json(F.col("value").cast("string"), wire_schema(), {"mode": "PERMISSIVE"})
    lineage = [F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.col("timestamp").alias("_kafka_ts")]
    rows = messages.select(data.alias("data"), *lineage, F.col("value").cast("string").alias("_raw_value")).select("data.*", "_topic", "_partition", "_offset", "_kafka_ts", "_raw_value")
    return rows.withColumns({"_ingest_ts": F.current_timestamp(), "event_date": F.to_date("ts")})


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, malformed): a record has a machine; malformed rows keep the raw text and lineage."""
    good = parsed.where(F.col("machine_id").isNotNull()).drop("_raw_value")
    bad = parsed.where(F.col("machine_id").isNull()).select("_raw_value", "_topic", "_partition", "_offset", "_kafka_ts", "_ingest_ts")
    return good, bad


def _trigger(interval: str | None) -> dict[str, object]:
    return {"processingTime": interval} if interval else {"availableNow": True}


def start_ingest(messages: DataFrame, bronze: str, malformed: str, checkpoint: str, interval: str | None = "5 seconds", name: str = "ingest") -> StreamingQuery:
    """Store records by date and malformed messages by the date of their ingestion.

    The batch is parsed once for both sinks, which share one checkpoint. A batch that is repeated after a failure replaces
    what it wrote. Without ``interval`` the query takes what there is and ends.
    """
    def targets(parsed: DataFrame) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
        records, rest = split_parsed(parsed)
        return {bronze: (records, ("event_date",)), malformed: (rest.withColumn("ingest_date", F.to_date("_ingest_ts")), ("ingest_date",))}

    return _each_batch(parse(messages), FanOut(targets), checkpoint, interval, name)


class FanOut:
    """Writes what ``targets`` makes of a micro-batch, each table idempotent by the batch's id.

    The batch is held between the writes, so its source is read once. Only the first batch after a start can repeat one
    from before, and only then are files of its id looked for.
    """

    def __init__(self, targets: Callable[[DataFrame], dict[str, tuple[DataFrame, tuple[str, ...]]]]) -> None:
        self._targets, self._fresh = targets, True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        repeat, self._fresh = self._fresh, False
        held = batch.persist()
        try:
            for path, (frame, partitions) in self._targets(held).items():
                write_batch(frame, path, batch_id, partitions, repeat)
        finally:
            held.unpersist()


def _each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None, name: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(name).trigger(**_trigger(interval)).start()


Scorer = Callable[[DataFrame], DataFrame]


class ModelCache:
    """The scorer in use: asked for once a batch, loaded anew when the version changes.

    ``latest`` tells the current model; ``load`` makes its scorer. Where loading fails, the one before stays in use, and
    only the first load may fail for good.
    """

    def __init__(self, latest: Callable[[], ModelTag], load: Callable[[ModelTag], Scorer]) -> None:
        self._latest, self._load = latest, load
        self._held: tuple[ModelTag, Scorer] | None = None

    def current(self) -> tuple[ModelTag, Scorer]:
        """(tag, scorer) to use now."""
        try:
            tag = self._latest()
            if self._held is None or self._held[0] != tag:
                self._held = (tag, self._load(tag))
        except Exception:
            if self._held is None:
                raise
        return self._held


def start_alerts(
    messages: DataFrame,
    model: Scorer | ModelCache,
    alerts: str,
    checkpoint: str,
    threshold: float = THRESHOLD,
    cooldown: str = COOLDOWN,
    interval: str | None = "10 seconds",
    lines: str | None = None,
    name: str = "alerts",
) -> StreamingQuery:
    """Score each micro-batch, keep the best candidate per machine, hold back within the cooldown and store.

    A scorer adds anomaly_score to the parsed records; a ModelCache may change it between batches. The last alert of each
    machine is kept beside the alerts, one row per machine, as of each batch; a repeated batch starts from the table of
    the batch before. ``lines`` gets key and JSON of the alerts too.
    """
    cache = model if isinstance(model, ModelCache) else ModelCache(ModelTag, lambda _: model)
    by_date = ("event_date",)

    def targets(found: DataFrame) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
        dated = found.withColumn("event_date", F.to_date("event_timestamp"))
        text = F.to_json(F.struct(*ALERT_COLUMNS, "alert_emitted_ts")).alias("value")
        return {alerts: (dated, by_date)} | ({lines: (dated.select(F.col("machine_id").alias("key"), text, "event_date"), by_date)} if lines else {})

    store = FanOut(targets)

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tag, scorer = cache.current()
        prior = last_before(spark, f"{alerts}_last", batch_id)
        scored = scorer(batch.where(F.col("machine_id").isNotNull()))
        new = throttle(alert_rows(scored, tag, threshold), prior, cooldown).withColumn("alert_emitted_ts", F.current_timestamp())
        store(new, batch_id)
        mine = spark.read.schema(new.schema).option("pathGlobFilter", batch_mark(batch_id) + "*").parquet(alerts)
        last_alerts(mine, prior).write.mode("overwrite").parquet(f"{alerts}_last/batch-{batch_id:012d}")
        for old in _last_tables(spark, f"{alerts}_last"):
            if old < batch_id - 1:
                delete_path(spark, f"{alerts}_last/batch-{old:012d}")

    return _each_batch(parse(messages), emit, checkpoint, interval, name)


def _last_tables(spark: SparkSession, path: str) -> list[int]:
    """Batch ids of the finished tables of last alerts."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/batch-*/_SUCCESS")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or ()
    return sorted(int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found)


def last_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The last alert of each machine before a batch; None before the first."""
    earlier = [b for b in _last_tables(spark, path) if b < batch_id]
    return spark.read.parquet(f"{path}/batch-{earlier[-1]:012d}") if earlier else None


def stop(query: StreamingQuery, seconds: float = 60) -> bool:
    """Let the running micro-batch end, then stop; whether it was idle in time. Data that waits is left for the next start."""
    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.1)
    idle = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    return idle


def stream_windows(records: DataFrame, watermark: str = "2 minutes", seconds: int = 300) -> DataFrame:
    """Tumbling windows on a stream, each emitted once the watermark has passed its end."""
    late = records.withWatermark("ts", watermark)
    return late.groupBy("machine_id", F.window("ts", f"{seconds} seconds")).agg(F.avg("vibration").alias("vibration_mean"), F.avg("motor_temp").alias("motor_temp_mean"), F.count("*").alias("record_count")).select("machine_id", us("window.start").alias("window_start_us"), us("window.end").alias("window_end_us"), "vibration_mean", "motor_temp_mean", "record_count")
