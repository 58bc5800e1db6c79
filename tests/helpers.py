"""Small fixtures and comparisons."""

from datetime import UTC, datetime, timedelta

START = datetime(2026, 2, 2, tzinfo=UTC)
BRONZE = (
    "row_id long, machine_id string, ts timestamp, vibration double, motor_temp double, battery_soh double, cpu_usage double, error_code int, "
    "_topic string, _partition int, _offset long, _kafka_ts timestamp, _ingest_ts timestamp"
)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def micros(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def reading(row_id, machine="M-000001", minute=0.0, *, ts="same", kafka="same", ingest="same", offset="same", topic="t", partition=0, vib=0.5, temp=50.0, soh=0.9, cpu=30.0, err=0):
    when = at(minute) if minute is not None else None
    pick = lambda x, d: d if x == "same" else x
    stamp = pick(ts, when)
    return (row_id, machine, stamp, vib, temp, soh, cpu, err, topic, partition, pick(offset, row_id), pick(kafka, when), pick(ingest, when if when else START))


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
