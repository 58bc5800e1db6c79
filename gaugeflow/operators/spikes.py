"""Implausible readings: impossible values, spikes and stuck sensors, judged by what is normal for their source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import kalman
from gaugeflow.operators.hotkeys import slice_of, slice_table, with_slices

#: The possible range of each field, inclusive; None: no bound.
RANGES: dict[str, tuple[float | None, float | None]] = {
    "vibration": (0.0, None),
    "motor_temp": (-90.0, 250.0),
    "battery_soh": (0.0, 1.0),
    "cpu_usage": (0.0, 100.0),
}
SLICE_ROWS, HALO_ROWS, BLOCK_ROWS = 2_000, 200, 150_000
GATE, ONE_SIDED, TWO_SIDED, PATIENCE = 5.0, 2.5, 6.5, 6
#: Stuck sensors: see kalman.still().
STILL_SETTLE, STILL_FACTOR, STILL_LEAST = 7, 2.2, 7

FLAGS = "machine_id string, ts_us long, field string, kind string, value double, score double"


def score_series(y: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(impossible, stuck, spike, score) of each reading; a column of y is one source and field, NaN where it has none."""
    real = ~np.isnan(y)
    impossible = real & ((y < lo) | (y > hi))
    packed, _, row = kalman.pack(y, t)
    stuck = _unpack(kalman.still(packed, STILL_SETTLE, STILL_FACTOR, STILL_LEAST), row, False)
    usual = np.where(real & ~impossible & ~stuck & np.isfinite(y), y, np.nan)
    packed, when, row = kalman.pack(usual, t)
    quantum = np.diff(np.sort(packed, axis=0), axis=0)
    quantum = np.min(np.where(quantum > 1e-9, quantum, np.inf), axis=0, initial=np.inf)
    r, q = kalman.noise(packed, when, np.where(np.isfinite(quantum), quantum, 0))
    one, both = kalman.spikes(packed, when, r, q, GATE, PATIENCE)
    spike = _unpack((one > ONE_SIDED) & (both > TWO_SIDED), row, False) | (real & np.isinf(y) & ~impossible)
    score = np.where(stuck, 0.0, _unpack(both, row, 0.0))
    return impossible, stuck, spike, score


def _unpack(packed: np.ndarray, row: np.ndarray, blank) -> np.ndarray:  # noqa: ANN001
    out = np.full(packed.shape, blank)
    i, j = np.nonzero(row >= 0)
    out[row[i, j], j] = packed[i, j]
    return out


def _score_block(block: pd.DataFrame, fields: list[str]) -> Iterator[pd.DataFrame]:
    """Score whole (source, slice) groups, those of like length together."""
    new = np.ones(len(block), dtype=bool)
    new[1:] = (block["k"].to_numpy()[1:] != block["k"].to_numpy()[:-1]) | (block["slice"].to_numpy()[1:] != block["slice"].to_numpy()[:-1])
    us = block["us"].to_numpy()
    # Copies of one message follow each other, the one that stays first.
    fresh = new.copy()
    fresh[1:] |= us[1:] != us[:-1]
    group = np.cumsum(new)[fresh] - 1
    block, us = block[fresh].reset_index(drop=True), us[fresh]
    size = np.bincount(group)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(len(block)) - start[group]
    values = block[fields].to_numpy(dtype="float64")
    core = block["core"].to_numpy()
    lo = np.array([-np.inf if RANGES[f][0] is None else RANGES[f][0] for f in fields])
    hi = np.array([np.inf if RANGES[f][1] is None else RANGES[f][1] for f in fields])
    klass = np.ceil(np.log2(np.maximum(size, 8)) * 2).astype(int)
    for c in np.unique(klass):
        members = np.flatnonzero(klass == c)
        slot = np.full(len(size), -1)
        slot[members] = np.arange(len(members))
        mine = np.flatnonzero(slot[group] >= 0)
        steps, width = int(size[members].max()), len(members)
        seconds = (us[mine] - us[start[group[mine]]]) / 1e6
        y = np.full((steps, width, len(fields)), np.nan)
        t = np.full((steps, width, len(fields)), np.nan)
        y[at[mine], slot[group[mine]]] = values[mine]
        t[at[mine], slot[group[mine]]] = seconds[:, None]
        flat = (steps, width * len(fields))
        results = score_series(y.reshape(flat), t.reshape(flat), np.tile(lo, width), np.tile(hi, width))
        impossible, stuck, spike, score = (x.reshape(y.shape)[at[mine], slot[group[mine]]] for x in results)
        hit, which = np.nonzero((impossible | stuck | spike) & core[mine][:, None])
        if not len(hit):
            continue
        rows = mine[hit]
        yield pd.DataFrame(
            {
                "machine_id": block["k"].to_numpy()[rows],
                "ts_us": us[rows],
                "field": np.array(fields, dtype=object)[which],
                "kind": np.where(impossible[hit, which], "impossible", np.where(stuck[hit, which], "stuck", "spike")),
                "value": values[rows, which],
                "score": score[hit, which],
            }
        )


def _blocks(pdfs: Iterator[pd.DataFrame], fields: list[str]) -> Iterator[pd.DataFrame]:
    """Gather whole groups from a sorted partition until there are enough rows to score at once."""
    kept: list[pd.DataFrame] = []
    rows = 0
    for pdf in pdfs:
        if not len(pdf):
            continue
        kept.append(pdf)
        rows += len(pdf)
        if rows < BLOCK_ROWS:
            continue
        whole = pd.concat(kept, ignore_index=True)
        last = (whole["k"].iloc[-1], whole["slice"].iloc[-1])
        inside = ~((whole["k"] == last[0]) & (whole["slice"] == last[1])).to_numpy()
        cut = int(inside.sum())
        if cut:
            yield from _score_block(whole[:cut].reset_index(drop=True), fields)
        kept = [whole[cut:]]
        rows = len(whole) - cut
    if rows:
        yield from _score_block(pd.concat(kept, ignore_index=True), fields)


def implausible(bronze: DataFrame, fields: tuple[str, ...] = tuple(RANGES), slice_rows: int = SLICE_ROWS, halo_rows: int = HALO_ROWS) -> DataFrame:
    """One row per message and field that is implausible for its machine.

    Each machine and field is forecast by a local-level Kalman filter from before and from after; an update whose
    standardised innovation exceeds the gate is withheld. A reading is a spike if it stands apart from both forecasts on
    the same side; a lasting change of level agrees with one of them. A sensor is stuck where the variance of the
    innovations of a following filter vanishes over a window that is chosen per source, far longer than chance explains
    there. Impossible values lie outside RANGES. Noise, drift, resolution and the chance of repeats are estimated per
    machine and field; for machines cut into slices, per slice with its halo.

    Machines above ``slice_rows`` rows are cut into slices of time that overlap by about ``halo_rows`` readings, so a hot
    machine is spread over many tasks; the halo is longer than any limit of a run, so runs are recognised on either side
    of a cut. Tasks hold one bounded block of slices at a time.

    Result: machine_id, ts_us, field, kind ('impossible', 'stuck', 'spike'), value, score (the standardised two-sided
    innovation; 0 for stuck readings).

    Defined cases: rows with NULL machine or ts are left out; NULL and NaN are no readings and don't end a run; of
    copies with the same machine and ts the one ingested last counts; infinite values count as spikes; series of fewer
    than three readings have only impossible values; an empty table gives an empty result.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    names = list(fields)
    ingest = F.unix_micros(F.col("_ingest_ts").cast("timestamp"))
    rows = bronze.where(F.col("machine_id").isNotNull() & F.col("ts").isNotNull()).select(F.col("machine_id").alias("k"), us.alias("us"), ingest.alias("ing"), F.col("_offset").alias("off"), F.col("row_id").alias("rid"), *[F.col(f).cast("double").alias(f) for f in names])
    cut = with_slices(rows, "k", slice_table(rows, "k", F.col("us"), slice_rows))
    own = slice_of(F.col("us"))
    inside = F.col("us") - F.col("_hot_lo") - own * F.col("_hot_len")
    halo = F.col("_hot_len") * halo_rows / slice_rows
    part = lambda i, core: F.struct(i.cast("int").alias("slice"), F.lit(core).alias("core"))
    before = F.when((inside < halo) & (own > 0), part(own - 1, False))
    after = F.when((F.col("_hot_len") - inside < halo) & (own < F.col("_hot_n") - 1), part(own + 1, False))
    parts = F.when(F.col("_hot_n").isNull(), F.array(part(F.lit(0), True))).otherwise(F.array_compact(F.array(part(own, True), before, after)))
    spread = cut.select("k", "us", "ing", "off", "rid", *names, F.explode(parts).alias("p")).select("k", "p.slice", "us", "ing", "off", "rid", "p.core", *names)
    order = ["k", "slice", "us", F.col("ing").desc_nulls_last(), F.col("off").desc_nulls_last(), F.col("rid").desc()]
    ready = spread.repartition("k", "slice").sortWithinPartitions(*order).select("k", "slice", "us", "core", *names)
    return ready.mapInPandas(lambda pdfs: _blocks(pdfs, names), FLAGS)


def flagged(flags: DataFrame) -> DataFrame:
    """The readings concerned."""
    return flags.select("machine_id", "ts_us", "field").distinct()
