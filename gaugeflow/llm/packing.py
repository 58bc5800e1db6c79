"""Filling containers of fixed capacity with documents: vector best fit under several capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import spill

#: Capacities of a container: tokens, documents, and attention tiles. Attention within documents is computed in square
#: tiles of TILE tokens, so a document of n tokens costs ceil(n / TILE) squared tiles, however short it is. A document as
#: long as a container costs 64; the 16 more leave room for short ones beside long ones.
CAPACITY, MAX_DOCS, TILE, MAX_TILES = 1024, 64, 128, 80
GROUP_PIECES = 8_192
#: Weights of tokens, documents and attention cost in the residual norm.
WEIGHTS = (1.0, 0.05, 0.05)

PLACED = "container_id long, key long, piece int, token_start long, n_tokens long, at long"


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_tiles: int = MAX_TILES, tile: int = TILE, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, start within it) of each item; sizes are 1 to capacity.

    Every bin has three residuals: tokens, documents and attention tiles. Items go, longest first, to the bin that can
    take them under every constraint and whose weighted residual norm is then least; if there is none, to a new bin.
    """
    tiles = ((sizes.astype(np.int64) + tile - 1) // tile) ** 2
    if len(sizes) and int(tiles.max()) > max_tiles:
        raise ValueError("an item costs more attention than a bin holds")
    limit = np.array([capacity, max_docs, max_tiles], dtype=float)
    w = np.array(weights) / limit
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    where, at = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    rest = np.empty((len(sizes), 3))
    open_bins = np.empty(len(sizes), dtype=np.int64)
    n_open = n_bins = 0
    least = int(sizes.min()) if len(sizes) else 0
    need = np.empty(3)
    for i in order:
        size = int(sizes[i])
        need[:] = size, 1, tiles[i]
        live = open_bins[:n_open]
        left = rest[live] - need
        fits = (left >= 0).all(axis=1)
        if fits.any():
            norm = ((left * w) ** 2).sum(axis=1)
            norm[~fits] = np.inf
            slot = int(norm.argmin())
            b = int(live[slot])
        else:
            b, slot = n_bins, n_open
            rest[b] = limit
            open_bins[n_open] = b
            n_bins += 1
            n_open += 1
        where[i], at[i] = b, capacity - rest[b, 0]
        rest[b] -= need
        if rest[b, 0] < least or rest[b, 1] < 1 or rest[b, 2] < 1:
            n_open -= 1
            open_bins[slot] = open_bins[n_open]
    return where, at


def _pack(pdfs: Iterator[pd.DataFrame], limits: tuple) -> Iterator[pd.DataFrame]:
    """Pack each group of a partition that is sorted by group."""
    kept: list[pd.DataFrame] = []

    def done(whole: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for g, part in whole.groupby("grp", sort=False):
            part = part.sort_values(["key", "piece", "token_start"], kind="stable")
            where, at = best_fit(part["n_tokens"].to_numpy(), *limits)
            yield pd.DataFrame({"container_id": (np.int64(g) << 24) + where, "key": part["key"].to_numpy(), "piece": part["piece"].to_numpy(), "token_start": part["token_start"].to_numpy(), "n_tokens": part["n_tokens"].to_numpy(), "at": at})

    for pdf in pdfs:
        if not len(pdf):
            continue
        kept.append(pdf)
        last = pdf["grp"].iloc[-1]
        if kept[0]["grp"].iloc[0] != last:
            whole = pd.concat(kept, ignore_index=True)
            open_rows = whole["grp"] == last
            yield from done(whole[~open_rows])
            kept = [whole[open_rows]]
    if kept:
        yield from done(pd.concat(kept, ignore_index=True))


def pack(lengths: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_tiles: int = MAX_TILES, tile: int = TILE, weights: tuple[float, float, float] = WEIGHTS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: container_id, key, piece, token_start, n_tokens, at (the piece's start in the container).

    Items longer than a container are cut into full containers and a rest; no other item is divided. Pieces are spread by
    hash over groups of about ``group_pieces``, each packed on its own by best_fit, so the work is linear in the input and
    only the last containers of a group stay partly empty. The groups depend on nothing but keys and counts, so a task
    that runs again gives the same containers.

    Defined cases: items of size 0 or NULL take no room and come out with container_id NULL; equal keys are packed as
    separate items; NULL keys are packed like others; an empty table gives an empty result.
    """
    items = spill(lengths.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")), "lengths")
    total = items.agg(F.sum(F.ceil(F.col("n") / capacity)).alias("p")).first()["p"] or 0
    groups = max(1, -(-int(total) // group_pieces))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))
    pieces = items.where(F.col("n") > 0).select("key", "n", F.posexplode(starts).alias("piece", "token_start"))
    pieces = pieces.select("key", "piece", "token_start", F.least(F.lit(capacity), F.col("n") - F.col("token_start")).alias("n_tokens"), F.pmod(F.xxhash64("key", "piece", "token_start"), F.lit(groups)).alias("grp"))
    # A number of partitions that is asked for is left alone by AQE, which would merge all groups of a small table into one task.
    limits = (capacity, max_docs, max_tiles, tile, weights)
    placed = pieces.repartition(groups, "grp").sortWithinPartitions("grp").mapInPandas(lambda it: _pack(it, limits), PLACED)
    none = items.where(F.col("n") <= 0).select(F.lit(None).cast("long").alias("container_id"), "key", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), F.col("n").alias("n_tokens"), F.lit(0).cast("long").alias("at"))
    return placed.unionByName(none).withColumnRenamed("key", key)
