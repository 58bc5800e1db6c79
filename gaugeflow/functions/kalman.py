"""Local-level Kalman filters over many series at once.

Series lie in the columns of matrices, padded with NaN; one step of the loop advances all of them, so the cost of
Python is paid once per reading index and not per reading.
"""

from __future__ import annotations

import numpy as np


#: Least drift variance between two readings as a share of the noise: the filter never stops following its source.
LEAST_DRIFT = 0.1


def column_median(x: np.ndarray) -> np.ndarray:
    """Median of each column without NaN; NaN for columns that have nothing else."""
    s = np.sort(x, axis=0)
    n = np.sum(~np.isnan(x), axis=0)
    lo, hi = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, len(x) - 1)
    cols = np.arange(x.shape[1])
    return np.where(n > 0, (s[lo, cols] + s[hi, cols]) / 2, np.nan)


def pack(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move each column's non-NaN values to its top: (values, seconds, original row) with NaN and -1 below."""
    hole = np.isnan(values)
    order = np.argsort(hole, axis=0, kind="stable")
    packed = np.take_along_axis(values, order, axis=0)
    when = np.take_along_axis(times, order, axis=0)
    gone = np.take_along_axis(hole, order, axis=0)
    when = np.where(gone, np.nan, when)
    return packed, when, np.where(gone, -1, order)


def noise(y: np.ndarray, t: np.ndarray, quantum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(measurement variance, drift variance per second) of each packed column, from medians of differences.

    Second differences give the noise free of drift; differences over four readings give what the drift adds. The noise
    is never below half the sensor's resolution.
    """
    n = y.shape[1]
    if len(y) < 3:
        sigma = np.full(n, np.nan)
    else:
        sigma = column_median(np.abs(y[1:-1] - (y[:-2] + y[2:]) / 2)) * 1.4826 / np.sqrt(1.5)
    sigma = np.fmax(np.where(np.isnan(sigma), 0, sigma), np.fmax(quantum / 2, 1e-9))
    r = sigma**2
    if len(y) < 9:
        return r, np.full(n, 1e-9) * r
    far = (column_median(np.abs(y[4:] - y[:-4])) * 1.4826) ** 2
    span = column_median(t[4:] - t[:-4])
    span = np.where(span > 0, span, 1.0)
    drift = np.fmax(far - 2 * r, 0) / span
    return r, np.fmax(np.where(np.isnan(drift), 0, drift), LEAST_DRIFT * 4 * r / span)


def gated_filter(y: np.ndarray, t: np.ndarray, r: np.ndarray, q: np.ndarray, threshold: float, patience: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(standardised innovations, predictions, their variances) of a local-level filter that withholds flagged updates.

    A reading whose innovation exceeds the threshold doesn't move the level. After ``patience`` withheld readings in a
    row the source has changed for good: the filter starts anew at the median of the withheld readings. The start is
    the median of the first five readings.
    """
    steps, n = y.shape
    z, expected, spread = np.zeros_like(y), np.zeros_like(y), np.ones_like(y)
    level = column_median(y[: min(5, steps)])
    var = r.copy()
    last = t[0].copy()
    held = np.zeros(n, dtype=int)
    recent = np.full((patience, n), np.nan)
    for i in range(steps):
        here = ~np.isnan(y[i])
        if not here.any():
            break
        ahead = var + q * np.abs(np.where(here, t[i] - last, 0))
        s = ahead + r
        e = y[i] - level
        score = e / np.sqrt(s)
        z[i], expected[i], spread[i] = np.where(here, score, 0), level, ahead
        odd = here & (np.abs(score) > threshold)
        good = here & ~odd
        gain = ahead / s
        level = np.where(good, level + gain * e, level)
        var = np.where(good, (1 - gain) * ahead, var)
        last = np.where(good, t[i], last)
        recent[:-1] = np.where(odd, recent[1:], recent[:-1])
        recent[-1] = np.where(odd, y[i], recent[-1])
        held = np.where(odd, held + 1, np.where(here, 0, held))
        anew = held >= patience
        if anew.any():
            level = np.where(anew, np.median(recent, axis=0), level)
            var = np.where(anew, r, var)
            last = np.where(anew, t[i], last)
            held = np.where(anew, 0, held)
    return z, expected, spread


def reverse(y: np.ndarray) -> np.ndarray:
    """Packed columns back to front, again packed to the top."""
    n = np.sum(~np.isnan(y), axis=0)
    rows = n - 1 - np.arange(len(y))[:, None]
    return np.where(rows >= 0, np.take_along_axis(y, np.maximum(rows, 0), axis=0), np.nan)


def spikes(y: np.ndarray, t: np.ndarray, r: np.ndarray, q: np.ndarray, threshold: float, patience: int) -> tuple[np.ndarray, np.ndarray]:
    """(one-sided, two-sided) score of each packed reading.

    One-sided: the smaller of the standardised innovations from before and after where they agree in sign, else 0; a
    change of level agrees with one of the filters and scores 0. Two-sided: the innovation against both predictions,
    weighted by their precision, which sees a spike on a slope or beside a gap more sharply.
    """
    zf, mf, vf = gated_filter(y, t, r, q, threshold, patience)
    zb, mb, vb = (reverse_rows(x, y) for x in gated_filter(reverse(y), -reverse(t), r, q, threshold, patience))
    one = np.where(np.sign(zf) == np.sign(zb), np.minimum(np.abs(zf), np.abs(zb)), 0)
    vb = np.where(vb > 0, vb, 1)
    var = 1 / (1 / vf + 1 / vb)
    both = np.abs(y - var * (mf / vf + mb / vb)) / np.sqrt(var + r)
    return one, np.where(np.isnan(both), 0, both)


def reverse_rows(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of reversed columns in the order of ``y``."""
    n = np.sum(~np.isnan(y), axis=0)
    rows = n - 1 - np.arange(len(y))[:, None]
    return np.where(rows >= 0, np.take_along_axis(z, np.maximum(rows, 0), axis=0), 0)


def following_innovations(y: np.ndarray) -> np.ndarray:
    """Innovations of a filter without measurement noise: its gain is 1, so it follows its readings entirely.

    A sensor that stands still has no noise, and only for this filter do the innovations vanish in full at once.
    """
    e = np.full(y.shape, np.nan)
    if len(y) > 1:
        e[1:] = y[1:] - y[:-1]
    return e


def trailing_variance(e: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Mean square of the last ``width`` innovations of each column at each reading; NaN where there are fewer.

    Sums over equal values are differences of equal running sums, so a variance that vanishes is exactly 0.
    """
    square = np.where(np.isnan(e), 0.0, e * e)
    running = np.vstack([np.zeros(e.shape[1]), np.cumsum(square, axis=0)])
    at = np.arange(len(e))[:, None] + 1
    back = at - width[None, :]
    earlier = np.take_along_axis(running, np.maximum(back, 0), axis=0)
    # The first reading has no innovation.
    return np.where((back >= 1) & ~np.isnan(e), (running[1:] - earlier) / width[None, :], np.nan)


def still(y: np.ndarray, settle: int, factor: float, least: int) -> np.ndarray:
    """Which packed readings belong to a stretch over which the innovation variance vanishes for no chance.

    The test is per source. Its chance that an innovation vanishes is estimated from readings whose last ``settle``
    innovations have not all vanished, so a stuck stretch adds at most ``settle`` of them and one that is long by chance is
    no less counted; two standard errors are added. A stretch of w vanishing innovations has the chance p ** w; the longest to expect among n readings
    has log(n) / log(1 / p), and the variance is taken over ``factor`` times as many (and two more, at least ``least``).
    """
    steps, n = y.shape
    e = following_innovations(y)
    there = ~np.isnan(e)
    if steps < 2 or not n:
        return np.zeros(y.shape, dtype=bool)
    gone = trailing_variance(e, np.full(n, settle)) == 0
    risk = there.copy()
    risk[1:] &= ~gone[:-1]
    at_risk = risk.sum(axis=0)
    zeros = (risk & (e == 0)).sum(axis=0)
    chance = (zeros + 0.5) / (at_risk + 1)
    chance = np.clip(chance + 2 * np.sqrt(chance * (1 - chance) / (at_risk + 1)), 1e-3, 0.999)
    readings = np.maximum((~np.isnan(y)).sum(axis=0), 2)
    width = np.maximum(least - 1, np.ceil(factor * np.log(readings) / np.log(1 / chance) + 1)).astype(np.int64)
    over = trailing_variance(e, np.minimum(width, steps)) == 0
    over &= width[None, :] < steps
    # A window that vanishes covers the readings from the one before its first innovation on.
    mark = np.zeros((steps + 1, n), dtype=np.int64)
    i, j = np.nonzero(over)
    np.add.at(mark, (i - width[j], j), 1)
    np.add.at(mark, (i + 1, j), -1)
    return np.cumsum(mark[:-1], axis=0) > 0
