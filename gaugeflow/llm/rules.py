"""Ordered rule lists by incremental reduced-error pruning, exported as SQL.

A rule is a conjunction of tests ``feature >= x`` or ``feature <= x``. For one class after the other rules are grown on
two thirds of the remaining documents, each test by its information gain, and pruned from the end on the other third;
what a rule covers is then removed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CUTS = 64


@dataclass(frozen=True)
class Test:
    """One condition of a rule."""

    feature: int
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        col = x[:, self.feature]
        return col >= self.value if self.above else col <= self.value


@dataclass(frozen=True)
class Rule:
    """A class and the tests that lead to it."""

    kind: str
    tests: tuple[Test, ...] = field(default=())

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for t in self.tests:
            out &= t.holds(x)
        return out


def _cuts(col: np.ndarray) -> np.ndarray:
    values = np.unique(col)
    if len(values) < 2:
        return np.zeros(0)
    mids = (values[1:] + values[:-1]) / 2
    return mids if len(mids) <= CUTS else np.quantile(mids, np.linspace(0, 1, CUTS))


def _best_test(x: np.ndarray, pos: np.ndarray) -> Test | None:
    """The test of most information gain over documents of which pos are of the class."""
    p0, n0 = int(pos.sum()), int((~pos).sum())
    base = np.log2(p0 / (p0 + n0))
    best, gain = None, 1e-9
    for f in range(x.shape[1]):
        cuts = _cuts(x[:, f])
        if not len(cuts):
            continue
        above = x[:, f][:, None] >= cuts[None, :]
        for up, hit in ((True, above), (False, ~above)):
            p = hit[pos].sum(axis=0)
            n = hit[~pos].sum(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1)
            k = int(g.argmax())
            if g[k] > gain:
                best, gain = Test(f, up, float(cuts[k])), float(g[k])
    return best


def _grow(x: np.ndarray, pos: np.ndarray, most: int) -> tuple[Test, ...]:
    tests: list[Test] = []
    live = np.ones(len(x), dtype=bool)
    while (~pos[live]).any() and pos[live].any() and len(tests) < most:
        t = _best_test(x[live], pos[live])
        if t is None:
            break
        tests.append(t)
        live &= t.holds(x)
    return tuple(tests)


def _prune(kind: str, tests: tuple[Test, ...], x: np.ndarray, pos: np.ndarray) -> tuple[Rule, float]:
    """The rule without the last tests that pruning documents don't support, and its worth on them."""
    best, worth = Rule(kind, tests), -2.0
    for k in range(len(tests), 0, -1):
        hit = Rule(kind, tests[:k]).covers(x)
        p, n = int((hit & pos).sum()), int((hit & ~pos).sum())
        v = (p - n) / (p + n) if p + n else -1.0
        if v >= worth:
            best, worth = Rule(kind, tests[:k]), v
    return best, worth


def induce(x: np.ndarray, labels: np.ndarray, order: tuple[str, ...], seed: int = 7, most_tests: int = 4, most_rules: int = 16, least_worth: float = 0.85, least_cover: int = 6, tries: int = 6) -> list[Rule]:
    """The ordered rule list for the classes in ``order``; what no rule covers is of the remaining class.

    A class is done when ``tries`` rules in a row, each grown on another split, fall short on the pruning documents.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), dtype=bool)
    rules: list[Rule] = []
    for kind in order:
        found = failed = 0
        while found < most_rules and failed < tries:
            rows = rng.permutation(np.flatnonzero(left))
            pos = labels[rows] == kind
            if pos.sum() < 4:
                break
            fold = np.empty(len(rows), dtype=np.int64)
            for side in (pos, ~pos):
                fold[side] = np.arange(int(side.sum())) % 3
            grow, prune = rows[fold < 2], rows[fold == 2]
            tests = _grow(x[grow], labels[grow] == kind, most_tests)
            rule, worth = _prune(kind, tests, x[prune], labels[prune] == kind)
            supported = int((rule.covers(x[prune]) & (labels[prune] == kind)).sum())
            if not tests or worth < least_worth or supported < least_cover:
                failed += 1
                continue
            rules.append(rule)
            found, failed = found + 1, 0
            left &= ~rule.covers(x)
        left &= labels != kind
    return rules


def induce_best(x: np.ndarray, labels: np.ndarray, order: tuple[str, ...], default: str, seed: int = 7, lists: int = 8) -> list[Rule]:
    """Of several rule lists, each from other splits of three quarters of the rows, the one that does best on the last quarter."""
    rows = np.random.default_rng(seed).permutation(len(x))
    cut = len(x) * 3 // 4
    learn, judge = rows[:cut], rows[cut:]
    found = [induce(x[learn], labels[learn], order, seed + i) for i in range(lists)]
    return max(found, key=lambda r: float((apply(r, x[judge], default) == labels[judge]).mean()) if len(judge) else 0.0)


def apply(rules: list[Rule], x: np.ndarray, default: str) -> np.ndarray:
    """Class of each row: that of the first rule that covers it."""
    out = np.full(len(x), default, dtype=object)
    open_rows = np.ones(len(x), dtype=bool)
    for r in rules:
        hit = r.covers(x) & open_rows
        out[hit] = r.kind
        open_rows &= ~hit
    return out


def to_case(rules: list[Rule], features: tuple[str, ...], default: str) -> str:
    """The rule list as a SQL CASE expression over columns named like the features."""
    if not rules:
        return f"'{default}'"
    arms = [f"WHEN {' AND '.join(f'{features[t.feature]} {">=" if t.above else "<="} CAST({t.value!r} AS DOUBLE)' for t in r.tests)} THEN '{r.kind}'" for r in rules]
    return f"CASE {' '.join(arms)} ELSE '{default}' END"
