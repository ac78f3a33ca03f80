"""Anchored windows over all tasks against the fold that takes records one by one."""

import datetime as dt

import numpy as np
import pytest

from lumenlog.operators import anchored as W
from lumenlog.operators import detectors as D

START = dt.datetime(2024, 1, 1)
SCHEMA = "source string, source_file string, line_no long, ts timestamp, level string, message string"


def log(seed: int) -> list[tuple]:
    """Sources with steady, bursting and unordered times, ties, long silences, one record alone, and one without a name."""
    rng, rows = np.random.default_rng(seed), []
    for source, n, gap in (("steady", 150, 1.0), ("bursts", 260, 0.3), ("mixed", 120, 2.0), ("alone", 1, 1.0), (None, 60, 5.0), ("silent", 40, 400.0)):
        at = np.cumsum(rng.exponential(gap, n) * np.where(rng.random(n) < 0.02, 60, 1))
        if source == "mixed":
            at = at + rng.normal(0, 8, n) * (rng.random(n) < 0.3)
        if source == "bursts":
            at = np.round(at)
        for k in range(n):
            words = "abcd"[int(rng.integers(0, 2 + 2 * (k > n // 3)))] if k % 40 < 30 else "rare"
            rows.append((source, f"{'ab'[k >= n // 2]}.log", k % (n // 2 + 1), START + dt.timedelta(seconds=float(np.round(at[k], 6))), "ERROR" if rng.random() < 0.2 + 0.5 * (k % 50 > 40) else "INFO", f"m {words} {k}"))
    return rows


def told(alerts):
    return sorted((str(r.source), r.alert_type, r.ts, r.severity, r.detector, round(r.trigger_value, 9), round(r.threshold, 9), round(r.baseline_value, 9), r.line_start, r.line_end, r.description) for r in alerts.collect())


@pytest.mark.parametrize(("seed", "fan", "windows"), [(1, 64, {}), (2, 2, {}), (3, 3, {"frequency": 5.0, "error_rate": 30.0})])
def test_spread_equals_the_fold(spark, monkeypatch, seed, fan, windows):
    monkeypatch.setattr(W, "FAN", fan)
    rows = spark.createDataFrame([*log(seed), ("steady", "a.log", 999, None, "INFO", "no time")], SCHEMA).repartition(5)
    config = D.DetectorConfig(window_seconds=10.0, windows=windows, multiplier=1.3, z_threshold=1.2, min_samples=30, disappear_windows=2, weights={"bursts": 0.3}, overrides={("frequency", "steady"): 1.1})
    fold, spread = told(D.anchored_alerts(rows, config)), told(W.spread_alerts(rows, config))
    assert spread == fold and {a[1] for a in fold} == {"frequency_spike", "error_rate_surge", "new_pattern", "pattern_disappeared"}


def test_nothing(spark):
    assert not W.spread_alerts(spark.createDataFrame([], SCHEMA)).count()
    assert not W.spread_alerts(spark.createDataFrame([("s", "f", 1, None, "INFO", "m")], SCHEMA)).count()


def test_blocks_are_maps(spark):
    """Whatever time a block is entered from, its map and its openings lead to the same exit."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        width, begin = int(rng.integers(1, 50)), 0
        times = np.unique(rng.integers(begin, begin + W.FAN * width, int(rng.integers(1, 200))))
        entry, out = W.block_steps(times, width, begin)
        for x in (W._START, *range(begin, begin + width)):
            opened = W.openings(times, width, int(x))
            at = int(np.searchsorted(entry, x))
            assert (at == len(entry) and not len(opened)) or (opened[0] == entry[at] and opened[-1] + width == out[at])
