"""Stream profile on logs with known answers."""

import pytest

from tgraph.operators import profile as pf


@pytest.fixture
def log(spark):
    def make(rows):
        data = [("r", i, int(n), float(s), None if p is None else float(p)) for i, (n, s, p) in enumerate(rows)]
        return spark.createDataFrame(data, "run string, seq bigint, num_edges bigint, elapsed double, span double")

    return make


def test_warmup_excluded_throughput(log):
    rows = [(100, 10.0, None)] * 5 + [(100, 1.0, None)] * 20
    r = pf.latency_profile(log(rows)).first()
    assert r["warmup_snapshots"] == 5 and r["snapshots_after_warmup"] == 20
    assert r["throughput_warmup_excluded"] == pytest.approx(100.0)
    assert r["insufficient_batches"] is False


def test_percentiles(log):
    rows = [(1, 0.0, None)] * 11 + [(1, (i + 1) / 1000.0, None) for i in range(100)]
    r = pf.latency_profile(log(rows), warmup_min=11, warmup_fraction=0.0).first()
    assert r["latency_p50_ms"] == pytest.approx(50.5)
    assert r["latency_p95_ms"] == pytest.approx(95.05)
    assert r["latency_p99_ms"] == pytest.approx(99.01)
    assert r["latency_p99_over_p50"] == pytest.approx(99.01 / 50.5)


def test_fractional_warmup(log):
    r = pf.latency_profile(log([(1, 0.1, None)] * 100)).first()
    assert r["warmup_snapshots"] == 10


def test_too_few(log):
    r = pf.latency_profile(log([(1, 0.1, None)] * 3)).first()
    assert r["warmup_snapshots"] == 3 and r["snapshots_after_warmup"] == 0
    assert r["throughput_warmup_excluded"] == 0.0 and r["insufficient_batches"] is True
    assert r["latency_p50_ms"] == 0.0


def test_windows(log):
    rows = [(100, 0.5, None), (100, 0.5, None), (300, 1.0, None)]
    got = pf.windowed_throughput(log(rows)).orderBy("window_id").collect()
    assert [r["edges_per_sec"] for r in got] == [200.0, 300.0]


def test_windows_keep_empty(log):
    got = pf.windowed_throughput(log([(10, 0.5, None), (20, 3.0, None)])).orderBy("window_id").collect()
    assert [r["edges_per_sec"] for r in got] == [10.0, 0.0, 0.0, 20.0]


def test_delay(log):
    rows = [(1, 1.0, 2.0)] * 5 + [(1, 2.0, 10.0), (1, 2.0, 20.0), (1, 3.0, 30.0)]
    r = pf.detection_delay(log(rows)).first()
    assert r["snapshots_with_span"] == 3
    assert r["detection_delay_mean_sec"] == pytest.approx((7 + 12 + 18) / 3)
    assert r["detection_delay_max_sec"] == 33.0
    assert r["snapshot_span_mean_sec"] == 20.0 and r["snapshot_span_max_sec"] == 30.0


def test_delay_absent_without_spans(log):
    assert pf.detection_delay(log([(1, 1.0, None)] * 30)).count() == 0
