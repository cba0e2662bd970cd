import datetime as dt

import numpy as np

from tidemark.operators import spikes

SCHEMA = "source string, series string, day date, high double, low double, close double, adj_close double, volume double, split_factor double, known_at timestamp, count int"


def series(name="s", n=300, seed=0):
    r = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(r.normal(0, 0.015, n)))
    volume = np.round(np.exp(r.normal(11, 0.6, n)))
    return [["p", name, dt.date(2023, 1, 1) + dt.timedelta(i), float(c * 1.01), float(c * 0.99), float(c), float(c), float(v), None, dt.datetime(2024, 1, 1), 1] for i, (c, v) in enumerate(zip(close, volume))]


def found(spark, rows):
    return {(x.series, x.day, x.field, x.reason) for x in spikes.implausible(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_clean_series_have_no_faults(spark):
    assert found(spark, [r for k in range(5) for r in series(f"s{k}", seed=k)]) == set()


def test_planted_faults_and_only_those(spark):
    rows = series()
    at = lambda i: rows[i][2]
    rows[20][5] = -1.0
    rows[40][5] = rows[40][3] * 1.4
    for i in (60, 61):
        for c in (3, 4, 5):
            rows[i][c] *= 1.6
    rows[80][7] *= 80
    rows[90][7] = -5.0
    rows[110][6] *= 0.1
    for i in range(130, 137):
        rows[i][6] = rows[130][6]
    rows[150][8] = 2.0
    for r in rows[200:]:  # a real split
        r[3], r[4], r[5] = r[3] / 4, r[4] / 4, r[5] / 4
    rows[200][8] = 4.0
    got = found(spark, rows)
    want = {("s", at(20), "close", "impossible"), ("s", at(40), "close", "impossible"), ("s", at(40), "close", "spike"), ("s", at(60), "close", "spike"), ("s", at(61), "close", "spike"), ("s", at(80), "volume", "spike"), ("s", at(90), "volume", "impossible"), ("s", at(110), "adj_close", "spike"), ("s", at(150), "split_factor", "not borne out")} | {("s", at(i), "adj_close", "standstill") for i in range(131, 137)}
    assert got - {("s", at(41), "close", "spike")} == want


def test_moves_that_last_and_days_without_trading(spark):
    rows = series()
    for r in rows[100:]:
        for c in (3, 4, 5, 6):
            r[c] *= 1.5
    for i in range(200, 210):
        rows[i][3] = rows[i][4] = rows[i][5] = rows[i][6] = rows[200][5]
        rows[i][7] = 0.0
    assert {x for x in found(spark, rows) if x[3] != "spike" or 198 < (x[1] - rows[0][2]).days < 212} == set()
    assert not any((x[1] - rows[0][2]).days == 100 for x in found(spark, rows))


def test_order_repeats_nulls_and_short_series(spark):
    rows = series()
    rows[60][5] = rows[60][4] = rows[60][3] = rows[60][5] * 3
    once = found(spark, rows)
    odd = [["p", None, rows[0][2], *rows[0][3:]], ["p", "t", None, *rows[0][3:]], ["p", "u", rows[0][2], None, None, None, None, None, None, None, None], ["p", "v", rows[0][2], 1.0, 1.0, -1.0, None, None, None, None, None]]
    shuffled = found(spark, [*reversed(rows), *rows[:80], *odd])
    assert shuffled == once | {("v", rows[0][2], "close", "impossible")}
    assert found(spark, []) == set()


def walk(sigma, n=300, seed=3):
    r = np.random.default_rng(seed)
    return np.cumsum(r.normal(0, sigma, n)) + 4


def test_the_ellipsoid_decides(monkeypatch):
    """One and the same jump that is taken back is a spike where the series is quiet and none where it is wild."""
    flagged = {}
    for sigma in (0.004, 0.08):
        x = walk(sigma)
        x[150] += 0.25
        flagged[sigma] = spikes.taken_back(x, 4)
    assert flagged[0.004].nonzero()[0].tolist() == [150] and not flagged[0.08].any()
    x = walk(0.004)
    x[150] += 0.25
    ellipsoid = spikes.phase_space_outliers
    for everything in (True, False):  # with all readings outside, or none, no spike stands out
        monkeypatch.setattr(spikes, "phase_space_outliers", lambda *a: (np.full(len(a[0]), everything), ellipsoid(*a)[1]))
        assert not spikes.taken_back(x, 4).any()


def test_neighbours_of_a_spike_go_back_in():
    x = walk(0.01)
    x[100:102] += 0.5
    x[200] -= 0.4
    mask, _ = spikes.phase_space_outliers(x, 4, spikes.PRICE_WIDTH, spikes.PRICE_FLOOR)
    assert mask.nonzero()[0].tolist() == [100, 101, 200]
