"""Group tests against plain formulas and known values; trace operators against plain loops, in chunks of any size."""

import math
from statistics import mean, stdev, variance

import numpy as np
import pytest

from fluoroframe.operators import statistics, traces
from fluoroframe.plans import ranks

ROWS = "sample string, grp string, v double, test string, u int"


def objects(spark, data):
    """group -> list of samples, each a list of values."""
    rows = [(f"{g}{i}", g, None if x is None else float(x), "x", 1) for g, samples in data.items() for i, s in enumerate(samples) for x in s]
    return spark.createDataFrame(rows, ROWS)


A, B, C = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8], [30.0, 30.0, 28.0, 21.0]


def singles(**groups):
    return {g: [[x] for x in v] for g, v in groups.items()}


def one(spark, data, test, **more):
    return statistics.compare_groups(objects(spark, data), "v", "grp", "sample", test, **more)[0].collect()


def test_chances_have_known_values():
    # table values of the t, F, chi-squared and normal distributions
    assert statistics._chance("ttest", 2.228138852, 10, None) == pytest.approx(0.05, abs=1e-8)
    assert statistics._chance("ttest", -1.0, 1, None) == pytest.approx(0.5, abs=1e-12)
    assert statistics._chance("anova", 4.256494729, 2, 9) == pytest.approx(0.05, abs=1e-8)
    assert statistics._chance("kruskal", 5.991464547, 2, None) == pytest.approx(0.05, abs=1e-9)
    assert statistics._chance("kruskal", 118.4980038, 90, None) == pytest.approx(0.0237, abs=3e-4)
    assert statistics._chance("mannwhitney", 1.959963985, None, None) == pytest.approx(0.05, abs=1e-9)
    assert statistics._chance("kruskal", 0.0, 3, None) == 1.0 and statistics._chance("ttest", 0.0, 5, None) == 1.0


def test_welch(spark):
    (r,) = one(spark, singles(a=A, b=B), "auto")
    sa, sb = variance(A) / len(A), variance(B) / len(B)
    assert r.test == "ttest" and r.statistic == pytest.approx((mean(A) - mean(B)) / math.sqrt(sa + sb))
    assert r.df1 == pytest.approx((sa + sb) ** 2 / (sa**2 / (len(A) - 1) + sb**2 / (len(B) - 1)))
    assert 0.1 < r.p_value < 0.3


def midranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_ranks_with_ties(spark):
    every = A + B + C
    rank = midranks(every)
    cut = [rank[: len(A)], rank[len(A) : len(A) + len(B)], rank[len(A) + len(B) :]]
    n = len(every)
    ties = sum(every.count(v) ** 3 - every.count(v) for v in set(every))
    (r,) = one(spark, singles(a=A, b=B, c=C), "kruskal")
    h = (12 / (n * (n + 1)) * sum(sum(c) ** 2 / len(c) for c in cut) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert r.statistic == pytest.approx(h) and r.df1 == 2 and r.p_value == pytest.approx(math.exp(-h / 2))
    (r,) = one(spark, singles(a=A, b=B), "mannwhitney")
    assert r.u == sum((x > y) + 0.5 * (x == y) for x in A for y in B)


def test_variance_between_groups(spark):
    (r,) = one(spark, singles(a=A, b=B, c=C), "auto")
    every = A + B + C
    between = sum(len(g) * (mean(g) - mean(every)) ** 2 for g in (A, B, C)) / 2
    within = sum(sum((x - mean(g)) ** 2 for x in g) for g in (A, B, C)) / (len(every) - 3)
    assert r.test == "anova" and r.statistic == pytest.approx(between / within) and (r.df1, r.df2) == (2, len(every) - 3)


def test_samples_stand_for_their_objects(spark):
    data = {"a": [[1, 2, 3], [5, None, float("nan")], [4, 4]], "b": [[7], [8, 10]]}
    result, groups = statistics.compare_groups(objects(spark, data), "v", "grp", "sample", "ttest")
    (r,) = result.collect()
    assert (r.n_samples, r.n_objects) == (5, 9) and r.statistic == pytest.approx((11 / 3 - 8) / math.sqrt(variance([2, 5, 4]) / 3 + variance([7, 9]) / 2))
    assert {g.grp: (g.n_samples, g.n_objects) for g in groups.collect()} == {"a": (3, 6), "b": (2, 3)}
    pooled, _ = statistics.compare_groups(objects(spark, data), "v", "grp", None, "ttest", "object")
    assert pooled.first().n_samples == 9


def test_odd_groups(spark):
    assert one(spark, {"a": [[1], [1]], "b": [[1], [1]]}, "ttest")[0].statistic is None
    assert one(spark, {"a": [[1]], "b": [[2]]}, "ttest")[0].p_value is None
    with pytest.raises(Exception, match="two groups"):
        one(spark, singles(a=A, b=B, c=C), "mannwhitney")
    with pytest.raises(ValueError):
        one(spark, singles(a=A), "anova2")
    empty = objects(spark, singles(a=A)).where("false")
    assert statistics.compare_groups(empty, "v", "grp", "sample", "anova")[0].count() == 0
    both = objects(spark, singles(a=A, b=B)).withColumnRenamed("test", "dish")
    more = both.unionByName(both.selectExpr("sample", "grp", "-v AS v", "CAST(NULL AS string) AS dish", "u"))
    got = {r.dish: r.u for r in statistics.compare_groups(more, "v", "grp", "sample", "mannwhitney", by=["dish"])[0].collect()}
    assert got[None] == len(A) * len(B) - got["x"]


def test_running_totals_of_one_key(spark):
    rng = np.random.default_rng(1)
    values = sorted(set(rng.normal(size=500).tolist()))
    rows = spark.createDataFrame([(None, v, int(i % 7)) for i, v in enumerate(values)], "k string, v double, n long").repartition(9)
    got = {r.v: r.upto for r in ranks.running_totals(rows, ["k"], "v", "n", "upto").collect()}
    assert [got[v] for v in values] == np.cumsum([i % 7 for i in range(len(values))]).tolist()


# Traces


def course(spark):
    rng = np.random.default_rng(2)
    rows = []
    for label in range(4):
        for i in range(40):
            v = 5 + 3 * math.exp(-((i - 15 - label) ** 2) / 20) + 0.1 * float(rng.normal())
            rows.append(("a", "g", label, i, i * 0.5, v, "s"))
    rows += [("a", "g", 9, i, i * 0.5, 0.0, "s") for i in range(12)] + [(None, None, 10, 0, 0.0, None, "s"), (None, None, 10, 30, 15.0, float("nan"), "s")]
    rows += [("a", "g", 11, i, i * 0.5, 2.0 if i < 20 else 6.0, "s") for i in (12, 13, 20, 21, 30)] + [("a", "g", 11, 13, 6.5, 4.0, "s")]
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "image_id string, image_layer string, label int, time_index int, time_s double, mean_intensity double, sample_name string"), rows


def test_normalization_methods(spark):
    table, rows = course(spark)
    for method in traces.METHODS:
        got = traces.normalize_timecourse(table, method=method, baseline=(0, 9)).collect()
        assert len(got) == len(rows)
        for r in got:
            mine = [x[5] for x in rows if x[2] == r.label and x[5] is not None and not math.isnan(x[5])]
            first = [x[5] for x in rows if x[2] == r.label and x[3] <= 9 and x[5] is not None and not math.isnan(x[5])]
            new, v = r[f"mean_intensity_{method}"], r.mean_intensity
            if v is None or math.isnan(v):
                assert new is None
            elif method == "raw":
                assert new == v
            elif method == "minmax":
                assert (new is None and r.baseline_status == "zero") if min(mine) == max(mine) else new == pytest.approx((v - min(mine)) / (max(mine) - min(mine)))
            elif not first:
                assert new is None and r.baseline_status == "missing" and r.baseline_frames == 0
            elif r.label == 9 and method != "baseline_subtract":
                assert new is None and r.baseline_status == "zero"
            else:
                f0 = mean(first)
                want = {"baseline_subtract": v - f0, "f_over_f0": v / (f0 or 1), "delta_f_over_f0": (v - f0) / (f0 or 1), "zscore": (v - f0) / ((len(first) > 1 and stdev(first)) or 1)}[method]
                assert new == pytest.approx(want)
    with pytest.raises(ValueError):
        traces.normalize_timecourse(table, method="f_over_f0")


@pytest.mark.parametrize("chunk", [4096, 7, 1])
def test_features_in_chunks_of_any_length(spark, monkeypatch, chunk):
    monkeypatch.setattr(traces, "CHUNK", chunk)
    table, rows = course(spark)
    got = {r.label: r for r in traces.timecourse_features(table, baseline_window=(0, 4.5), response_window=(5, 19), keep=["sample_name"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 9, 10, 11] and got[0].sample_name == "s"
    assert got[10].peak is None and got[10].n_frames == 0
    for label in (0, 1, 2, 3, 9, 11):
        times = {}
        for x in rows:
            if x[2] == label:
                times.setdefault(x[4], []).append(x[5])
        points = sorted((t, mean(v)) for t, v in times.items())
        base = [v for t, v in points if t <= 4.5]
        f0 = mean(base) if base else 0.0
        level = f0 + 2 * stdev(base) if len(base) > 1 else None
        inside = [(t, v) for t, v in points if 5 <= t <= 19]
        peak = max(v for _, v in inside)
        top = min(t for t, v in inside if v == peak)
        pairs = list(zip(inside, inside[1:]))
        r = got[label]
        assert r.peak == pytest.approx(peak) and r.amplitude == pytest.approx(peak - f0) and r.time_to_peak == pytest.approx(top - inside[0][0])
        assert r.auc == pytest.approx(sum((b - a) * ((v + w) / 2 - f0) for (a, v), (b, w) in pairs))
        assert r.mean_response == pytest.approx(mean(v for _, v in inside)) and r.n_frames == len(inside)
        after = [t for t, v in inside if t > top and v <= f0 + (peak - f0) / 2]
        assert r.decay_time == (pytest.approx(min(after) - top) if after else None)
        if level is not None:
            above = [t for t, v in inside if v >= level]
            assert r.onset == (pytest.approx(min(above) - inside[0][0]) if above else None)
            assert r.duration_above == pytest.approx(sum(b - a for (a, v), (b, _) in pairs if v >= level))
        else:
            assert r.threshold is None and r.onset is None


@pytest.mark.parametrize("method", traces.SMOOTHERS)
@pytest.mark.parametrize("chunk", [4096, 5, 1])
def test_smoothing_does_not_see_the_chunks(spark, monkeypatch, method, chunk):
    monkeypatch.setattr(traces, "CHUNK", chunk)
    table, rows = course(spark)
    got = traces.smooth_timecourse(table, method=method, half_width=2, sigma=1.3).collect()
    assert len(got) == len(rows)
    points = {}
    for x in rows:
        if x[5] is not None and not math.isnan(x[5]):
            points.setdefault(x[2], []).append((x[3], x[5]))
    for r in got:
        near = [(i - r.time_index, v) for i, v in points.get(r.label, []) if abs(i - r.time_index) <= 2]
        if not near:
            assert r.mean_intensity_smooth is None
            continue
        if method == "savgol":
            degree = min(2, len({i for i, _ in near}) - 1)
            want = np.polynomial.polynomial.polyfit(*zip(*near), degree)[0]
        else:
            weights = [1.0 if method == "rolling_mean" else math.exp(-i * i / (2 * 1.3**2)) for i, _ in near]
            want = sum(w * v for w, (_, v) in zip(weights, near)) / sum(weights)
        assert r.mean_intensity_smooth == pytest.approx(want, abs=1e-9)


def test_counts_far_from_their_batch(spark):
    from fluoroframe.operators import outliers

    rows = [("a", i, n) for i, n in enumerate([10, 11, 9, 12, 10, 60, 1, None])] + [(None, i, n) for i, n in enumerate([5, 5, 5, 6])] + [("c", 0, 3)]
    table = spark.createDataFrame(rows, "batch string, run int, n_objects int")
    got = {(r.batch, r.run): r for r in outliers.count_outliers(table, by=["batch"]).collect()}
    assert len(got) == len(rows)
    assert [got["a", i].count_verdict for i in range(8)] == ["ok", "ok", "ok", "ok", "ok", "too many", "too few", "missing"]
    assert got["a", 5].robust_score == pytest.approx(0.6745 * 50) and got["a", 5].batch_mad == 1
    assert got[None, 3].count_verdict == "too many" and got[None, 3].robust_score is None and got["c", 0].count_verdict == "ok"
    assert outliers.count_outliers(table.drop("batch")).where("batch_median = 7.5").count() == len(rows)
    assert outliers.count_outliers(table.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 3, 1])
def test_jumps_are_carried_over_chunks(spark, monkeypatch, chunk):
    from fluoroframe.operators import outliers

    monkeypatch.setattr(outliers, "CHUNK", chunk)
    table, rows = course(spark)
    got = outliers.frame_jumps(table, limit=3.0).collect()
    assert len(got) == len(rows)
    mine = lambda label: sorted((x[3], x[5]) for x in rows if x[2] == label and x[5] is not None and not math.isnan(x[5]))
    for label in (0, 1, 2, 3, 9, 10, 11):
        points = mine(label)
        steps = [b[1] - a[1] for a, b in zip(points, points[1:])]
        typical = float(np.median(np.abs(steps))) if steps else None
        have = sorted((r.time_index, r.mean_intensity, r.step, r.is_jump) for r in got if r.label == label and r.step is not None)
        assert [h[2] for h in have] == pytest.approx(steps)
        assert [h[3] for h in have] == [abs(s) > 3 * typical for s in steps]
