"""Registered queries of the analysis operators: shapes, group tests, trace normalization and features, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluoroframe.operators import drift, measure, morphology, outliers, paths, statistics, threshold, traces
from fluoroframe.plans import views
from fluoroframe.plans.catalog import FILM, GRAPH, MASK, PLATE, STATIC, _plain_nodes, _static, _with, rounded
from fluoroframe.sources.tiles import label_tiles, tiles_from_voxels, voxels_from_tiles

QUERIES: dict = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


# ---------------------------------------------------------------- shapes

SPOTS = "spots AS (SELECT image_id, t, z, y, x, label FROM film WHERE v > 0)"


def _spots(s, d):
    return views.film(s, d).where("v > 0").select("image_id", "t", "z", "y", "x", "label")


def _shapes(s, d):
    got = morphology.measure_morphology(_spots(s, d), views.images(s, d, (1.0, 0.5, 0.25)))
    return rounded(got.drop("convex_area", "solidity"))


add(
    "measure_morphology",
    _shapes,
    _with(PLATE, FILM, SPOTS, tail=""",
sides AS (SELECT s.*, u.y IS NULL OR d.y IS NULL OR l.y IS NULL OR r.y IS NULL AS edge,
    (u.y IS NULL)::INT + (d.y IS NULL)::INT AS fy, (l.y IS NULL)::INT + (r.y IS NULL)::INT AS fx
  FROM spots s LEFT JOIN spots u ON u.t = s.t AND u.label = s.label AND u.y = s.y - 1 AND u.x = s.x
  LEFT JOIN spots d ON d.t = s.t AND d.label = s.label AND d.y = s.y + 1 AND d.x = s.x
  LEFT JOIN spots l ON l.t = s.t AND l.label = s.label AND l.y = s.y AND l.x = s.x - 1
  LEFT JOIN spots r ON r.t = s.t AND r.label = s.label AND r.y = s.y AND r.x = s.x + 1),
edges AS (SELECT t, label, y, x FROM sides WHERE edge),
steps AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) WHERE dy <> 0 OR dx <> 0),
codes AS (SELECT e.t, e.label, e.y, e.x, 1 + sum(CASE WHEN n.y IS NULL THEN 0 WHEN dy * dx = 0 THEN 2 ELSE 10 END) AS code
  FROM edges e CROSS JOIN steps LEFT JOIN edges n ON n.t = e.t AND n.label = e.label AND n.y = e.y + dy AND n.x = e.x + dx GROUP BY ALL),
around AS (SELECT t, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM codes GROUP BY ALL),
sums AS (SELECT image_id, t, z, label, count(*) AS n, avg(y) AS my, avg(x) AS mx, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c,
    min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, sum(fy) AS fy, sum(fx) AS fx FROM sides GROUP BY ALL),
axes AS (SELECT *, (vy + vx + sqrt((vy - vx) ** 2 + 4 * c * c)) / 2 AS l1, greatest((vy + vx - sqrt((vy - vx) ** 2 + 4 * c * c)) / 2, 0) AS l2 FROM sums)
SELECT image_id, a.t, z, a.label, n AS area, round(my, 6) AS "centroid-0", round(mx, 6) AS "centroid-1", y0 AS "bbox-0", x0 AS "bbox-1", y1 AS "bbox-2", x1 AS "bbox-3",
  round(n / ((y1 - y0) * (x1 - x0)), 6) AS extent, round(4 * sqrt(l1), 6) AS axis_major_length, round(4 * sqrt(l2), 6) AS axis_minor_length,
  CAST(fy AS BIGINT) AS faces_y, CAST(fx AS BIGINT) AS faces_x, round(perimeter, 6) AS perimeter, round(CASE WHEN perimeter > 0 THEN 4 * pi() * n / perimeter ** 2 END, 6) AS circularity,
  round(CASE WHEN l1 > 0 THEN sqrt(1 - l2 / l1) ELSE 0 END, 6) AS eccentricity, CAST(n AS DOUBLE) AS area_px, round(n * 0.125, 6) AS area_um2,
  round(my * 0.5, 6) AS centroid_y_um, round(mx * 0.25, 6) AS centroid_x_um, round(fy * 0.25 + fx * 0.5, 6) AS boundary_um, CAST(NULL AS DOUBLE) AS perimeter_um
FROM axes a JOIN around p ON p.t = a.t AND p.label = a.label"""),
)

# the hull of an object has no short SQL form; the operator is tested against its definition
add("convex_hulls", lambda s, d: rounded(morphology.measure_morphology(_spots(s, d)).select("t", "label", "area", "convex_area", "solidity")))

# ---------------------------------------------------------------- group tests

OBJ = """obj AS (SELECT l_quantity AS area, l_extendedprice AS mean_intensity, s_name AS sample_name, n_name AS "group", CASE WHEN right(n_name, 1) < '5' THEN 'low' ELSE 'high' END AS half
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _halves(s, d):
    return views.objects(s, d).withColumn("half", F.when(F.right(F.col("group"), F.lit(1)) < "5", "low").otherwise("high"))


def _test(value, group, test, unit):
    def run(s, d):
        return rounded(statistics.compare_groups(_halves(s, d), value, group, "sample_name", test, unit)[0])

    return run


_HEAD = "'{t}' AS test, {k} AS n_groups, {n} AS n_samples, {o} AS n_objects, round({s}, 6) AS statistic, round({u}, 6) AS u, round({a}, 6) AS df1, round({b}, 6) AS df2, round({p}, 6) AS p_value"
# densities are summed by Simpson's rule over 2,000 steps
_SIMPSON = "grid AS (SELECT unnest(range(2001)) AS i), weight AS (SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 6000.0 AS w FROM grid)"

add(
    "compare_groups_ttest",
    _test("mean_intensity", "half", "ttest", "sample"),
    _with(OBJ, "per AS (SELECT half AS g, sample_name, avg(mean_intensity) AS v, count(*) AS o FROM obj GROUP BY ALL)",
          "st AS (SELECT g, count(*) AS n, sum(o) AS o, avg(v) AS m, var_samp(v) AS s FROM per GROUP BY g)",
          "two AS (SELECT a.n + b.n AS n, CAST(a.o + b.o AS BIGINT) AS o, (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS t, (a.s / a.n + b.s / b.n) ** 2 / ((a.s / a.n) ** 2 / (a.n - 1) + (b.s / b.n) ** 2 / (b.n - 1)) AS df FROM st a JOIN st b ON a.g < b.g)",
          _SIMPSON, tail=""",
p AS (SELECT 1 - 2 * any_value(abs(t)) * sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + (t * i / 2000) ** 2 / df) ** (-(df + 1) / 2)) AS p FROM two, weight)
SELECT """ + _HEAD.format(t="ttest", k="2", n="n", o="o", s="t", u="CAST(NULL AS DOUBLE)", a="df", b="CAST(NULL AS DOUBLE)", p="p") + " FROM two, p"),
)

RANKS = """ranked AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM o),
tied AS (SELECT sum(t ** 3 - t) AS ties, sum(t) AS n FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM o GROUP BY v)),
sums AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS r FROM ranked GROUP BY g)"""

add(
    "compare_groups_mannwhitney",
    _test("area", "half", "mannwhitney", "object"),
    _with(OBJ, "o AS (SELECT half AS g, area AS v FROM obj)", RANKS,
          "two AS (SELECT a.r - a.n * (a.n + 1) / 2 AS u, a.n AS na, b.n AS nb, a.n + b.n AS n, ties FROM sums a JOIN sums b ON a.g < b.g, tied)",
          "z AS (SELECT *, sign(u - na * nb / 2) * greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM two)",
          _SIMPSON, tail=""",
p AS (SELECT 1 - 2 * any_value(abs(z)) * sum(w * exp(-((z * i / 2000) ** 2) / 2)) / sqrt(2 * pi()) AS p FROM z, weight)
SELECT """ + _HEAD.format(t="mannwhitney", k="2", n="CAST(n AS BIGINT)", o="CAST(n AS BIGINT)", s="z", u="u", a="CAST(NULL AS DOUBLE)", b="CAST(NULL AS DOUBLE)", p="p") + " FROM z, p"),
)

add(
    "compare_groups_anova",
    _test("mean_intensity", "group", "auto", "sample"),
    _with(OBJ, """per AS (SELECT "group" AS g, sample_name, avg(mean_intensity) AS v, count(*) AS o FROM obj GROUP BY ALL)""",
          "st AS (SELECT g, count(*) AS n, sum(o) AS o, avg(v) AS m, coalesce(var_samp(v), 0) * (count(*) - 1) AS ss FROM per GROUP BY g)",
          "mean AS (SELECT avg(v) AS m FROM per)",
          "f AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(o) AS BIGINT) AS o, sum(n * (st.m - mean.m) ** 2) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))) AS f, CAST(count(*) - 1 AS DOUBLE) AS a, CAST(sum(n) - count(*) AS DOUBLE) AS b FROM st, mean)",
          _SIMPSON, tail=""",
p AS (SELECT 1 - any_value(f) * sum(w * exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2)) * (a / b) ** (a / 2) * CASE WHEN i = 0 THEN 0 ELSE (f * i / 2000) ** (a / 2 - 1) * (1 + a * f * i / 2000 / b) ** (-(a + b) / 2) END) AS p FROM f, weight)
SELECT """ + _HEAD.format(t="anova", k="k", n="n", o="o", s="f", u="CAST(NULL AS DOUBLE)", a="a", b="b", p="p") + " FROM f, p"),
)

add(
    "compare_groups_kruskal",
    _test("area", "group", "kruskal", "object"),
    _with(OBJ, """o AS (SELECT "group" AS g, area AS v FROM obj)""", RANKS,
          "h AS (SELECT (12 * sum(r * r / sums.n) / (any_value(tied.n) * (any_value(tied.n) + 1)) - 3 * (any_value(tied.n) + 1)) / (1 - any_value(ties) / (any_value(tied.n) ** 3 - any_value(tied.n))) AS h, count(*) AS k, any_value(tied.n) AS n FROM sums, tied)",
          _SIMPSON, tail=""",
p AS (SELECT 1 - any_value(h) * sum(w * CASE WHEN i = 0 THEN 0 ELSE exp(((k - 1) / 2.0 - 1) * ln(h * i / 2000) - h * i / 4000 - lgamma((k - 1) / 2.0)) / 2 ** ((k - 1) / 2.0) END) AS p FROM h, weight)
SELECT """ + _HEAD.format(t="kruskal", k="k", n="CAST(n AS BIGINT)", o="CAST(n AS BIGINT)", s="h", u="CAST(NULL AS DOUBLE)", a="CAST(k - 1 AS DOUBLE)", b="CAST(NULL AS DOUBLE)", p="p") + " FROM h, p"),
)

# ---------------------------------------------------------------- traces

_BASE = """base AS (SELECT image_id, image_layer, label, avg(mean_intensity) FILTER (time_index BETWEEN 0 AND 4) AS f0, count(*) FILTER (time_index BETWEEN 0 AND 4) AS n0,
  stddev_samp(mean_intensity) FILTER (time_index BETWEEN 0 AND 4) AS sd, avg(mean_intensity) AS fa, count(*) AS na, min(mean_intensity) AS lo, max(mean_intensity) AS hi FROM tc GROUP BY ALL)"""
for _method, _value, _f0, _n in (
    ("baseline_subtract", "mean_intensity - f0", "f0", "n0"),
    ("f_over_f0", "mean_intensity / f0", "f0", "n0"),
    ("delta_f_over_f0", "(mean_intensity - f0) / f0", "f0", "n0"),
    ("zscore", "(mean_intensity - f0) / sd", "f0", "n0"),
    ("minmax", "(mean_intensity - lo) / (hi - lo)", "fa", "na"),
):
    add(
        f"normalize_timecourse_{_method}",
        lambda s, d, m=_method: rounded(traces.normalize_timecourse(_static(s, d), method=m, baseline=(0, 4)).drop("max_intensity", "min_intensity", "area")),
        _with(PLATE, FILM, STATIC, _BASE, tail=f"""
SELECT image_id, image_layer, time, label, round(mean_intensity, 6) AS mean_intensity, time_index, round(time_s, 6) AS time_s, round({_f0}, 6) AS baseline_value,
  {_n} AS baseline_frames, 'ok' AS baseline_status, round({_value}, 6) AS mean_intensity_{_method} FROM tc JOIN base USING (image_id, image_layer, label)"""),
    )

add(
    "timecourse_features",
    lambda s, d: rounded(traces.timecourse_features(_static(s, d), baseline_window=(0, 6), response_window=(7, 30), threshold=0.0)),
    _with(PLATE, FILM, STATIC, tail=""",
base AS (SELECT label, avg(mean_intensity) AS f0 FROM tc WHERE time_s BETWEEN 0 AND 6 GROUP BY label),
r AS (SELECT tc.*, f0, lead(time_s) OVER w AS t1, lead(mean_intensity) OVER w AS v1 FROM tc JOIN base USING (label) WHERE time_s BETWEEN 7 AND 30 WINDOW w AS (PARTITION BY label ORDER BY time_s)),
p AS (SELECT image_id, image_layer, label, any_value(f0) AS f0, max(mean_intensity) AS peak, avg(mean_intensity) AS m, count(*) AS n, min(time_s) AS b,
    sum(coalesce(t1 - time_s, 0) * ((mean_intensity + coalesce(v1, mean_intensity)) / 2 - f0)) AS auc, min(time_s) FILTER (mean_intensity >= 0) AS on_t,
    sum(CASE WHEN mean_intensity >= 0 THEN coalesce(t1 - time_s, 0) ELSE 0 END) AS dur FROM r GROUP BY ALL),
k AS (SELECT p.*, (SELECT min(time_s) FROM r WHERE r.label = p.label AND r.mean_intensity = p.peak) AS tp FROM p)
SELECT image_id, image_layer, label, round(f0, 6) AS baseline_mean, round(peak, 6) AS peak, round(peak - f0, 6) AS amplitude, round(tp - b, 6) AS time_to_peak, round(auc, 6) AS auc,
  round(m, 6) AS mean_response, CAST(0 AS DOUBLE) AS threshold, round(on_t - b, 6) AS onset, round(dur, 6) AS duration_above,
  round((SELECT min(time_s) FROM r WHERE r.label = k.label AND r.time_s > k.tp AND r.mean_intensity <= k.f0 + (k.peak - k.f0) / 2) - tp, 6) AS decay_time, n AS n_frames FROM k"""),
)

for _method, _weight in (("rolling_mean", "1"), ("gaussian", "exp(-(b.time_index - a.time_index) * (b.time_index - a.time_index) / (2 * 1.5 * 1.5))")):
    add(
        f"smooth_timecourse_{_method}",
        lambda s, d, m=_method: rounded(traces.smooth_timecourse(_static(s, d), method=m, half_width=3, sigma=1.5).select("image_id", "label", "time_index", "mean_intensity_smooth")),
        _with(PLATE, FILM, STATIC, tail=f"""
SELECT a.image_id, a.label, a.time_index, round(sum({_weight} * b.mean_intensity) / sum({_weight}), 6) AS mean_intensity_smooth
FROM tc a JOIN tc b ON a.label = b.label AND b.time_index BETWEEN a.time_index - 3 AND a.time_index + 3 GROUP BY ALL"""),
    )
# the middle of a fitted parabola by Cramer's rule from sums of powers
add(
    "smooth_timecourse_savgol",
    lambda s, d: rounded(traces.smooth_timecourse(_static(s, d), method="savgol", half_width=3).select("image_id", "label", "time_index", "mean_intensity_smooth")),
    _with(PLATE, FILM, STATIC, tail=""",
near AS (SELECT a.image_id, a.label, a.time_index, b.time_index - a.time_index AS k, b.mean_intensity AS v FROM tc a JOIN tc b ON a.label = b.label AND b.time_index BETWEEN a.time_index - 3 AND a.time_index + 3),
sums AS (SELECT image_id, label, time_index, CAST(count(*) AS DOUBLE) AS s0, CAST(sum(k) AS DOUBLE) AS s1, CAST(sum(k * k) AS DOUBLE) AS s2, CAST(sum(k * k * k) AS DOUBLE) AS s3,
  CAST(sum(k * k * k * k) AS DOUBLE) AS s4, sum(v) AS t0, sum(k * v) AS t1, sum(k * k * v) AS t2 FROM near GROUP BY ALL)
SELECT image_id, label, time_index, round((t0 * (s2 * s4 - s3 * s3) - t1 * (s1 * s4 - s2 * s3) + t2 * (s1 * s3 - s2 * s2))
  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)), 6) AS mean_intensity_smooth FROM sums"""),
)

# ---------------------------------------------------------------- drift

_FRAMES = 4


def _drifting(s, d):
    """The plate in four frames, each moved by two rows and one column more than the one before; empty places are 0."""
    plate = views.vox(s, d).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(_FRAMES - 1))))
    seen = plate.select("image_id", "channel", "t", "z", (F.col("y") + 2 * F.col("t")).alias("y"), (F.col("x") + F.col("t")).alias("x"), "v")
    places = plate.drop("v")
    return places.join(seen, ["image_id", "channel", "t", "z", "y", "x"], "left").na.fill(0.0, ["v"])


def _drift_tiles(s, d):
    return tiles_from_voxels(_drifting(s, d), 128, 32)


_SHIFT_SQL = """
SELECT 'plate' AS image_id, 'g' AS channel, t, -2 * t AS dy, -t AS dx, {step_y} AS step_dy, {step_x} AS step_dx FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS t)"""
add(
    "estimate_drift",
    lambda s, d: drift.estimate_drift(_drift_tiles(s, d), "g").drop("score"),
    _SHIFT_SQL.format(step_y="-2 * t", step_x="-t"),
)
add(
    "estimate_drift_previous",
    lambda s, d: drift.estimate_drift(_drift_tiles(s, d), "g", against="previous").drop("score"),
    _SHIFT_SQL.format(step_y="CASE WHEN t > 0 THEN -2 ELSE 0 END", step_x="CASE WHEN t > 0 THEN -1 ELSE 0 END"),
)


def _corrected(s, d):
    tiles = _drift_tiles(s, d)
    return rounded(voxels_from_tiles(drift.apply_drift_correction(tiles, drift.estimate_drift(tiles, "g"))))


add(
    "apply_drift_correction",
    _corrected,
    _with(PLATE, "size AS (SELECT max(y) AS h, max(x) AS w FROM plate)", tail="""
SELECT image_id, 'g_corrected' AS channel, f.t AS t, z, y, x, round(CASE WHEN y + 2 * f.t <= h AND x + f.t <= w THEN v ELSE 0 END, 6) AS v
FROM plate p, size, (SELECT CAST(unnest(range(4)) AS INTEGER) AS t) f"""),
)

# ---------------------------------------------------------------- integer images and label tiles

LEVELS = """lv AS (SELECT CAST(floor(v * 400) AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS h FROM plate GROUP BY 1)"""


def _grey(method):
    def run(s, d):
        vox = views.vox(s, d).withColumn("v", F.floor(F.col("v") * 400).cast("double"))
        return rounded(method(vox, images=views.images(s, d).withColumn("dtype", F.lit("int16"))))

    return run


_PICK = "SELECT 'plate' AS image_id, 'g' AS channel, CAST(k AS DOUBLE) AS threshold FROM sc ORDER BY score DESC NULLS LAST, k LIMIT 1"
add(
    "otsu_threshold_integer",
    _grey(threshold.otsu),
    _with(PLATE, LEVELS, "c AS (SELECT k, sum(h) OVER u AS w1, sum(h * k) OVER u AS s1, sum(h) OVER () AS n, sum(h * k) OVER () AS s FROM lv WINDOW u AS (ORDER BY k))",
          "sc AS (SELECT k, w1 * (n - w1) * (s1 / w1 - (s - s1) / nullif(n - w1, 0)) ** 2 AS score FROM c)", tail=_PICK),
)
add(
    "yen_threshold_integer",
    _grey(threshold.yen),
    _with(PLATE, LEVELS, "p AS (SELECT k, h / sum(h) OVER () AS p FROM lv)",
          "c AS (SELECT k, sum(p) OVER u AS c1, sum(p * p) OVER u AS q, sum(p * p) OVER (ORDER BY k DESC) - p * p AS r FROM p WINDOW u AS (ORDER BY k))",
          "sc AS (SELECT k, CASE WHEN r > 1e-18 THEN ln((c1 * (1 - c1)) ** 2 / (q * r)) END AS score FROM c)", tail=_PICK),
)
add(
    "triangle_threshold_integer",
    _grey(threshold.triangle),
    _with(PLATE, LEVELS, "lim AS (SELECT min(k) AS a, max(k) AS b, max(h) AS top, arg_min(k, (-h, k)) AS pk FROM lv)",
          "al AS (SELECT unnest(range(a, b + 1)) AS k FROM lim)",
          "m AS (SELECT al.k, coalesce(h, 0) AS h, CASE WHEN pk - a < b - pk THEN b - al.k ELSE al.k - a END AS x, CASE WHEN pk - a < b - pk THEN b - pk ELSE pk - a END AS run, top FROM al LEFT JOIN lv ON lv.k = al.k, lim)",
          "sc AS (SELECT k, x, top / sqrt(top * top + run * run) * x - run / sqrt(top * top + run * run) * h AS score FROM m WHERE x < run)",
          tail="SELECT 'plate' AS image_id, 'g' AS channel, CAST(k AS DOUBLE) AS threshold FROM sc ORDER BY score DESC, x LIMIT 1"),
)


def _far_labels(s, d):
    """Labels beyond the whole numbers that floats hold."""
    return views.labels(s, d).withColumn("label", F.col("label").cast("long") + 16777215)


add(
    "measure_label_tiles",
    lambda s, d: rounded(measure.measure_intensity_tiles(tiles_from_voxels(views.vox(s, d), 128, 32), label_tiles(_far_labels(s, d), views.images(s, d), 128, 32), None, ["g"])),
    _with(PLATE, tail="""
SELECT image_id, label + 16777215 AS label, count(*) AS area, round(avg(y), 6) AS "centroid-0", round(avg(x), 6) AS "centroid-1",
  round(avg(v), 6) AS mean_intensity_g, round(max(v), 6) AS max_intensity_g, round(min(v), 6) AS min_intensity_g,
  CAST(count(*) AS DOUBLE) AS area_px FROM plate GROUP BY image_id, label"""),
)

# ---------------------------------------------------------------- batch and frame quality

add(
    "count_outliers",
    lambda s, d: rounded(outliers.count_outliers(views.table(s, d, "orders").groupBy(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("batch")).agg(F.count("*").alias("n_objects")), by=["batch"])),
    """
WITH r AS (SELECT o_custkey AS run, o_orderstatus AS batch, count(*) AS n_objects FROM orders GROUP BY ALL),
m AS (SELECT batch, median(n_objects) AS batch_median FROM r GROUP BY batch),
d AS (SELECT r.*, batch_median, abs(n_objects - batch_median) AS dev FROM r JOIN m USING (batch)),
a AS (SELECT batch, median(dev) AS batch_mad FROM d GROUP BY batch)
SELECT run, batch, n_objects, CAST(batch_median AS DOUBLE) AS batch_median, CAST(batch_mad AS DOUBLE) AS batch_mad,
  round(CASE WHEN batch_mad > 0 THEN 0.6745 * (n_objects - batch_median) / batch_mad END, 6) AS robust_score,
  CASE WHEN CASE WHEN batch_mad > 0 THEN abs(0.6745 * (n_objects - batch_median) / batch_mad) > 3.5 ELSE dev > 0 END
    THEN CASE WHEN n_objects < batch_median THEN 'too few' ELSE 'too many' END ELSE 'ok' END AS count_verdict
FROM d JOIN a USING (batch)""",
)
add(
    "frame_jumps",
    lambda s, d: rounded(outliers.frame_jumps(_static(s, d), limit=2.0).select("image_id", "label", "time_index", "mean_intensity", "step", "typical_step", "is_jump")),
    _with(PLATE, FILM, STATIC, tail=""",
st AS (SELECT image_id, label, time_index, mean_intensity, mean_intensity - lag(mean_intensity) OVER (PARTITION BY label ORDER BY time_index) AS step FROM tc),
ty AS (SELECT label, median(abs(step)) AS typical FROM st GROUP BY label)
SELECT image_id, st.label, time_index, round(mean_intensity, 6) AS mean_intensity, round(step, 6) AS step, round(typical, 6) AS typical_step, coalesce(abs(step) > 2 * typical, false) AS is_jump
FROM st JOIN ty ON ty.label = st.label"""),
)

# ---------------------------------------------------------------- along skeletons

# distances from the first node of every component; each step of the recursion looks one edge further
WALK = """starts AS (SELECT min(pid) AS pid FROM node GROUP BY component_id),
leg AS (SELECT src AS a, dst AS b, sqrt(CAST(dy * dy + dx * dx AS DOUBLE)) AS len FROM step UNION ALL SELECT dst, src, sqrt(CAST(dy * dy + dx * dx AS DOUBLE)) FROM step),
most AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM node GROUP BY component_id)),
walk AS (SELECT 0 AS i, pid, CAST(0 AS DOUBLE) AS d FROM starts
  UNION ALL SELECT i + 1, pid, min(d) FROM (SELECT i, pid, d FROM walk UNION ALL SELECT i, b, d + len FROM walk JOIN leg ON a = pid) WHERE i < (SELECT n FROM most) GROUP BY i, pid),
far AS (SELECT pid, d FROM walk WHERE i = (SELECT n FROM most))"""
FOREST = """up AS (SELECT f.pid, arg_min(u.pid, u.node_id) AS parent FROM far f JOIN leg ON b = f.pid JOIN far g ON g.pid = a AND g.d < f.d AND g.d + len = f.d JOIN node u ON u.pid = a GROUP BY f.pid),
tree AS (SELECT pid, parent FROM far LEFT JOIN up USING (pid)),
deep AS (SELECT pid, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.pid, depth + 1 FROM tree t JOIN deep p ON t.parent = p.pid),
ranked AS (SELECT (SELECT max(depth) + 1 FROM deep) AS i, pid, parent, depth, CAST(NULL AS INTEGER) AS o FROM tree JOIN deep USING (pid)
  UNION ALL SELECT s.i - 1, s.pid, s.parent, s.depth, CASE WHEN s.depth < s.i - 1 THEN NULL WHEN s.depth > s.i - 1 THEN s.o WHEN k.m IS NULL THEN 1 ELSE k.m + (k.n > 1)::INT END
  FROM ranked s LEFT JOIN (SELECT parent, max(o) AS m, count(*) FILTER (o = top) AS n FROM (SELECT parent, o, max(o) OVER (PARTITION BY parent) AS top FROM ranked WHERE depth = i) GROUP BY parent) k ON k.parent = s.pid
  WHERE s.i > 0),
ordered AS (SELECT pid, parent, o FROM ranked WHERE i = 0)"""


def _far(s, d):
    n, e = _plain_nodes(s, d)
    starts = n.groupBy("trace_id", "component_id").agg(F.min("pid").alias("pid")).select("trace_id", "pid")
    return n, e, paths.path_distances(n, e, starts)


def _orders(s, d):
    _, e, far = _far(s, d)
    tree = paths.path_parents(far, e)
    return paths.strahler_order(tree), tree, far


def _node_orders(s, d):
    orders, _, far = _orders(s, d)
    return orders.join(far, ["trace_id", "pid"]).select("trace_id", "node_id", "strahler")


def _sampled(s, d):
    n, e, far = _far(s, d)
    return paths.sample_nodes(n, tiles_from_voxels(views.vox(s, d), 32, 32)), far, n


add(
    "path_distances",
    lambda s, d: rounded(_far(s, d)[2].drop("pid")),
    _with(PLATE, MASK, GRAPH, WALK, tail="SELECT 'plate' AS trace_id, node_id, round(d, 6) AS path_distance FROM node LEFT JOIN far USING (pid)", recursive=True),
)
add(
    "branch_orders",
    _node_orders,
    _with(PLATE, MASK, GRAPH, WALK, FOREST, tail="SELECT 'plate' AS trace_id, node_id, o AS strahler FROM ordered JOIN node USING (pid)", recursive=True),
)
add(
    "branch_order_summary",
    lambda s, d: paths.order_summary(*_orders(s, d)[:2]),
    _with(PLATE, MASK, GRAPH, WALK, FOREST, tail="""
, kids AS (SELECT parent AS pid, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent)
SELECT 'plate' AS trace_id, max(o) AS max_strahler, count(*) AS n_nodes, count(*) FILTER (n IS NULL) AS n_tips, count(*) FILTER (n > 1) AS n_forks
FROM ordered LEFT JOIN kids USING (pid)""", recursive=True),
)
_INTENSITY = "count(*) AS n_nodes, round(avg(CAST(v AS FLOAT)), 6) AS mean_intensity, round(min(CAST(v AS FLOAT))::DOUBLE, 6) AS min_intensity, round(max(CAST(v AS FLOAT))::DOUBLE, 6) AS max_intensity, round(stddev_pop(CAST(v AS FLOAT)), 6) AS std_intensity"


def _profile(s, d):
    at, far, _ = _sampled(s, d)
    return rounded(paths.distance_profile(at, far, 2.0))


def _per_component(s, d):
    n, _ = _plain_nodes(s, d)
    at = paths.sample_nodes(n, tiles_from_voxels(views.vox(s, d), 32, 32))
    return rounded(paths.branch_intensity(at, n.select("trace_id", "pid", F.col("component_id").alias("branch_id"))))


add(
    "distance_profile",
    _profile,
    _with(PLATE, MASK, GRAPH, WALK, tail=f"""
SELECT 'plate' AS trace_id, 'g' AS channel, 0 AS t, CAST(floor(d / 2) AS BIGINT) AS bin, {_INTENSITY}, floor(d / 2) * 2 AS distance_from
FROM node JOIN plate p ON p.y = node.y AND p.x = node.x LEFT JOIN far ON far.pid = node.pid GROUP BY floor(d / 2)""", recursive=True),
)
add(
    "process_intensity",
    _per_component,
    _with(PLATE, MASK, GRAPH, tail=f"""
SELECT 'plate' AS trace_id, component_id AS branch_id, 'g' AS channel, 0 AS t, {_INTENSITY}
FROM node JOIN plate p ON p.y = node.y AND p.x = node.x GROUP BY component_id""", recursive=True),
)
