"""Registered queries over voxels, masks, skeletons and detections.

Every entry is name -> (query, ANSI SQL of the same result or None).  Doubles are
rounded at the very end so that summation order does not show.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fluoroframe.operators import coloc, components, filters, measure, projection, qc, segment, skeleton, threshold, tracking
from fluoroframe.plans import views, workflows
from fluoroframe.plans.graph import merge_pairs
from fluoroframe.sources import tiles as ti

PLATE = """plate AS (
  SELECT 'plate' AS image_id, 'g' AS channel, 0 AS t, 0 AS z, CAST(vec_id AS INTEGER) AS y,
         CAST(x AS INTEGER) AS x, CAST(v AS DOUBLE) AS v, label + 1 AS label
  FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS x, unnest(embedding) AS v FROM embeddings))"""
FILM = """film AS (SELECT image_id, channel, y % 20 AS t, z, y // 20 AS y, x, v, label FROM plate)"""
MASK = """mask AS (SELECT image_id, t, z, y, x, CAST(y AS BIGINT) * 2097152 + x AS pid FROM plate WHERE v > 0.2)"""
SIZE = """size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM plate)"""
# reachability inside the mask by face neighbours, and component numbers in raster order
COMPS = """
reach AS (
  SELECT pid AS s, pid AS n, y, x FROM mask
  UNION SELECT r.s, m.pid, m.y, m.x FROM reach r JOIN mask m ON abs(m.y - r.y) + abs(m.x - r.x) = 1
       AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1),
root AS (SELECT n AS pid, min(s) AS root FROM reach GROUP BY n),
comp AS (SELECT m.*, root, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label
         FROM mask m JOIN root USING (pid))"""
# the mask as a skeleton graph with all eight neighbours
GRAPH = """
step AS (
  SELECT a.pid AS src, b.pid AS dst, b.y - a.y AS dy, b.x - a.x AS dx
  FROM mask a CROSS JOIN (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) d(oy, ox)
  JOIN mask b ON b.y = a.y + d.oy AND b.x = a.x + d.ox),
ends AS (SELECT src AS a, dst AS b FROM step UNION ALL SELECT dst, src FROM step),
deg AS (SELECT m.pid, CAST(count(b.b) AS INTEGER) AS degree FROM mask m LEFT JOIN ends b ON b.a = m.pid GROUP BY m.pid),
reach AS (SELECT pid AS s, pid AS n FROM mask UNION SELECT r.s, b.b FROM reach r JOIN ends b ON b.a = r.n),
root AS (SELECT n AS pid, min(s) AS root FROM reach GROUP BY n),
node AS (
  SELECT m.pid, m.y, m.x, degree, row_number() OVER (ORDER BY m.pid) - 1 AS node_id,
         CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS component_id
  FROM mask m JOIN deg USING (pid) JOIN root USING (pid))"""
CHAINS = """
chain AS (SELECT pid FROM deg WHERE degree = 2),
creach AS (SELECT pid AS s, pid AS n FROM chain
  UNION SELECT r.s, b.b FROM creach r JOIN ends b ON b.a = r.n JOIN chain c ON c.pid = b.b),
croot AS (SELECT n AS pid, min(s) AS croot FROM creach GROUP BY n),
e AS (SELECT s.src, s.dst, sqrt(s.dy * s.dy + s.dx * s.dx) AS len, ca.croot AS ra, cb.croot AS rb
      FROM step s LEFT JOIN croot ca ON ca.pid = s.src LEFT JOIN croot cb ON cb.pid = s.dst),
b0 AS (
  SELECT coalesce(ra, rb) AS croot, sum(len) AS len,
         coalesce(min(CASE WHEN ra IS NULL THEN src WHEN rb IS NULL THEN dst END), coalesce(ra, rb)) AS p0,
         coalesce(max(CASE WHEN ra IS NULL THEN src WHEN rb IS NULL THEN dst END), coalesce(ra, rb)) AS p1
  FROM e WHERE ra IS NOT NULL OR rb IS NOT NULL GROUP BY coalesce(ra, rb)
  UNION ALL SELECT NULL, len, src, dst FROM e WHERE ra IS NULL AND rb IS NULL),
branch AS (
  SELECT row_number() OVER (ORDER BY p0, p1, b0.croot NULLS FIRST) - 1 AS branch_id, a.component_id, a.node_id AS n0,
         c.node_id AS n1, len, sqrt(CAST((a.y - c.y) * (a.y - c.y) + (a.x - c.x) * (a.x - c.x) AS DOUBLE)) AS gap,
         CASE WHEN p0 = p1 THEN 3 WHEN a.degree = 1 AND c.degree = 1 THEN 0
              WHEN a.degree = 1 OR c.degree = 1 THEN 1 ELSE 2 END AS code
  FROM b0 JOIN node a ON a.pid = p0 JOIN node c ON c.pid = p1)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    new = {c: F.round(F.col(f"`{c}`").cast("double"), digits) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(new) if new else df


def _with(*parts: str, tail: str, recursive: bool = False) -> str:
    """A WITH query; a tail that starts with a comma adds further common tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n" + tail.strip()


QUERIES: dict = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


# ---------------------------------------------------------------- measurement

add(
    "measure_intensity",
    lambda s, d: rounded(measure.measure_intensity(views.vox(s, d), views.labels(s, d), views.images(s, d), ["g"])),
    _with(PLATE, tail="""
SELECT image_id, label, count(*) AS area, round(avg(y), 6) AS "centroid-0", round(avg(x), 6) AS "centroid-1",
  round(avg(v), 6) AS mean_intensity_g, round(max(v), 6) AS max_intensity_g, round(min(v), 6) AS min_intensity_g,
  CAST(count(*) AS DOUBLE) AS area_px, round(count(*) * 0.5 * 0.25, 6) AS area_um2,
  round(avg(y) * 0.5, 6) AS centroid_y_um, round(avg(x) * 0.25, 6) AS centroid_x_um
FROM plate GROUP BY image_id, label"""),
)

add(
    "measure_intensity_tiles",
    lambda s, d: rounded(
        measure.measure_intensity_tiles(
            ti.tiles_from_voxels(views.vox(s, d)),
            ti.tiles_from_voxels(views.plate(s, d).withColumn("v", F.col("label").cast("double")).drop("label")),
            None, ["g"],
        )
    ),
    _with(PLATE, tail="""
SELECT image_id, label, count(*) AS area, round(avg(y), 6) AS "centroid-0", round(avg(x), 6) AS "centroid-1",
  round(avg(v), 6) AS mean_intensity_g, round(max(v), 6) AS max_intensity_g, round(min(v), 6) AS min_intensity_g,
  CAST(count(*) AS DOUBLE) AS area_px
FROM plate GROUP BY image_id, label"""),
)


def _two_channels(s, d):
    lab = views.labels(s, d).where("x < 32")
    return rounded(measure.measure_intensity(views.two_channels(s, d), lab, None, ["a", "b"]))


add(
    "measure_two_channels",
    _two_channels,
    _with(PLATE, tail="""
SELECT image_id, label, CAST(sum(CAST(x < 32 AS INTEGER)) AS BIGINT) AS area,
  round(avg(y) FILTER (x < 32), 6) AS "centroid-0", round(avg(x) FILTER (x < 32), 6) AS "centroid-1",
  round(avg(v) FILTER (x < 32), 6) AS mean_intensity_a, round(max(v) FILTER (x < 32), 6) AS max_intensity_a,
  round(min(v) FILTER (x < 32), 6) AS min_intensity_a,
  round(avg(v) FILTER (x >= 32), 6) AS mean_intensity_b, round(max(v) FILTER (x >= 32), 6) AS max_intensity_b,
  round(min(v) FILTER (x >= 32), 6) AS min_intensity_b,
  CAST(sum(CAST(x < 32 AS INTEGER)) AS DOUBLE) AS area_px
FROM plate GROUP BY image_id, label"""),
)


def _movie(s, d):
    vox, lab = views.movie(s, d)
    image = s.range(1).select(F.when(F.col("id") >= 0, "movie").alias("image_id"), F.lit("1.5").alias("time_interval_s"))
    return rounded(_movie_all(vox, lab, image))


def _movie_all(vox, lab, image):
    out = None
    for c in ("click", "error", "purchase", "signup", "view"):
        one = measure.measure_intensity_over_time(vox, lab.where(F.col("channel") == c).drop("channel"), image, c, static=False)
        out = one if out is None else out.unionByName(one)
    return out


add(
    "measure_intensity_over_time",
    _movie,
    """
SELECT 'movie' AS image_id, event_type AS image_layer, CAST(day(ts) - 1 AS INTEGER) AS time,
  CAST(user_id + 1 AS INTEGER) AS label, count(*) AS area, round(avg(value), 6) AS mean_intensity,
  round(max(value), 6) AS max_intensity, round(min(value), 6) AS min_intensity,
  CAST(day(ts) - 1 AS INTEGER) AS time_index, round((day(ts) - 1) * CAST(1.5 AS DOUBLE), 6) AS time_s
FROM events GROUP BY event_type, day(ts), user_id""",
)


def _static(s, d):
    roi = views.film(s, d).select("image_id", "z", "y", "x", (F.col("y") % 5 + 1).alias("label")).distinct()
    return measure.measure_intensity_over_time(views.film(s, d).drop("label"), roi, views.film_images(s, d), "g")


STATIC = """tc AS (
  SELECT image_id, channel AS image_layer, t AS time, y % 5 + 1 AS label, count(*) AS area, avg(v) AS mean_intensity,
    max(v) AS max_intensity, min(v) AS min_intensity, t AS time_index, t * CAST(1.5 AS DOUBLE) AS time_s
  FROM film GROUP BY image_id, channel, t, y % 5)"""
add(
    "roi_time_course",
    lambda s, d: rounded(_static(s, d)),
    _with(PLATE, FILM, STATIC, tail="""
SELECT image_id, image_layer, time, label, area, round(mean_intensity, 6) AS mean_intensity,
  round(max_intensity, 6) AS max_intensity, round(min_intensity, 6) AS min_intensity, time_index, round(time_s, 6) AS time_s
FROM tc"""),
)
add(
    "time_course_totals",
    lambda s, d: measure.timecourse_totals(_static(s, d), views.film_images(s, d)),
    _with(PLATE, FILM, STATIC, tail="""
SELECT image_id, CAST(max(time) + 1 AS INTEGER) AS n_timepoints, count(*) AS n_rows, count(DISTINCT label) AS n_labels
FROM tc GROUP BY image_id"""),
)


def _refresh(s, d):
    old = measure.measure_intensity(views.vox(s, d), views.labels(s, d).where("label <= 6"), None, ["g"])
    spec = {"tool": "measure_intensity", "channels": ["g"], "properties": ["label", "area", "mean_intensity"]}
    return measure.refresh_measurement(spec, views.vox(s, d), views.labels(s, d), None, old)[1]


add(
    "refresh_measurement",
    _refresh,
    _with(PLATE, tail="""
SELECT count(DISTINCT label) AS n_rows, count(DISTINCT label) - count(DISTINCT label) FILTER (label <= 6) AS delta_rows
FROM plate"""),
)

# ---------------------------------------------------------------- colocalization and thresholds

PAIRS = """
pairs AS (SELECT l.y, l.x, l.v AS a, r.v AS b, l.label FROM plate l JOIN plate r ON r.y = l.y AND r.x = l.x + 32 WHERE l.x < 32)"""


def _hist_sql(source: str, where: str = "TRUE", name: str = "h", col: str = "v") -> str:
    return f"""
{name}_s AS (SELECT min({col}) AS mn, max({col}) AS mx FROM {source} WHERE {where}),
{name}_g AS (SELECT CAST(least(floor(({col} - mn) / (mx - mn) * 256), 255) AS BIGINT) AS bin, count(*) AS h
        FROM {source}, {name}_s WHERE {where} GROUP BY 1),
{name} AS (SELECT b.bin, mn, mx, coalesce(h, 0) AS h, mn + (b.bin + CAST(0.5 AS DOUBLE)) * (mx - mn) / 256 AS center
      FROM (SELECT unnest(range(256)) AS bin) b CROSS JOIN {name}_s LEFT JOIN {name}_g USING (bin))"""


def _otsu_sql(name: str = "h") -> str:
    return f"""
{name}_c AS (SELECT *, sum(h) OVER u AS w1, sum(h * center) OVER u AS s1, sum(h) OVER r AS w2, sum(h * center) OVER r AS s2
       FROM {name} WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), r AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
{name}_n AS (SELECT bin, center, w1, s1 / nullif(w1, 0) AS m1, lead(w2) OVER (ORDER BY bin) AS w2,
        lead(s2 / nullif(w2, 0)) OVER (ORDER BY bin) AS m2 FROM {name}_c),
{name}_otsu AS (SELECT center AS threshold FROM {name}_n
        ORDER BY coalesce(w1 * w2 * (m1 - m2) * (m1 - m2), -1) DESC, bin LIMIT 1)"""


add(
    "manders_coefficients",
    lambda s, d: rounded(coloc.manders(views.two_channels(s, d), "a", "b")),
    _with(PLATE, PAIRS, _hist_sql("pairs", name="ha", col="a"), _otsu_sql("ha"), _hist_sql("pairs", name="hb", col="b"), _otsu_sql("hb"), tail="""
SELECT 'plate' AS image_id,
  round(CASE WHEN sum(a) > 0 THEN sum(CASE WHEN b > tb.threshold THEN a ELSE 0 END) / sum(a) ELSE 0 END, 6) AS "M1",
  round(CASE WHEN sum(b) > 0 THEN sum(CASE WHEN a > ta.threshold THEN b ELSE 0 END) / sum(b) ELSE 0 END, 6) AS "M2",
  round(any_value(ta.threshold), 6) AS threshold_a, round(any_value(tb.threshold), 6) AS threshold_b, count(*) AS n_pixels
FROM pairs, ha_otsu ta, hb_otsu tb"""),
)
add(
    "manders_in_mask",
    lambda s, d: rounded(coloc.manders(views.two_channels(s, d), "a", "b", views.labels(s, d).where("label >= 4 AND x < 32"), "zero", 0.1)),
    _with(PLATE, PAIRS, tail="""
SELECT 'plate' AS image_id,
  round(CASE WHEN sum(a) > 0 THEN sum(CASE WHEN b > 0.1 THEN a ELSE 0 END) / sum(a) ELSE 0 END, 6) AS "M1",
  round(CASE WHEN sum(b) > 0 THEN sum(CASE WHEN a > 0 THEN b ELSE 0 END) / sum(b) ELSE 0 END, 6) AS "M2",
  CAST(0 AS DOUBLE) AS threshold_a, CAST(0.1 AS DOUBLE) AS threshold_b, count(*) AS n_pixels
FROM pairs WHERE label >= 4"""),
)
add(
    "pearson_correlation",
    lambda s, d: rounded(coloc.pearson(views.two_channels(s, d), "a", "b")),
    _with(PLATE, PAIRS, tail="SELECT 'plate' AS image_id, round(corr(a, b), 6) AS r, count(*) AS n_pixels FROM pairs"),
)
add(
    "pearson_in_mask",
    lambda s, d: rounded(coloc.pearson(views.two_channels(s, d), "a", "b", views.labels(s, d).where("label <= 3 AND x < 32"))),
    _with(PLATE, PAIRS, tail="SELECT 'plate' AS image_id, round(corr(a, b), 6) AS r, count(*) AS n_pixels FROM pairs WHERE label <= 3"),
)
add(
    "histogram",
    lambda s, d: rounded(threshold.histogram(views.vox(s, d)).select("image_id", "channel", "bin", "h", "center", "mn", "mx")),
    _with(PLATE, _hist_sql("plate"), tail="""
SELECT 'plate' AS image_id, 'g' AS channel, bin, h, round(center, 6) AS center, round(mn, 6) AS mn, round(mx, 6) AS mx FROM h"""),
)
add(
    "otsu_threshold",
    lambda s, d: rounded(threshold.otsu(views.vox(s, d))),
    _with(PLATE, _hist_sql("plate"), _otsu_sql(), tail="SELECT 'plate' AS image_id, 'g' AS channel, round(threshold, 6) AS threshold FROM h_otsu"),
)
add(
    "yen_threshold",
    lambda s, d: rounded(threshold.yen(views.vox(s, d))),
    _with(PLATE, _hist_sql("plate"), tail="""
, p AS (SELECT bin, center, h / sum(h) OVER () AS p FROM h),
c AS (SELECT bin, center, sum(p) OVER u AS a, sum(p * p) OVER u AS q, sum(p * p) OVER r AS w FROM p
      WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), r AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
n AS (SELECT bin, center, (a * (1 - a)) * (a * (1 - a)) / nullif(q * lead(w) OVER (ORDER BY bin), 0) AS ratio FROM c)
SELECT 'plate' AS image_id, 'g' AS channel, round(center, 6) AS threshold FROM n
ORDER BY CASE WHEN ratio > 0 THEN ln(ratio) ELSE CAST('-inf' AS DOUBLE) END DESC NULLS LAST, bin LIMIT 1"""),
)
add(
    "triangle_threshold",
    lambda s, d: rounded(threshold.triangle(views.vox(s, d))),
    _with(PLATE, _hist_sql("plate"), tail="""
, k AS (SELECT (SELECT bin FROM h ORDER BY h DESC, bin LIMIT 1) AS k, max(h) AS top,
       min(bin) FILTER (h > 0) AS a, max(bin) FILTER (h > 0) AS b FROM h),
f AS (SELECT *, k - a < b - k AS flip FROM k),
j AS (SELECT center, top, CASE WHEN flip THEN 255 - bin ELSE bin END AS i, h,
        CASE WHEN flip THEN 255 - b ELSE a END AS a2, CASE WHEN flip THEN 255 - k ELSE k END AS k2 FROM h, f),
sc AS (SELECT center, i, (top / sqrt(CAST(top * top + (k2 - a2) * (k2 - a2) AS DOUBLE))) * (i - a2)
        - ((k2 - a2) / sqrt(CAST(top * top + (k2 - a2) * (k2 - a2) AS DOUBLE))) * h AS score FROM j WHERE i >= a2 AND i < k2)
SELECT 'plate' AS image_id, 'g' AS channel, round(center, 6) AS threshold FROM sc ORDER BY score DESC, i LIMIT 1"""),
)
add(
    "percentile_pair",
    lambda s, d: rounded(threshold.percentiles(views.vox(s, d), {"p1": 0.01, "p99": 0.99, "p995": 0.995})),
    _with(PLATE, tail="""
SELECT image_id, channel, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.99), 6) AS p99,
  round(quantile_cont(v, 0.995), 6) AS p995 FROM plate GROUP BY image_id, channel"""),
)
add(
    "global_threshold_mask",
    lambda s, d: segment.threshold_mask(views.vox(s, d), views.images(s, d), "otsu")[0],
    _with(PLATE, _hist_sql("plate"), _otsu_sql(), tail="SELECT image_id, t, z, y, x FROM plate, h_otsu WHERE v > threshold"),
)

# ---------------------------------------------------------------- projections and layers

add(
    "max_projection",
    lambda s, d: rounded(projection.max_projection(views.volume(s, d), "z")),
    _with(PLATE, tail="""
SELECT image_id, channel, t, y % 50 AS y, x, round(max(v), 6) AS v FROM plate GROUP BY image_id, channel, t, y % 50, x"""),
)
add(
    "orthogonal_views",
    lambda s, d: rounded(projection.orthogonal_views(views.volume(s, d))),
    _with(PLATE, tail="""
, vol AS (SELECT image_id, channel, t, y // 50 AS z, y % 50 AS y, x, v FROM plate)
SELECT image_id, channel, t, 'XZ' AS view, z, x AS u, round(max(v), 6) AS v FROM vol GROUP BY ALL
UNION ALL SELECT image_id, channel, t, 'YZ', z, y, round(max(v), 6) FROM vol GROUP BY ALL"""),
)
add(
    "extract_timepoint",
    lambda s, d: rounded(ti.extract_timepoint(views.film(s, d).drop("label"), 7, views.film_images(s, d))),
    _with(PLATE, FILM, tail="SELECT image_id, channel, 0 AS t, z, y, x, round(v, 6) AS v FROM film WHERE t = 7"),
)
add(
    "select_position",
    lambda s, d: rounded(ti.select_position(views.film(s, d).drop("label").withColumnRenamed("t", "position"), 2)),
    _with(PLATE, FILM, tail="SELECT image_id, channel, z, y, x, round(v, 6) AS v FROM film WHERE t = 2"),
)
add(
    "apply_mask",
    lambda s, d: rounded(ti.apply_mask(views.vox(s, d), views.labels(s, d).where("label = 3"))),
    _with(PLATE, tail="SELECT image_id, channel, t, z, y, x, round(v, 6) AS v FROM plate WHERE label = 3"),
)
add(
    "binary_mask",
    lambda s, d: ti.binary_mask(views.vox(s, d), 0.2),
    _with(PLATE, tail="SELECT image_id, t, z, y, x FROM plate WHERE v > 0.2"),
)
add(
    "layer_catalog",
    lambda s, d: ti.layer_catalog(views.vox(s, d), views.images(s, d)),
    _with(PLATE, tail="""
SELECT image_id, channel, max(t) + 1 AS n_t, max(z) + 1 AS n_z, max(y) + 1 AS n_y, max(x) + 1 AS n_x, 'YX' AS axes,
  'float32' AS dtype, CAST(1 AS DOUBLE) AS voxel_z, CAST(0.5 AS DOUBLE) AS voxel_y, CAST(0.25 AS DOUBLE) AS voxel_x, 'image' AS kind
FROM plate GROUP BY image_id, channel"""),
)
add(
    "layer_summary",
    lambda s, d: rounded(ti.layer_summary(views.vox(s, d))),
    _with(PLATE, tail="""
SELECT image_id, channel, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
  round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.99), 6) AS p99 FROM plate GROUP BY image_id, channel"""),
)
add(
    "labels_summary",
    lambda s, d: ti.labels_summary(views.labels(s, d), views.images(s, d)),
    _with(PLATE, tail="SELECT image_id, max(label) AS n_labels FROM plate GROUP BY image_id"),
)

# ---------------------------------------------------------------- filters


def _tiles(s, d):
    return ti.tiles_from_voxels(views.vox(s, d))


add(
    "auto_contrast",
    lambda s, d: rounded(filters.auto_contrast(views.vox(s, d))),
    _with(PLATE, tail="""
, q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM plate)
SELECT image_id, channel, t, z, y, x,
  round(CAST(CAST(greatest(0, least(1, (v - lo) / (hi - lo))) AS FLOAT) AS DOUBLE), 6) AS v FROM plate, q"""),
)
_GAUSS = """
g AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM (SELECT unnest(range(-4, 5)) AS e)) AS w
      FROM (SELECT unnest(range(-4, 5)) AS d)),
gy AS (SELECT p.y, p.x, sum(g.w * q.v) AS v FROM plate p CROSS JOIN g CROSS JOIN size
       JOIN plate q ON q.x = p.x AND q.y = greatest(0, least(h - 1, p.y + g.d)) GROUP BY p.y, p.x),
gx AS (SELECT p.y, p.x, sum(g.w * q.v) AS v FROM gy p CROSS JOIN g CROSS JOIN size
       JOIN gy q ON q.y = p.y AND q.x = greatest(0, least(w - 1, p.x + g.d)) GROUP BY p.y, p.x)"""
add(
    "gaussian_denoise",
    lambda s, d: rounded(ti.voxels_from_tiles(filters.gaussian(_tiles(s, d), views.images(s, d)))),
    _with(PLATE, SIZE, _GAUSS.replace("p CROSS JOIN g CROSS JOIN size", "p CROSS JOIN g CROSS JOIN (SELECT h, w AS wd FROM size)").replace("least(w - 1", "least(wd - 1"), tail="""
SELECT 'plate' AS image_id, 'g' AS channel, 0 AS t, 0 AS z, y, x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM gx"""),
)
add(
    "rolling_ball_background",
    lambda s, d: rounded(ti.voxels_from_tiles(filters.rolling_ball(_tiles(s, d), views.images(s, d), 8.0))),
    _with(PLATE, tail="""
, k AS (SELECT a AS dy, b AS dx, 8 - sqrt(CAST(64 - a * a - b * b AS DOUBLE)) AS lift
       FROM (SELECT unnest(range(-8, 9)) AS a) CROSS JOIN (SELECT unnest(range(-8, 9)) AS b) WHERE a * a + b * b <= 64),
bg AS (SELECT p.y, p.x, min(q.v + lift) AS b FROM plate p CROSS JOIN k JOIN plate q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.y, p.x)
SELECT image_id, channel, t, z, y, x, round(CAST(CAST(v - b AS FLOAT) AS DOUBLE), 6) AS v FROM plate JOIN bg USING (y, x)"""),
)
add(
    "local_threshold_mask",
    lambda s, d: segment.threshold_mask(views.vox(s, d), views.images(s, d), "local")[0],
    _with(PLATE, SIZE, tail="""
, o AS (SELECT unnest(range(-20, 21)) AS d),
g AS (SELECT d, exp(-0.5 * d * d / 25) / (SELECT sum(exp(-0.5 * d * d / 25)) FROM o) AS w FROM o),
gy AS (SELECT p.y, p.x, sum(g.w * q.v) AS v FROM plate p CROSS JOIN g CROSS JOIN (SELECT h FROM size)
       JOIN plate q ON q.x = p.x AND q.y = CASE WHEN p.y + d < 0 THEN -(p.y + d) - 1 WHEN p.y + d >= h THEN 2 * h - (p.y + d) - 1 ELSE p.y + d END
       GROUP BY p.y, p.x),
gx AS (SELECT p.y, p.x, sum(g.w * q.v) AS m FROM gy p CROSS JOIN g CROSS JOIN (SELECT w AS wd FROM size)
       JOIN gy q ON q.y = p.y AND q.x = CASE WHEN p.x + d < 0 THEN -(p.x + d) - 1 WHEN p.x + d >= wd THEN 2 * wd - (p.x + d) - 1 ELSE p.x + d END
       GROUP BY p.y, p.x)
SELECT image_id, t, z, y, x FROM plate JOIN gx USING (y, x) WHERE v > m"""),
)
add(
    "enhance_tubeness",
    lambda s, d: rounded(ti.voxels_from_tiles(filters.enhance_processes(_tiles(s, d), views.images(s, d), "tubeness", background=None)), 4),
)
add(
    "enhance_vesselness",
    lambda s, d: rounded(ti.voxels_from_tiles(filters.enhance_processes(_tiles(s, d), views.images(s, d), "frangi", 2.0, None)), 4),
)

# ---------------------------------------------------------------- components and segmentation

add(
    "connected_components",
    lambda s, d: components.label_components(views.mask(s, d)),
    _with(PLATE, MASK, COMPS, tail="SELECT image_id, t, z, y, x, label FROM comp", recursive=True),
)
add(
    "fill_holes",
    lambda s, d: components.fill_holes(views.mask(s, d, 0.0), views.images(s, d)),
    _with(PLATE, SIZE, tail="""
, bg AS (SELECT y, x FROM plate WHERE NOT v > 0),
open AS (SELECT y, x FROM bg, size WHERE y = 0 OR x = 0 OR y = h - 1 OR x = w - 1
  UNION SELECT b.y, b.x FROM open o CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx)
  JOIN bg b ON b.y = o.y + s.dy AND b.x = o.x + s.dx)
SELECT image_id, t, z, y, x FROM plate WHERE (y, x) NOT IN (SELECT (y, x) FROM open)""", recursive=True),
)
add(
    "remove_small_objects",
    lambda s, d: components.remove_small(views.mask(s, d), 3),
    _with(PLATE, MASK, COMPS, tail="""
SELECT image_id, t, z, y, x FROM comp WHERE root IN (SELECT root FROM comp GROUP BY root HAVING count(*) >= 3)""", recursive=True),
)
add(
    "keep_largest",
    lambda s, d: components.keep_largest(views.mask(s, d)),
    _with(PLATE, MASK, COMPS, tail="""
SELECT image_id, t, z, y, x, 1 AS label FROM comp
WHERE root = (SELECT root FROM comp GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)""", recursive=True),
)
add(
    "label_outline",
    lambda s, d: components.label_outline(views.labels(s, d).where("label IN (2, 5, 7, 8)"), views.images(s, d)),
    _with(PLATE, tail="""
, l AS (SELECT y, x, CASE WHEN label IN (2, 5, 7, 8) THEN label ELSE 0 END AS l FROM plate),
n AS (SELECT a.y, a.x, a.l,
        max(b.l) FILTER (abs(b.y - a.y) + abs(b.x - a.x) <= 1) != min(b.l) FILTER (abs(b.y - a.y) + abs(b.x - a.x) <= 1) AS differs,
        max(b.l) != min(nullif(b.l, 0)) AS touching
      FROM l a CROSS JOIN (VALUES (-1), (0), (1)) p(dy) CROSS JOIN (VALUES (-1), (0), (1)) q(dx)
      JOIN l b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x, a.l)
SELECT 'plate' AS image_id, 0 AS t, 0 AS z, y, x FROM n WHERE differs AND (l = 0 OR touching)"""),
)
add(
    "segment_processes",
    lambda s, d: segment.segment_processes(views.vox(s, d), views.images(s, d), 0.2, 0.3, True)[0],
    _with(PLATE, SIZE, tail="""
, bg AS (SELECT y, x FROM plate WHERE NOT v > 0.2),
open AS (SELECT y, x FROM bg, size WHERE y = 0 OR x = 0 OR y = h - 1 OR x = w - 1
  UNION SELECT b.y, b.x FROM open o CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx)
  JOIN bg b ON b.y = o.y + s.dy AND b.x = o.x + s.dx),
mask AS (SELECT image_id, t, z, y, x, CAST(y AS BIGINT) * 2097152 + x AS pid FROM plate WHERE (y, x) NOT IN (SELECT (y, x) FROM open)),"""
    + COMPS.strip() + """,
big AS (SELECT *, count(*) OVER (PARTITION BY root) AS n FROM comp)
SELECT image_id, t, z, y, x, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM big WHERE n >= ceil(0.3 / (0.5 * 0.25))""", recursive=True),
)


def _segment_qc(s, d):
    out = segment.segment_processes(views.vox(s, d), views.images(s, d), 0.2)[1]
    return rounded(out.withColumn("warnings", F.array_join("warnings", "; ")).withColumn("threshold_value", F.col("threshold_value").cast("double")))


add(
    "segment_processes_qc",
    _segment_qc,
    _with(PLATE, MASK, COMPS, tail="""
, c AS (SELECT count(*) AS n, max(label) AS k FROM comp), a AS (SELECT count(*) AS n FROM plate)
SELECT 'plate' AS source, CASE WHEN k = 0 THEN 'fail' WHEN c.n / a.n < 0.0005 OR c.n / a.n > 0.35 THEN 'warning' ELSE 'pass' END AS status,
  concat_ws('; ', CASE WHEN c.n / a.n < 0.0005 THEN 'Foreground fraction is very low; threshold may be too stringent.' END,
    CASE WHEN c.n / a.n > 0.35 THEN 'Foreground fraction is high for sparse neural process tracing.' END) AS warnings,
  round(c.n / a.n, 6) AS foreground_fraction, CAST(k AS BIGINT) AS component_count, CAST(0.2 AS DOUBLE) AS threshold_value
FROM c, a""", recursive=True),
)


def bright_objects(a: np.ndarray) -> np.ndarray:
    """A stand-in model: face-connected bright pixels of one tile."""
    m = a > np.float32(0.2)
    ids = np.full(m.shape, -1)
    ids[m] = np.arange(m.sum())
    left = [ids[:, :-1][m[:, :-1] & m[:, 1:]], ids[:-1][m[:-1] & m[1:]]]
    right = [ids[:, 1:][m[:, :-1] & m[:, 1:]], ids[1:][m[:-1] & m[1:]]]
    out = np.zeros(m.shape, dtype=np.int64)
    out[m] = merge_pairs(int(m.sum()), np.concatenate(left), np.concatenate(right)) + 1
    return out


add(
    "segment_with_model",
    lambda s, d: segment.segment_with_model(ti.tiles_from_voxels(views.vox(s, d), 64, 16), views.images(s, d), bright_objects)[0],
    _with(PLATE, MASK.replace("v > 0.2", "v > CAST(CAST(0.2 AS FLOAT) AS DOUBLE)"), COMPS, tail="SELECT image_id, t, z, y, x, label FROM comp", recursive=True),
)
add(
    "label_qc",
    lambda s, d: rounded(segment.label_qc(views.labels(s, d).where("label != 4"), views.images(s, d))),
    _with(PLATE, tail="""
, n AS (SELECT unnest(range(1, (SELECT max(label) + 1 FROM plate WHERE label != 4))) AS label),
c AS (SELECT n.label, count(p.label) AS a FROM n LEFT JOIN plate p ON p.label = n.label AND p.label != 4 GROUP BY n.label)
SELECT 'plate' AS image_id, CAST(max(label) AS INTEGER) AS n_objects, CAST(median(a) AS DOUBLE) AS object_area_median, min(a) AS object_area_min,
  max(a) AS object_area_max, max(label) = 0 AS empty_mask FROM c"""),
)

# ---------------------------------------------------------------- quality control


def _seg_qc(s, d):
    lab = components.label_components(views.mask(s, d))
    out = qc.segmentation_qc(lab, views.images(s, d, (1.0, 1.0, 1.0)), views.vox(s, d))
    return rounded(out.withColumns({"warnings": F.array_join("warnings", "; "), "border_touching_labels": F.array_join(F.col("border_touching_labels").cast("array<string>"), ",")}))


add(
    "segmentation_qc",
    _seg_qc,
    _with(PLATE, MASK, COMPS, SIZE, tail="""
, o AS (SELECT label, count(*) AS n, max(CAST(y = 0 OR x = 0 OR y = h - 1 OR x = w - 1 AS INTEGER)) AS edge FROM comp, size GROUP BY label),
m AS (SELECT median(n) AS md FROM o),
q AS (SELECT any_value(CAST(md AS DOUBLE)) AS md, count(*) AS k, min(n) AS lo, max(n) AS hi, avg(n) AS mean,
        avg(CAST(n < greatest(1, md * 0.25) AS INTEGER)) AS tiny, avg(CAST(n > md * 4 AS INTEGER)) AS large, avg(edge) AS edge,
        string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FILTER (edge = 1) AS labels FROM o, m),
s AS (SELECT avg(CAST(v >= 0.999 AS INTEGER)) AS sat, max(v) <= 1 AS ok FROM plate)
SELECT 'plate' AS image_id, md AS object_size_median, CAST(k AS BIGINT) AS n_objects, lo AS object_size_min, hi AS object_size_max,
  round(mean, 6) AS object_size_mean, round(tiny, 6) AS tiny_object_fraction, round(large, 6) AS large_object_fraction,
  labels AS border_touching_labels, round(edge, 6) AS border_touching_fraction, round(sat, 6) AS saturation_fraction,
  ok AS saturation_interpretable,
  concat_ws('; ', 'Layer scale is missing or unit-valued; physical sizes may be unavailable.',
    CASE WHEN tiny > 0.25 THEN 'Many labeled objects are much smaller than the median object size.' END,
    CASE WHEN large > 0.10 THEN 'Some labeled objects are much larger than the median object size.' END,
    CASE WHEN edge > 0.10 THEN 'Some labeled objects touch the image border.' END,
    CASE WHEN ok AND sat > 0.001 THEN 'Image has saturated pixels; intensity measurements may be clipped.' END) AS warnings,
  'warning' AS status FROM q, s""", recursive=True),
)
add(
    "border_labels",
    lambda s, d: qc.border_labels(components.label_components(views.mask(s, d)), views.images(s, d)),
    _with(PLATE, MASK, COMPS, SIZE, tail="""
SELECT DISTINCT image_id, label FROM comp, size WHERE y = 0 OR x = 0 OR y = h - 1 OR x = w - 1""", recursive=True),
)
add(
    "saturation",
    lambda s, d: rounded(qc.saturation(views.vox(s, d).withColumn("v", F.round(F.col("v") * 20)), views.images(s, d))),
    _with(PLATE, tail="""
, p AS (SELECT image_id, round(v * 20) AS v FROM plate), m AS (SELECT max(v) AS m FROM p)
SELECT image_id, round(avg(CAST(CASE WHEN m <= 1 THEN v >= 0.999 ELSE v >= m END AS INTEGER)), 6) AS saturation_fraction,
  any_value(m <= 1) AS saturation_interpretable FROM p, m GROUP BY image_id"""),
)


def _time_qc(s, d):
    vox, _ = views.movie(s, d)
    tc = vox.select(F.col("channel").alias("image_id"), F.col("t").alias("time_index"), (F.col("y") + 1).alias("label"), F.col("v").alias("mean_intensity"))
    return tc


TQ = """e AS (SELECT event_type AS image_id, day(ts) - 1 AS t, user_id + 1 AS label, value AS v FROM events),
r AS (SELECT image_id, label, count(*) AS n, max(v) - min(v) AS span, count(DISTINCT t) AS pairs FROM e GROUP BY ALL),
k AS (SELECT image_id, count(DISTINCT t) AS times, count(*) AS n_rows FROM e GROUP BY ALL)"""
add(
    "timecourse_qc",
    lambda s, d: rounded(qc.timecourse_qc(_time_qc(s, d), "events", ["image_id"]).withColumn("warnings", F.array_join("warnings", "; "))),
    _with(TQ, tail="""
, q AS (SELECT image_id, any_value(n_rows) AS n_rows, count(*) AS n_rois, min(n) AS lo, max(n) AS hi, any_value(times) AS times,
     count(*) * any_value(times) - sum(pairs) AS miss, avg(CAST(n >= 2 AND span <= 1e-9 AS INTEGER)) AS flat
   FROM r JOIN k USING (image_id) GROUP BY image_id)
SELECT 'events' AS source, image_id, CAST(n_rows AS BIGINT) AS n_rows, n_rois, lo AS points_per_roi_min, hi AS points_per_roi_max,
  times AS n_timepoints, CAST(miss AS BIGINT) AS missing_roi_time_pairs, round(miss / (n_rois * times), 6) AS missing_roi_time_fraction,
  round(flat, 6) AS flat_trace_fraction,
  concat_ws('; ', CASE WHEN miss > 0 THEN 'Some ROI/timepoint measurements are missing.' END,
    CASE WHEN flat > 0.5 THEN 'Most ROI traces are flat; confirm the time axis and ROI mapping.' END) AS warnings,
  CASE WHEN miss > 0 OR flat > 0.5 THEN 'warning' ELSE 'pass' END AS status FROM q"""),
)
add(
    "missing_pairs",
    lambda s, d: qc.missing_pairs(_time_qc(s, d), ["image_id"], "time_index"),
    _with(TQ, tail="""
SELECT l.image_id, CAST(l.label AS INTEGER) AS label, CAST(t.t AS INTEGER) AS time_index FROM (SELECT DISTINCT image_id, label FROM e) l
JOIN (SELECT DISTINCT image_id, t FROM e) t USING (image_id)
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.image_id = l.image_id AND e.label = l.label AND e.t = t.t)"""),
)

# ---------------------------------------------------------------- skeletons


def _graph(s, d) -> skeleton.TraceGraph:
    return skeleton.trace_graph(views.mask(s, d), views.images(s, d, (1.0, 1.0, 1.0)))


def _plain_nodes(s, d):
    """Nodes and edges only, for the queries that need no branches."""
    mask, img = views.mask(s, d), views.images(s, d, (1.0, 1.0, 1.0))
    steps = skeleton._steps(mask, 2)
    n = skeleton.cut(skeleton.nodes(mask, img, 2, steps))
    return n, skeleton.edges(n, steps, img)


add(
    "skeleton_nodes",
    lambda s, d: rounded(_plain_nodes(s, d)[0].drop("pid", "coord_0_um", "coord_1_um")),
    _with(PLATE, MASK, GRAPH, tail="""
SELECT 'plate' AS trace_id, node_id, degree, component_id, y AS image_coord_0, CAST(y AS DOUBLE) AS coord_0_scaled,
  x AS image_coord_1, CAST(x AS DOUBLE) AS coord_1_scaled FROM node""", recursive=True),
)
add(
    "skeleton_edges",
    lambda s, d: rounded(_plain_nodes(s, d)[1].drop("src", "dst", "edge_length_um")),
    _with(PLATE, MASK, GRAPH, tail="""
SELECT 'plate' AS trace_id, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, a.node_id AS node_id_src, b.node_id AS node_id_dst,
  round(sqrt(CAST(dy * dy + dx * dx AS DOUBLE)), 6) AS edge_length_scaled
FROM step JOIN node a ON a.pid = src JOIN node b ON b.pid = dst""", recursive=True),
)
add(
    "skeleton_components",
    lambda s, d: rounded(skeleton.components(*_plain_nodes(s, d))),
    _with(PLATE, MASK, GRAPH, tail="""
, ne AS (SELECT component_id, count(*) AS k FROM step JOIN node ON pid = src GROUP BY component_id)
SELECT 'plate' AS trace_id, component_id, count(*) AS n_nodes, coalesce(any_value(k), 0) AS n_edges,
  CAST(min(y) AS DOUBLE) AS coord_0_scaled_min, CAST(max(y) AS DOUBLE) AS coord_0_scaled_max,
  CAST(min(x) AS DOUBLE) AS coord_1_scaled_min, CAST(max(x) AS DOUBLE) AS coord_1_scaled_max
FROM node LEFT JOIN ne USING (component_id) GROUP BY component_id""", recursive=True),
)
add(
    "skeleton_branches",
    lambda s, d: rounded(_graph(s, d).branches.drop("branch_length_um", "euclidean_distance_um", "branch_length_scaled", "euclidean_distance_scaled")),
    _with(PLATE, MASK, GRAPH, CHAINS, tail="""
SELECT 'plate' AS trace_id, branch_id, component_id AS skeleton_component, n0 AS node_id_src, n1 AS node_id_dst,
  round(len, 6) AS branch_length, code AS branch_type_code,
  CASE code WHEN 0 THEN 'endpoint-endpoint' WHEN 1 THEN 'junction-endpoint' WHEN 2 THEN 'junction-junction' ELSE 'isolated-cycle' END AS branch_type,
  round(gap, 6) AS euclidean_distance, round(len / nullif(gap, 0), 6) AS tortuosity FROM branch""", recursive=True),
)
add(
    "branch_metrics",
    lambda s, d: rounded(skeleton.branch_metrics(_graph(s, d).branches)),
    _with(PLATE, MASK, GRAPH, CHAINS, tail="""
SELECT 'plate' AS trace_id, CASE code WHEN 0 THEN 'endpoint-endpoint' WHEN 1 THEN 'junction-endpoint' WHEN 2 THEN 'junction-junction' ELSE 'isolated-cycle' END AS branch_type,
  count(*) AS n_branches, round(sum(len), 6) AS total_length FROM branch GROUP BY code""", recursive=True),
)


def _morphology(s, d):
    g = _graph(s, d)
    return rounded(skeleton.morphology(g.nodes, g.branches, g.components, views.images(s, d, (1.0, 1.0, 1.0))))


add(
    "morphology",
    _morphology,
    _with(PLATE, MASK, GRAPH, CHAINS, tail="""
, n AS (SELECT count(*) FILTER (degree = 1) AS ends, count(*) FILTER (degree > 2) AS junctions, count(*) AS vox, max(y) - min(y) AS ry,
       max(x) - min(x) AS rx, count(DISTINCT component_id) AS comps FROM node),
b AS (SELECT sum(len) AS total, avg(len) AS mean, median(len) AS med, count(*) AS k, count(*) FILTER (code IN (0, 1)) AS term,
       count(*) FILTER (code = 2) AS inner_n FROM branch)
SELECT 'plate' AS trace_id, ends AS n_endpoints, junctions AS n_junctions, vox AS skeleton_voxels, CAST(ry AS DOUBLE) AS bbox_0,
  CAST(rx AS DOUBLE) AS bbox_1, comps AS n_components, round(total, 6) AS total_length, round(mean, 6) AS mean_branch_length, k AS n_branches,
  term AS n_terminal_branches, inner_n AS n_internal_branches, round(med, 6) AS median_branch_length,
  round(vox / (SELECT count(*) FROM plate), 6) AS skeleton_volume_occupancy, 'pixels' AS length_unit FROM n, b""", recursive=True),
)
SHOLL = """
dist AS (SELECT pid, sqrt(CAST((y - 250) * (y - 250) + (x - 32) * (x - 32) AS DOUBLE)) AS d FROM mask),
radius AS (SELECT CAST(5 AS DOUBLE) + unnest(range(CAST(greatest(0, ceil(((SELECT max(d) FROM dist) + 1e-9 - 5) / 5)) AS BIGINT))) * CAST(5 AS DOUBLE) AS r),
hit AS (SELECT r, count(*) AS n FROM step JOIN dist a ON a.pid = src JOIN dist b ON b.pid = dst
        JOIN radius ON r >= least(a.d, b.d) AND r <= greatest(a.d, b.d) GROUP BY r),
profile AS (SELECT radius.r, coalesce(n, 0) AS n FROM radius LEFT JOIN hit USING (r))"""


def _sholl(s, d, part):
    n, e = _plain_nodes(s, d)
    return rounded(skeleton.sholl(n, e, center="250,32", step=5.0)[part])


add(
    "sholl_profile",
    lambda s, d: _sholl(s, d, 0),
    _with(PLATE, MASK, GRAPH.split("reach AS")[0].rstrip().rstrip(","), SHOLL, tail="SELECT 'plate' AS trace_id, r AS radius_um, n AS intersections FROM profile"),
)
add(
    "sholl_peak",
    lambda s, d: _sholl(s, d, 1),
    _with(PLATE, MASK, GRAPH.split("reach AS")[0].rstrip().rstrip(","), SHOLL, tail="""
, w AS (SELECT r, n, (n + lag(n) OVER (ORDER BY r)) / 2.0 * (r - lag(r) OVER (ORDER BY r)) AS strip FROM profile)
SELECT 'plate' AS trace_id, 'explicit' AS center, CAST(count(*) AS INTEGER) AS n_radii, max(n) AS peak_intersections,
  (SELECT r FROM profile ORDER BY n DESC, r LIMIT 1) AS peak_radius_um, round(coalesce(sum(strip), 0), 6) AS area_under_curve FROM w"""),
)
add(
    "dominant_region",
    lambda s, d: skeleton.dominant_region(_plain_nodes(s, d)[0], views.labels(s, d)),
    _with(PLATE, tail="""
SELECT 'plate' AS trace_id, (SELECT label FROM plate WHERE v > 0.2 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS region"""),
)
add(
    "soma_location",
    lambda s, d: rounded(skeleton.soma(mask=views.labels(s, d).where("label = 2"), images=views.images(s, d))),
    _with(PLATE, tail="SELECT image_id AS trace_id, round(avg(y) * 0.5, 6) AS c0, round(avg(x) * 0.25, 6) AS c1 FROM plate WHERE label = 2 GROUP BY image_id"),
)
add(
    "swc_rows",
    lambda s, d: rounded(skeleton.swc_rows(*_plain_nodes(s, d))),
    _with(PLATE, MASK, GRAPH, tail="""
, st AS (SELECT coalesce(min(node_id) FILTER (degree = 1), 0) AS r FROM node),
start AS (SELECT pid FROM node, st WHERE node_id = r),
walk AS (SELECT pid, 0 AS hops FROM start
  UNION SELECT b.b, w.hops + 1 FROM walk w JOIN ends b ON b.a = w.pid
  WHERE w.hops < (SELECT count(*) FROM root WHERE root = (SELECT root FROM root WHERE pid = (SELECT pid FROM start)))),
hop AS (SELECT pid, min(hops) AS hops FROM walk GROUP BY pid),
par AS (SELECT h.pid, min(n.node_id) AS p FROM hop h JOIN ends b ON b.a = h.pid JOIN hop g ON g.pid = b.b AND g.hops = h.hops - 1
        JOIN node n ON n.pid = b.b GROUP BY h.pid)
SELECT 'plate' AS trace_id, node_id + 1 AS id, 3 AS type, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z,
  CAST(0.5 AS DOUBLE) AS radius, coalesce(p + 1, -1) AS parent FROM node LEFT JOIN par USING (pid)""", recursive=True),
)
add("thin_mask", lambda s, d: skeleton.thin(views.mask(s, d, 0.05)))


def _pruned(s, d):
    mask, img = views.mask(s, d), views.images(s, d, (1.0, 1.0, 1.0))
    _, g, totals = skeleton.prune(mask, skeleton.trace_graph(mask, img), img, 1.2)
    left = g.branches.groupBy("trace_id").agg(F.count("*").alias("n_paths_after"))
    return totals.join(left, "trace_id", "left")


add("prune_skeleton", _pruned)

# ---------------------------------------------------------------- tracking

add(
    "detections",
    lambda s, d: rounded(tracking.detections(views.film(s, d).select("image_id", "t", "z", "y", "x", "label"))),
    _with(PLATE, FILM, tail="""
SELECT image_id, t, label, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM film GROUP BY image_id, t, label"""),
)


def _track_sql(radius: float, max_lost: int, tail: str) -> str:
    parts = [
        """det AS (SELECT vec_id % 20 AS t, CAST(vec_id AS INTEGER) AS label, CAST(embedding[1] AS DOUBLE) * 100 AS y,
  CAST(embedding[2] AS DOUBLE) * 100 AS x, row_number() OVER (ORDER BY vec_id % 20, vec_id) - 1 AS id FROM embeddings)"""
    ]
    heads, tails = "SELECT * FROM det", "SELECT * FROM det"
    links = []
    for gap in range(1, max_lost + 2):
        parts.append(
            f"""p{gap} AS (SELECT a.id AS s, b.id AS e, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d, a.label AS la, b.label AS lb
  FROM ({heads}) a JOIN ({tails}) b ON b.t = a.t + {gap}),
n{gap} AS (SELECT s, e, row_number() OVER (PARTITION BY s ORDER BY d, lb, e) AS f, row_number() OVER (PARTITION BY e ORDER BY d, la, s) AS g
  FROM p{gap} WHERE d <= {radius}),
l{gap} AS (SELECT s, e FROM n{gap} WHERE f = 1 AND g = 1)"""
        )
        links.append(f"SELECT s, e FROM l{gap}")
        used = " UNION ALL ".join(links)
        heads = f"SELECT * FROM det WHERE id NOT IN (SELECT s FROM ({used}))"
        tails = f"SELECT * FROM det WHERE id NOT IN (SELECT e FROM ({used}))"
    parts.append(
        f"""link AS ({' UNION ALL '.join(links)}),
walk AS (SELECT id AS root, id AS n FROM det WHERE id NOT IN (SELECT e FROM link)
  UNION ALL SELECT w.root, k.e FROM walk w JOIN link k ON k.s = w.n),
tr AS (SELECT d.*, dense_rank() OVER (ORDER BY root) AS track_id FROM det d JOIN walk w ON w.n = d.id)"""
    )
    return _with(*parts, tail=tail, recursive=True)


add(
    "track_objects",
    lambda s, d: rounded(tracking.track(views.points(s, d), 5.0, 2)),
    _track_sql(5.0, 2, "SELECT 'film' AS image_id, track_id, CAST(t AS INTEGER) AS t, round(y, 6) AS y, round(x, 6) AS x, label FROM tr"),
)
add(
    "track_counts",
    lambda s, d: tracking.track_counts(tracking.track(views.points(s, d), 5.0, 2)),
    _track_sql(5.0, 2, "SELECT 'film' AS image_id, count(DISTINCT track_id) AS n_tracks, count(*) AS n_detections FROM tr"),
)

# ---------------------------------------------------------------- workflow


def bright_components(vox: DataFrame, images: DataFrame) -> DataFrame:
    return components.label_components(vox.where("v > 0.2").select("image_id", "t", "z", "y", "x"))


def _analysis(s, d):
    layers = views.images(s, d).select("image_id", F.lit("g").alias("name"), F.lit("image").alias("kind"))
    none = s.createDataFrame([], "image_id string, layer_name string, role string, color string, marker string, biological_target string")
    return workflows.analyze_target_cells(views.vox(s, d), views.images(s, d), layers, none, segment=bright_components)


add(
    "analyze_target_cells",
    lambda s, d: rounded(_analysis(s, d).results.select("image_id", "ok", "stage", "target_channel", "target_source", "n_objects", "object_area_min", "object_area_median", "object_area_max", "has_physical_units")),
    _with(PLATE, MASK, COMPS, tail="""
, o AS (SELECT label, count(*) AS n FROM comp GROUP BY label)
SELECT 'plate' AS image_id, TRUE AS ok, CAST(NULL AS VARCHAR) AS stage, 'g' AS target_channel, 'inference' AS target_source,
  CAST(count(*) AS INTEGER) AS n_objects, min(n) AS object_area_min, CAST(median(n) AS DOUBLE) AS object_area_median, max(n) AS object_area_max,
  TRUE AS has_physical_units FROM o""", recursive=True),
)
add(
    "analyze_target_objects",
    lambda s, d: rounded(_analysis(s, d).objects.select("image_id", "label", "area", "mean_intensity_target", "area_um2", "source_layer")),
    _with(PLATE, MASK, COMPS, tail="""
SELECT c.image_id, c.label, count(*) AS area, round(avg(v), 6) AS mean_intensity_target, round(count(*) * 0.125, 6) AS area_um2, 'g' AS source_layer
FROM comp c JOIN plate p ON p.y = c.y AND p.x = c.x GROUP BY c.image_id, c.label""", recursive=True),
)
