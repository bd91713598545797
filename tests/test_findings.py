"""Cases of reviewed findings, each of which failed before its change."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluoroframe.operators import channels as ch, tracking as tr
from fluoroframe.plans import ranks
from fluoroframe.sources import files as fl


def test_records_that_share_a_path(spark):
    known = spark.createDataFrame([("/u", "f1"), ("/u", "f2"), ("/v", "f3")], "path string, file_id string")
    smp = spark.createDataFrame(
        [("s", ["/u", "/none", "/u", "/v"], ["f3"], ["f1", None, "f2", "f9"]), ("r", ["/u", "/u"], None, None)],
        "sample_name string, files array<string>, file_ids array<string>, records array<string>",
    )
    got = {r.sample_name: (r.files, r.file_ids) for r in fl.resolve_files(smp, known).collect()}
    assert got["s"] == (["/u", "/none", "/u", "/v"], ["f3", "f1", "f2"])
    assert got["r"] == (["/u", "/u"], ["f2"])
    late = known.withColumn("arrival", F.when(F.col("file_id") == "f1", 9).otherwise(0))
    plain = {r.sample_name: (r.files, r.file_ids) for r in fl.resolve_files(smp.drop("records"), late).collect()}
    assert plain["r"] == (["/u", "/u"], ["f1"])


def test_channel_matches_are_counted_not_listed(spark):
    n = 3000
    ids = spark.range(n)
    lay = ids.select(F.lit("i").alias("image_id"), F.concat(F.lit("red cell "), F.col("id")).alias("name"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("marker"))
    notes = ids.where("id < 2").select(F.lit("i").alias("image_id"), F.concat(F.lit("red cell "), F.col("id")).alias("layer_name"), F.lit("target").alias("role"), F.lit("red").alias("color"), F.lit("Red").alias("marker"), F.lit(None).cast("string").alias("biological_target"))
    ask = {0: "red cell 7", 1: "red", 2: "rfp", 3: "cell 2999", 4: "cell 299", 5: "9", 6: "zzz", 7: "", 8: None, 9: "target", 10: "d ", 11: "é"}
    req = spark.createDataFrame([(k, "i", q) for k, q in ask.items()], "request_id int, image_id string, query string")
    got = {r.request_id: (r.layer, r.n_matches, r["rank"], r.status) for r in ch.resolve_channel(lay, notes, req).collect()}
    listed = {k: (r.n, r["rank"]) for r in ch.candidates(lay, notes, req).groupBy("request_id", "rank").agg(F.count_distinct("layer").alias("n")).collect() for k in [r.request_id]}
    assert listed == {k: v[1:3] for k, v in got.items() if v[2]}
    names = [f"red cell {i}" for i in range(n)]
    assert got[0] == ("red cell 7", 1, 1, "resolved") and got[1] == (None, 2, 2, "ambiguous") and got[2][1:3] == (2, 2)
    assert got[3] == ("red cell 2999", 1, 4, "resolved") and got[4][1:3] == (11, 4) and got[5][1:3] == (sum("9" in x for x in names), 4)
    assert got[9][1:3] == (2, 2) and got[10][1:3] == (n, 4)
    assert [got[k][3] for k in (6, 7, 8, 11)] == ["unresolved"] * 4 and got[6][0] == "zzz"


def test_equal_requests_cost_one(spark):
    """Half a million requests for a colour worn by 2,000 layers: a billion pairs, counted once."""
    lay = spark.range(2000).select(F.lit("i").alias("image_id"), F.concat(F.lit("gfp "), F.col("id")).alias("name"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("marker"))
    notes = spark.createDataFrame([], "image_id string, layer_name string, role string, color string, marker string, biological_target string")
    req = spark.range(500_000).select(F.col("id").alias("request_id"), F.lit("i").alias("image_id"), F.lit("green").alias("query"))
    began = time.monotonic()
    r = ch.resolve_channel(lay, notes, req).groupBy("n_matches", "rank", "status").count().collect()
    assert [tuple(x) for x in r] == [(2000, 3, "ambiguous", 500_000)] and time.monotonic() - began < 60


def test_dense_frames_meet_few_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [("a", t, k, 0.0, *map(float, p)) for t in range(2) for k, p in enumerate(rng.random((600, 2)) * 5)]
    rows += [("a", 1, 1000 + k, 0.0, 2.0, 2.0) for k in range(50)]  # one place, however many targets
    dets = spark.createDataFrame(rows, "image_id string, t int, label int, z double, y double, x double")
    sizes = tr._grid_sizes(dets, 5.0, "yx")
    cells = dets.select("t", "y", "x").distinct().groupBy("t", *tr._cells("yx", sizes[0])).count()
    assert sizes[-1] == 5.0 and cells.agg(F.max("count")).first()[0] <= 16
    found, links = tr.link(dets, 5.0, 0)
    f = found.toPandas()
    one, two = f[f.t == 0], f[f.t == 1].sort_values("label")
    gap = np.hypot(one.y.to_numpy()[:, None] - two.y.to_numpy(), one.x.to_numpy()[:, None] - two.x.to_numpy())
    want = {(int(one.id.iloc[i]), int(two.id.iloc[j])) for i, j in enumerate(gap.argmin(1)) if gap[:, j].argmin() == i}
    assert {(r.src, r.dst) for r in links.collect()} == want


def test_medians_shuffle_only_values_around_them(spark, monkeypatch):
    monkeypatch.setattr(ranks, "WHOLE", 20_000)
    rng = np.random.default_rng(9)
    a = np.round(rng.normal(size=60_000), 9)
    a[:25_000] = 0.25  # one value with many rows
    pdf = pd.DataFrame({"g": np.where(np.arange(60_000) < 59_990, "big", "few"), "a": a, "b": rng.permutation(60_000).astype(float)})
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("none", None, None)], "g string, a double, b double"))
    got = {r.g: (r.a, r.b) for r in ranks.exact_medians(df, ["g"], ["a", "b"], limit=1000).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == (part.a.median(), part.b.median())
    assert got["none"] == (None, None)
    probs = {"lo": 0.0, "q": 0.3, "hi": 1.0}
    rows, targets = ranks._bracketed(df.where("g = 'big'").select("g", F.col("a").alias("_v")), ["g"], probs)
    assert rows.count() < 600 and targets.count() == 3
    q = ranks.exact_percentiles(df.where("g = 'big'"), ["g"], "a", probs, limit=1000).first()
    assert [q.lo, q.q, q.hi] == pytest.approx(list(np.quantile(pdf[pdf.g == "big"].a, list(probs.values()))), abs=1e-12)
