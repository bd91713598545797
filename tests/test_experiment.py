import json

import numpy as np
import pytest
from helpers import images, voxels
from pyspark.sql import functions as F

from fluoroframe.functions import text
from fluoroframe.operators import channels as ch, experiment as ex, report
from fluoroframe.plans import workflows as wf
from fluoroframe.plans.cut import cut
from fluoroframe.sources import files as fl, metadata as md, project, provenance as pv, tiles as ti
from fluoroframe.streaming.timecourse import timecourse_stream

LAYERS = "image_id string, name string, kind string, marker string"
CHANNELS = "image_id string, layer_name string, role string, color string, marker string, biological_target string"


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("r")).first().r


def test_three_samples_and_a_null_group(spark):
    rows = [("c1", "c1", "control", 10.0), ("c1", "c1", "control", 20.0), ("c2", "c2", "control", 12.0), ("c2", "c2", "control", 18.0), ("t1", "t1", "treated", 50.0), ("t1", "t1", "treated", 60.0)]
    schema = "sample_name string, sample_id string, `group` string, area double"
    a, b = spark.createDataFrame(rows[:3], schema), spark.createDataFrame(rows[3:], schema).withColumn("other", F.lit(1))
    smp, grp = ex.summarize_experiment([a, b, spark.range(1).toDF("x")], "area")
    s = {r.sample_name: r for r in smp.collect()}
    assert s["c1"]["mean"] == 15 and s["c1"]["median"] == 15 and s["c1"]["std"] == pytest.approx(50**0.5) and s["c1"]["sem"] == pytest.approx(5)
    g = {r.group: r for r in grp.collect()}
    assert (g["control"]["mean"], g["control"].n_samples, g["control"].n_objects) == (15, 2, 4)
    lone = spark.createDataFrame([("a", "a", None, 1.0), ("b", "b", None, None)], schema)
    smp, grp = ex.summarize_experiment(lone, "area")
    r = grp.first()
    assert r.group is None and r.n_samples == 2 and r.n_objects == 2 and r["std"] is None
    assert {x.sample_name: x["count"] for x in smp.collect()} == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        ex.summarize_experiment([spark.range(1)], "area")


def test_upserts(spark):
    old = spark.createDataFrame([("s", "old", "s", 0)], "sample_name string, `group` string, sample_id string, updated_at int")
    new = spark.createDataFrame([(" s ", "  ", "", 2), ("n", "g", "id", 1)], old.schema)
    got = {r.sample_name: (r.group, r.sample_id) for r in ex.upsert_samples(old, new).collect()}
    assert got == {"s": (None, "s"), "n": ("g", "id")}
    with pytest.raises(Exception, match="group must not be empty"):
        ex.upsert_samples(old, new, require_group=True).collect()
    runs = spark.createDataFrame([("run_0007", "a", "pending")], "run_id string, sample_id string, status string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    more = spark.createDataFrame([(None, "b", "failed"), ("run_0007", "a", "complete")], "run_id string, sample_id string, status string").withColumn("updated_at", F.lit("2024-01-02").cast("timestamp"))
    assert {r.run_id: r.status for r in ex.upsert_runs(runs, more).collect()} == {"run_0007": "complete", "run_0008": "failed"}


def test_text_functions(spark):
    color = lambda v: one(spark, text.canonical_color(F.col("a")), a=v)
    assert [color(v) for v in ("GFP", "far red 2", "farred", "mCherry", "Hoechst 33342", "647", "plain", "")] == ["green", "red", "ir", "red", "uv", "ir", None, None]
    assert one(spark, text.normalise_text(F.col("a")), a="Ch.1_GFP  Channel-x") == "ch 1 gfp x"
    assert one(spark, text.canonical_role(F.col("a")), a="Counter") == "counterstain" and one(spark, text.canonical_role(F.col("a")), a="") == "target"
    with pytest.raises(Exception, match="role must be"):
        one(spark, text.canonical_role(F.col("a")), a="banana")
    nm = lambda v: one(spark, text.wavelength_nm(F.col("a")), a=v)
    assert [nm(v) for v in ("488", "0.488", "-3", "x", "")] == [488, 488, None, None, None] and nm("4.88e-7") == pytest.approx(488)
    assert one(spark, text.slugify(F.col("a")), a="my scan (1).ome.tif") == "my_scan_1_ome" and one(spark, text.slugify(F.col("a")), a=".lsm") == "file"
    kinds = [one(spark, text.file_type(F.col("a")), a=v) for v in ("a.OME.TIF", "b.tiff", "c.png")]
    assert kinds == ["ome.tif", "tiff", None]
    assert one(spark, text.preprocess_step(F.col("a")), a="gaussian_denoise") == "gaussian_denoise" and one(spark, text.preprocess_step(F.col("a")), a="off") is None
    with pytest.raises(Exception, match="unknown preprocess"):
        one(spark, text.preprocess_step(F.col("a")), a="sharpen")
    short = one(spark, text.short_inputs(F.col("a")), a=json.dumps({"z": "q" * 80, "b": True, "n": None, "a": 5}))
    assert short == "z='" + "q" * 80 + "', b=True, n=None, a=5"
    pad = text.pad_channels(F.lit(None).cast("array<struct<name:string,excitation_wavelength_nm:double,emission_wavelength_nm:double,color:string>>"), F.lit(2), F.array(F.col("a")))
    assert [(c.name, c.color) for c in one(spark, pad, a="DAPI")] == [("DAPI", "uv"), (None, None)]


def test_metadata_documents(spark):
    ome = '<OME xmlns="u"><Image><Pixels PhysicalSizeX="0.2"><Channel Name="GFP" ExcitationWavelength="488"/><Channel ID="c:1" EmissionWavelength="600"/><Channel/></Pixels></Image></OME>'
    docs = spark.createDataFrame([("a", ome), ("b", "<a><b></a>"), ("c", ""), ("d", None)], "image_id string, xml string")
    size, rows = md.ome_channels(docs)
    assert {r.image_id: r.voxel_x for r in size.collect()} == {"a": 0.2, "b": 1, "c": 1, "d": 1}
    assert [(r.name, r.color) for r in rows.orderBy("channel_index").collect()] == [("GFP", "green"), ("c:1", "red"), ("ch2", None)]
    czi = '<M><Ch><channel ShortName="EGFP" Excitation="405"/><x:CHANNEL xmlns:x="u" Id="z" DetectionWavelength="6.1e-7"></x:CHANNEL><Channels n="1"/></Ch></M>'
    got = md.czi_channels(spark.createDataFrame([("a", czi), ("b", "<a><channel></a>")], "image_id string, xml string")).collect()
    assert [(r.name, r.color) for r in got] == [("EGFP", "uv"), ("z", "red")]
    lsm = {"VoxelSizeX": 2e-7, "ChannelColors": {"ColorNames": ["A", "B"]}, "ScanInformation": {"Tracks": [{"IlluminationChannels": [{"wavelength": 488}, {"Wavelength": 561}], "DataChannels": [{"Name": "GFP"}, {"x": 1}]}]}}
    size, rows = md.lsm_channels(spark.createDataFrame([("a", json.dumps(lsm)), ("b", '{"ChannelColors":{"ColorNames":["DAPI"]}}'), ("c", "{}")], "image_id string, meta string"))
    assert size.where("image_id = 'a'").first().voxel_x == pytest.approx(0.2)
    assert [(r.image_id, r.name, r.color) for r in rows.orderBy("image_id", "channel_index").collect()] == [("a", "GFP", "green"), ("a", "B", "red"), ("b", "DAPI", "uv")]


def test_channel_resolution(spark):
    lay = spark.createDataFrame([("i", "img_a", "image", "GFP"), ("i", "img_b", "image", "DAPI"), ("i", "img_c", "image", "mCherry"), ("j", "only", "image", None), ("k", "x", "image", "GFP"), ("k", "y", "image", "FITC")], LAYERS)
    notes = spark.createDataFrame([("i", "img_b", "counterstain", "uv", "DAPI", None), ("i", "img_c", "target", "red", None, "axons")], CHANNELS)
    req = spark.createDataFrame([(1, "i", "img_a"), (2, "i", "green"), (3, "i", "Axons"), (4, "i", "uv"), (5, "i", "nothing"), (6, "k", "488"), (7, "k", "x")], "request_id int, image_id string, query string")
    got = {r.request_id: (r.layer, r.status) for r in ch.resolve_channel(lay, notes, req).collect()}
    assert got == {1: ("img_a", "resolved"), 2: ("img_a", "resolved"), 3: ("img_c", "resolved"), 4: ("img_b", "resolved"), 5: ("nothing", "unresolved"), 6: (None, "ambiguous"), 7: ("x", "resolved")}
    asked = {r.request_id: (r.layer, r.source, r.status) for r in ch.resolve_target(lay, notes, req).collect()}
    assert asked[1] == ("img_a", "explicit", "ok") and asked[2] == ("img_a", "phrase", "ok") and asked[3] == ("img_c", "annotation", "ok")
    assert asked[4] == (None, None, "ambiguous") and asked[5][2] == "ambiguous"
    free = {r.image_id: (r.layer, r.source, r.status) for r in ch.resolve_target(lay, notes).collect()}
    assert free == {"i": ("img_c", "annotation", "ok"), "j": ("only", "inference", "ok"), "k": (None, None, "ambiguous")}
    ev = spark.createDataFrame([("i", "img_a", "main", "FITC", "m", None, 1)], CHANNELS + ", updated_at int")
    r = ch.annotate(notes.withColumn("updated_at", F.lit(0)), ev, lay).where("layer_name = 'img_a'").first()
    assert (r.role, r.color) == ("target", "green")
    for bad in ({"layer_name": "zz"}, {"color": "pink"}):
        wrong = ev.withColumns({k: F.lit(v) for k, v in bad.items()})
        with pytest.raises(Exception):
            ch.annotate(notes.withColumn("updated_at", F.lit(0)), wrong, lay).collect()


def test_files_round_trip(spark, tmp_path):
    for name, size in (("a.lsm", 3), ("sub/a.tif", 5), ("notes.txt", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    listed = fl.listing(spark, str(tmp_path))
    paths = [str(tmp_path / n) for n in ("a.lsm", "sub/a.tif", "notes.txt", "gone.czi", "a_2.lsm")]
    files = fl.register_files(spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, arrival long"), listed)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert [got[n].file_id for n in ("a.lsm", "notes.txt", "gone.czi")] == ["a", "notes", "gone"]
    ids = [r.file_id for r in files.collect()]
    assert len(set(ids)) == 5 and "a_2" in ids and "a_3" in ids  # a name that is already a generated id moves on
    counts = fl.registration_counts(files).first()
    assert tuple(counts) == (5, 4, 1, 2)
    files, listed = cut(files), cut(listed)
    saved = cut(fl.manifest(files, listed, str(tmp_path)))
    assert saved.where("file_id = 'a'").first().relative_path == "a.lsm"
    (tmp_path / "a.lsm").write_bytes(b"xxxxxx")
    (tmp_path / "notes.txt").unlink()
    diff = {r.file_id: r.load_status for r in fl.manifest_diff(saved, fl.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert diff["a"] == "changed" and diff["notes"] == "missing" and sorted(diff.values()).count("unloaded") == 1
    fix = spark.createDataFrame([("gone", str(tmp_path / "sub/a.tif"))], "file_id string, new_path string")
    r = fl.relink(files, fix, listed).where("file_id = 'gone'").first()
    assert r.original_name == "a.tif" and r.load_status == "unloaded"
    with pytest.raises(Exception, match="file id not found"):
        fl.relink(files, fix.withColumn("file_id", F.lit("zz")), listed).collect()
    assert fl.missing_files(files, listed).count() == 2


def test_tables_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    root = str(tmp_path)
    index = project.save_tables({"my table": (df, {"tool": "t"}), "my/table": (df, {})}, root)
    assert sorted(r.path for r in index.collect()) == ["tables/my_table.parquet", "tables/my_table_2.parquet"]
    back = project.load_tables(spark, root)
    assert back["my table"][0].collect() == df.collect() and back["my table"][1] == {"tool": "t"}
    project.save_snapshot({"samples": df}, root, "s1")
    project.save_snapshot({"samples": df.withColumn("a", F.lit(2))}, root, "s2")
    assert project.load_snapshot(spark, root, "s1")["samples"].first().a == 1 and "qc" not in project.load_snapshot(spark, root, "s2")
    project.export_table(df, root + "/out")
    assert spark.read.csv(root + "/out", header=True).first().b == "x"
    with pytest.raises(ValueError):
        project.export_table(df, root + "/out", "xlsx")


def test_provenance_log_and_report(spark, tmp_path):
    def rec(sec, tool, inputs, ok=True, dur=1.0):
        return (f"2024-01-01 00:00:0{sec}", tool, json.dumps(inputs), None, dur, ok, "test")

    calls = [rec(0, "register_files", {"path": "a"}), rec(1, "rolling_ball", {"radius": 25}, dur=4.2), rec(2, "rolling_ball", {"radius": 25}), rec(3, "manders", {"image_a": "A"}, False), rec(4, "screenshot", {}), rec(5, "measure_intensity", {"image_layers": list(range(30))})]
    rows = spark.createDataFrame(calls, "timestamp string, tool string, inputs string, output_summary string, duration_s double, ok boolean, driver string")
    pv.append(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1), str(tmp_path / "log"))
    (tmp_path / "log" / "broken.json").write_text("\nnot json\n")
    log = pv.read(spark, str(tmp_path / "log")).withColumn("session_id", F.lit("s"))
    assert log.count() == 6 and len(json.loads(log.where("tool = 'measure_intensity'").first().inputs)["image_layers"]) == 30
    assert sorted(r.tool for r in pv.analysis_records(log).collect()) == ["measure_intensity", "register_files", "rolling_ball"]
    t = report.methods_text(log).first().markdown
    assert t.index("Files were listed and registered (path a); the background under a rolling ball was subtracted (radius 25); ") and "overlap" not in t
    assert "3 analysis operations across 3 distinct tools, total compute time 6.2 s." in t
    nothing = report.methods_text(log.where("tool = 'screenshot'")).first().markdown
    assert "No analytical operations" in nothing
    smp = spark.createDataFrame([("s1", "b", 1), ("s2", " ", 0), ("s3", "b", 0)], "sample_name string, `group` string, position int")
    assert {r.group: r.samples for r in ex.group_lines(smp, "position").collect()} == {"b": "s3, s1", "unassigned": "s2"}
    chan = spark.createDataFrame([("i", "L", "target", None, "", "axons")], CHANNELS)
    assert report.channel_rows(chan).first().line == "- **L**: target, unspecified, marker=unspecified, target=axons"
    qc_ = spark.createDataFrame([("a|b", "warning", ["x|y", "z"], True)], "source string, status string, warnings array<string>, reviewed_by_user boolean")
    assert report.qc_rows(qc_).first().line == "| a/b | warning | x/y; z | yes |"
    lines = report.session_report(log, smp, chan, qc_)
    for kind in ("md", "html"):
        report.write_report(lines, str(tmp_path / kind), kind)
        doc = "\n".join(r.value for r in spark.read.text(str(tmp_path / kind)).collect())
        assert "## Quality Control" in doc and ("<pre>" in doc) == (kind == "html")
    with pytest.raises(ValueError):
        report.write_report(lines, str(tmp_path / "x"), "pdf")


def test_recipe_isolates_failures(spark):
    bright = np.zeros((12, 12))
    bright[2:5, 2:5] = 9
    vox = voxels(spark, bright, "g", "a").unionByName(voxels(spark, np.zeros((12, 12)), "g", "b")).unionByName(voxels(spark, bright, "g", "c")).unionByName(voxels(spark, bright, "r", "c"))
    img = images(spark, (12, 12), (1, 0.5, 0.5), "a").unionByName(images(spark, (12, 12), image="b")).unionByName(images(spark, (12, 12), image="c"))
    lay = spark.createDataFrame([("a", "g", "image", None), ("b", "g", "image", None), ("c", "g", "image", None), ("c", "r", "image", None)], LAYERS)
    none = spark.createDataFrame([], CHANNELS)
    smp = spark.createDataFrame([(f"s{i}", f"id{i}", "grp", i, [f"f{i}"], []) for i in "abcd"], "sample_name string, sample_id string, `group` string, image_id string, file_ids array<string>, files array<string>")
    runs, objects = wf.run_recipe({"name": "r"}, smp, vox, img, lay, none)
    got = {r.sample_name: (r.status, r.error) for r in runs.collect()}
    assert got["sa"] == ("complete", None) and got["sb"][0] == "failed" and "zero objects" in got["sb"][1]
    assert got["sc"] == ("failed", "2 candidate layers") and got["sd"] == ("failed", "no image for this sample")
    r = objects.first()
    assert (r.sample_name, r.area, r.mean_intensity_target, r.area_um2, r.source_layer) == ("sa", 9, 9.0, 2.25, "g")
    totals = ex.run_totals(runs).first()
    assert (totals.n_samples, totals.n_complete, totals.n_failed) == (4, 1, 3)
    one_ = wf.analyze_target_cells(vox, img, lay, none, "r", "auto_contrast")
    ok = {r.image_id: (r.ok, r.preprocess) for r in one_.results.collect()}
    assert ok["c"] == (True, "auto_contrast") and ok["a"][0] is False
    films = img.withColumn("size_t", F.when(F.col("image_id") == "c", 2).otherwise(F.col("size_t")))
    film = wf.analyze_target_cells(vox, films, lay, none, "r").results.where("image_id = 'c'").first()
    assert (film.ok, film.stage, film.n_objects) == (False, "segment", 0) and "movie" in film.error
    with pytest.raises(ValueError):
        wf.normalise_step("sharpen")


def test_streamed_time_course_equals_batch(spark, tmp_path):
    frames = [np.full((2, 2), float(i)) for i in range(3)]
    for t, f in enumerate(frames):
        voxels(spark, f, t=t).withColumn("acquired_at", F.lit(f"2024-01-01 00:0{t}:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    roi = spark.createDataFrame([("a", 0, y, x, 1 + x) for y in range(2) for x in range(2)], "image_id string, z int, y int, x int, label int")
    out = timecourse_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), roi)
    q = out.writeStream.outputMode("complete").format("memory").queryName("tc").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.time_index, r.label): (r.area, r.mean_intensity) for r in spark.table("tc").collect()}
    assert got == {(t, k): (2, float(t)) for t in range(3) for k in (1, 2)}


def test_channel_names_of_files(spark):
    vox = spark.createDataFrame([("i", "0", 0, 0, 0, 0, 1.0), ("j", "1", 0, 0, 0, 0, 2.0)], "image_id string, channel string, t int, z int, y int, x int, v double")
    img = spark.createDataFrame([("i", "/d/one.tif", 1, ["DAPI"]), ("j", "/d/two.lsm", 2, ["x"])], "image_id string, path string, n_channels int, channel_names array<string>")
    assert {r.channel for r in ti.name_channels(vox, img).collect()} == {"DAPI", "two_ch1"}
