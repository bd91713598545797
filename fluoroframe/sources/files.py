"""File listings, registration, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluoroframe.functions.text import file_type, slugify
from fluoroframe.plans.cut import cut
from fluoroframe.plans.ranks import number_rows


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of the files below a folder; contents unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(path).select("path", "length", "modificationTime")
    return found.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def unique_ids(rows: DataFrame, slug: str, arrival: str, name: str, first_suffix: int = 2) -> DataFrame:
    """``slug`` for the first arrival, ``slug_2``, ``slug_3``, ... for later ones.

    Numbering goes over arrival blocks, so a slug shared by a third of the files is
    not ranked in one task.  An id that equals another row's own slug moves on to the
    next free suffix in a further pass.
    """
    block = rows.withColumn("_block", F.expr(f"{arrival} div 1000000"))
    ranked = number_rows(block, [slug], ["_block", arrival], "_rank", start=1).drop("_block")
    ranked = ranked.withColumn("_suffix", F.col("_rank") + first_suffix - 2)
    label = F.when(F.col("_rank") == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("_"), F.col("_suffix").cast("string")))
    ranked = cut(ranked.withColumn(name, label))
    while True:
        # of all rows that claim one id, its natural owner or the earliest keeps it
        keeper = ranked.groupBy(name).agg(
            F.min(F.struct((F.col("_rank") > 1).alias("made"), F.col(arrival).alias("a"))).alias("_keep"),
            F.count("*").alias("_claims"),
        ).where("_claims > 1")
        if not keeper.limit(1).count():
            return ranked.drop("_rank", "_suffix")
        marked = ranked.join(keeper.select(name, F.col("_keep.a").alias("_a")), name, "left")
        lost = F.coalesce(F.col("_a") != F.col(arrival), F.lit(False))
        # rows of the same slug after a displaced one shift as well
        first_lost = marked.where(lost).groupBy(slug).agg(F.min("_suffix").alias("_from"))
        moved = marked.drop("_a").join(first_lost, slug, "left")
        shift = F.when((F.col("_rank") > 1) & (F.col("_suffix") >= F.col("_from")), 1).otherwise(0)
        moved = moved.withColumn("_suffix", F.col("_suffix") + F.coalesce(shift, F.lit(0))).drop("_from", name)
        ranked = cut(moved.withColumn(name, label).select(*ranked.columns))


def register_files(requests: DataFrame, listed: DataFrame) -> DataFrame:
    """Register paths without reading them (S3).

    requests: path, arrival (order number).  File names are never parsed into groups.
    """
    kind = file_type(F.col("original_name"))
    rows = requests.select("path", "arrival", file_name("path").alias("original_name"))
    rows = rows.withColumn("_slug", slugify(F.col("original_name")))
    ids = unique_ids(rows, "_slug", "arrival", "file_id")
    there = listed.select("path", F.lit(True).alias("_there")).distinct()
    out = ids.join(there, "path", "left")
    return out.select(
        "file_id",
        "path",
        "original_name",
        kind.alias("file_type"),
        kind.isNotNull().alias("supported"),
        F.coalesce("_there", F.lit(False)).alias("exists"),
        F.lit("unloaded").alias("load_status"),
        "arrival",
    )


def registration_counts(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("n_registered"),
        F.count_if("supported").alias("n_supported"),
        F.count_if(~F.col("supported")).alias("n_unsupported"),
        F.count_if(~F.col("exists")).alias("n_missing"),
    )


def resolve_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Match sample files by path, then by id.

    samples: sample_name, files ARRAY<STRING>, file_ids ARRAY<STRING> [, records
    ARRAY<STRING>].  A path stays one path and gets one id at most, however many records
    share it: the id at its place in ``records`` if that record has the path, else the
    record of the latest ``arrival`` (largest id without that column).  Unmatched paths
    stay without an id; paths of given ids are added.
    """
    none = F.array().cast("array<string>")
    base = samples.withColumn("files", F.coalesce("files", none)).withColumn("file_ids", F.coalesce("file_ids", none))
    known = files.select("path", "file_id")
    last = files.groupBy("path").agg(F.max_by("file_id", "arrival" if "arrival" in files.columns else "file_id").alias("_last"))
    meant = F.get("records", F.col("pos")) if "records" in samples.columns else F.lit(None).cast("string")
    named = known.select("path", F.col("file_id").alias("_meant"), F.lit(True).alias("_named")).distinct()
    by_path = (
        base.select("*", F.posexplode("files").alias("pos", "path"))
        .select("sample_name", "pos", "path", meant.alias("_meant"))
        .join(named, ["path", "_meant"], "left")
        .join(last, "path", "left")
        .withColumn("file_id", F.when(F.col("_named"), F.col("_meant")).otherwise(F.col("_last")))
        .groupBy("sample_name")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "path", "file_id"))).alias("m"))
    )
    by_id = (
        base.select("sample_name", F.posexplode("file_ids").alias("pos", "file_id"))
        .join(known, "file_id")
        .groupBy("sample_name")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("r"))
    )
    out = base.join(by_path, "sample_name", "left").join(by_id, "sample_name", "left")
    paths = F.coalesce(F.col("m.path"), none)
    ids = F.filter(F.coalesce(F.col("m.file_id"), none), lambda i: i.isNotNull())
    extra = F.filter(F.coalesce(F.col("r.path"), none), lambda p: ~F.array_contains(paths, p))
    return out.withColumns(
        {
            "file_ids": F.concat("file_ids", F.filter(F.array_distinct(ids), lambda i: ~F.array_contains(F.col("file_ids"), i))),
            "files": F.concat(paths, F.array_distinct(extra)),
        }
    ).drop("m", "r", "records")


def manifest(files: DataFrame, listed: DataFrame, root: str) -> DataFrame:
    """Saved file records with existence, size, time and path below the root."""
    base = root.rstrip("/") + "/"
    seen = listed.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"), F.lit(True).alias("_there")
    )
    inside = F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 1 << 20))
    out = files.drop("exists", "size_bytes", "modified_time", "relative_path").join(seen, "path", "left")
    return out.withColumns(
        {
            "original_path": F.col("path"),
            "relative_path": inside,
            "exists": F.coalesce("_there", F.lit(False)),
        }
    ).drop("_there")


def manifest_diff(saved: DataFrame, listed: DataFrame, root: str) -> DataFrame:
    """Load status of saved records: missing, changed or unloaded, with a warning."""
    base = root.rstrip("/") + "/"
    seen = listed.select("path", "length")
    first = F.coalesce("original_path", "path")
    rec = saved.withColumns({"_one": first, "_two": F.concat(F.lit(base), "relative_path")})
    out = rec.join(seen.toDF("_one", "_l1"), "_one", "left").join(seen.toDF("_two", "_l2"), "_two", "left")
    there = F.col("_l1").isNotNull() | F.col("_l2").isNotNull()
    now = F.coalesce("_l1", "_l2")
    path = F.when(F.col("_l1").isNotNull(), F.col("_one")).when(F.col("_l2").isNotNull(), F.col("_two")).otherwise(F.col("_one"))
    changed = F.col("size_bytes").isNotNull() & (F.col("size_bytes") != now)
    status = F.when(~there, "missing").when(changed, "changed").otherwise("unloaded")
    warn = F.when(~there, F.concat(F.lit("missing raw file for "), "file_id", F.lit(": "), path)).when(
        changed, F.concat(F.lit("raw file size changed for "), "file_id", F.lit(": "), path)
    )
    out = out.withColumns({"load_status": status, "warning": warn, "path": path})
    return out.drop("_one", "_two", "_l1", "_l2")


def relink(files: DataFrame, corrections: DataFrame, listed: DataFrame) -> DataFrame:
    """Replace path and name of files; status unloaded or missing.

    corrections: file_id, new_path.  An id that is not registered is an error.
    """
    there = listed.select(F.col("path").alias("new_path"), F.lit(True).alias("_there"))
    fix = corrections.join(there, "new_path", "left").withColumn("_fix", F.lit(True))
    out = files.withColumn("_known", F.lit(True)).join(fix, "file_id", "full_outer")
    bad = F.raise_error(F.concat(F.lit("file id not found: "), F.col("file_id")))
    out = out.withColumn("file_id", F.when(F.col("_known"), F.col("file_id")).otherwise(bad))
    status = F.when(F.col("_there"), "unloaded").otherwise("missing")
    new = {
        "path": F.when(F.col("_fix"), F.col("new_path")).otherwise(F.col("path")),
        "original_name": F.when(F.col("_fix"), file_name("new_path")).otherwise(F.col("original_name")),
        "load_status": F.when(F.col("_fix"), status).otherwise(F.col("load_status")),
    }
    return out.withColumns(new).select(*files.columns)


def update_status(files: DataFrame, events: DataFrame) -> DataFrame:
    """Latest load status per file; notes change only when given."""
    last = events.groupBy("file_id").agg(
        F.max_by("status", "updated_at").alias("_s"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("updated_at"))).alias("_n"),
    )
    out = files.join(last, "file_id", "left")
    new = {"load_status": F.coalesce("_s", "load_status"), "notes": F.coalesce("_n", "notes")}
    return out.withColumns(new).select(*files.columns)


def project_status(entities: dict[str, DataFrame]) -> DataFrame:
    """Row count per entity table."""
    out = None
    for name, df in entities.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("entity"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def missing_files(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Registered files whose path is not in the listing."""
    return files.join(listed.select("path"), "path", "left_anti")


def summary_lines(entities: dict[str, DataFrame], samples: DataFrame) -> DataFrame:
    """Lines of the project summary: counts first, then one line per sample."""
    counts = project_status(entities)
    head = counts.select(
        F.lit(0).alias("part"), F.col("entity").alias("position"),
        F.concat(F.lit("- "), "entity", F.lit(": "), F.col("n_rows").cast("string")).alias("line"),
    )
    group = F.coalesce(F.nullif(F.trim("group"), F.lit("")), F.lit("ungrouped"))
    body = samples.select(
        F.lit(1).alias("part"), F.col("sample_name").alias("position"),
        F.concat(F.lit("- "), "sample_name", F.lit(": "), group).alias("line"),
    )
    return head.unionByName(body)
