"""Project snapshots and table exports."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from fluoroframe.functions.text import slugify

ENTITIES = ("files", "samples", "channels", "recipes", "runs", "qc")
CATALOG = "name string, path string, format string, n_rows long, n_cols int, columns array<string>, spec string"


def export_table(df: DataFrame, path: str, format: str = "csv") -> None:
    """Write a table as CSV with header (default) or Parquet."""
    if format == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif format == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"format must be 'csv' or 'parquet', got {format!r}")


def save_tables(tables: Mapping[str, tuple[DataFrame, Mapping]], root: str) -> DataFrame:
    """Write every table as Parquet with an index of names, sizes and specs."""
    spark = next(iter(tables.values()))[0].sparkSession
    names = spark.createDataFrame([(n, i) for i, n in enumerate(tables)], "name string, at int")
    stems = {r["name"]: r["stem"] for r in names.select("name", slugify(F.col("name"), "table", False).alias("stem")).collect()}
    used: set[str] = set()
    rows = []
    for name, (df, spec) in tables.items():
        stem, n = stems[name], 2
        while stem in used:
            stem, n = f"{stems[name]}_{n}", n + 1
        used.add(stem)
        path = f"tables/{stem}.parquet"
        df.write.mode("overwrite").parquet(f"{root}/{path}")
        n_rows = spark.read.parquet(f"{root}/{path}").count()
        rows.append((name, path, "parquet", n_rows, len(df.columns), df.columns, json.dumps(dict(spec))))
    index = spark.createDataFrame(rows, CATALOG)
    index.write.mode("overwrite").parquet(f"{root}/tables/index.parquet")
    return index


def load_tables(spark: SparkSession, root: str) -> dict[str, tuple[DataFrame, dict]]:
    """Tables of a saved project; entries whose files are gone are skipped."""
    out = {}
    # the index has one row per table name, not per data row
    for r in spark.read.schema(CATALOG).parquet(f"{root}/tables/index.parquet").collect():
        try:
            out[r["name"]] = (spark.read.parquet(f"{root}/{r['path']}"), json.loads(r["spec"] or "{}"))
        except AnalysisException:
            continue
    return out


def save_snapshot(entities: Mapping[str, DataFrame], root: str, snapshot_id: str) -> None:
    """One Parquet dataset per entity, partitioned by snapshot.

    Only the snapshot's own partition is replaced.
    """
    unknown = set(entities) - set(ENTITIES)
    if unknown:
        raise ValueError(f"unknown entities {sorted(unknown)}")
    for name, df in entities.items():
        df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("snapshot_id").parquet(f"{root}/{name}")


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> dict[str, DataFrame]:
    """Entities of one snapshot; an entity never saved is absent."""
    out = {}
    for name in ENTITIES:
        try:
            df = spark.read.parquet(f"{root}/{name}")
        except AnalysisException:
            continue
        out[name] = df.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    return out


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Write text lines in order: a range-partitioned sort, so the part files read in
    name order give the document.  Nothing is gathered into one task."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_trace_csv(nodes: DataFrame, edges: DataFrame, branches: DataFrame, path: str) -> None:
    """Node, edge and branch tables as CSV, one folder per trace."""
    for name, df in (("nodes", nodes), ("edges", edges), ("branches", branches)):
        hidden = [c for c in ("pid", "src", "dst") if c in df.columns]
        df.drop(*hidden).write.mode("overwrite").partitionBy("trace_id").csv(f"{path}/{name}", header=True)


def swc_lines(rows: DataFrame) -> DataFrame:
    """SWC text per node."""
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    line = F.concat_ws(
        " ", F.col("id").cast("string"), F.col("type").cast("string"), number("x"), number("y"), number("z"),
        F.format_string("%.1f", F.col("radius")), F.col("parent").cast("string"),
    )
    return rows.select("trace_id", "id", line.alias("line"))


def write_swc(rows: DataFrame, path: str) -> None:
    """SWC text files, one folder per trace, sorted by node id."""
    # Comment lines at the top of every file.
    head = [
        "# SWC export",
        "# type 3 is used for all process nodes; radius is a placeholder.",
        "# If no soma was annotated, the root is the first endpoint or node.",
    ]
    notes = rows.select("trace_id").distinct().select(
        "trace_id", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("at", "line")
    )
    notes = notes.select("trace_id", (F.col("at") - len(head)).cast("long").alias("id"), "line")
    text = swc_lines(rows).withColumn("id", F.col("id").cast("long")).unionByName(notes)
    ordered = text.repartitionByRange("trace_id", "id").sortWithinPartitions("trace_id", "id")
    ordered.select("trace_id", "line").write.mode("overwrite").partitionBy("trace_id").text(path)


def write_skeleton_tiles(skel: DataFrame, path: str) -> None:
    """Skeleton raster as tiles with value 255 (S21); tiles without skeleton are not stored."""
    skeleton_tiles(skel).write.mode("overwrite").partitionBy("image_id").parquet(path)


def skeleton_tiles(skel: DataFrame, side: int = 256) -> DataFrame:
    keyed = skel.select(
        "image_id", "t", "z",
        F.expr(f"cast(y div {side} as int)").alias("ty"), F.expr(f"cast(x div {side} as int)").alias("tx"),
        F.expr(f"cast((y % {side}) * {side} + x % {side} as int)").alias("at"),
    )
    cells = keyed.groupBy("image_id", "t", "z", "ty", "tx").agg(F.array_sort(F.collect_set("at")).alias("on"))
    # dense raster from the sorted positions: zero runs between them, so the work is
    # linear in the tile size
    data = F.expr(
        "concat(flatten(transform(on, (p, i) -> concat("
        "array_repeat(0F, p - (CASE WHEN i = 0 THEN 0 ELSE on[i - 1] + 1 END)), array(255F)))), "
        f"array_repeat(0F, {side * side - 1} - element_at(on, -1)))"
    )
    return cells.select(
        "image_id", F.lit("skeleton").alias("channel"), "t", "z", "ty", "tx",
        (F.col("ty") * side).alias("y0"), (F.col("tx") * side).alias("x0"),
        F.lit(side).alias("h"), F.lit(side).alias("w"), data.alias("data"),
    )
