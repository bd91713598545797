"""Provenance logs: read, append, select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = (
    "timestamp string, tool string, inputs string, output_summary string, "
    "duration_s double, ok boolean, driver string"
)

# Calls that are not analysis steps.
HOUSEKEEPING = [
    "list_layers",
    "get_layer_summary",
    "screenshot",
    "export_table",
    "save_labels",
    "export_script",
    "refresh_measurement",
    "summarize_table",
    "filter_table",
    "set_view",
    "set_colormap",
    "compute_segmentation_qc",
    "compute_measurement_qc",
    "compute_timecourse_qc",
    "create_label_outline",
    "jump_to_object",
    "mark_qc_status",
    "annotate_sample",
    "list_sample_annotations",
    "annotate_channel",
    "list_channel_annotations",
    "resolve_channel",
    "consult_neural_tracer",
    "consult_methods_writer",
    "generate_methods",
    "generate_report",
]


def read(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """JSON-lines logs; blank and malformed lines are dropped.

    ``inputs`` stays a JSON string; the session is the file name.
    """
    raw = spark.read.schema(SCHEMA).json(path, mode="DROPMALFORMED")
    name = F.col("_metadata.file_name")
    out = raw.select("*", F.regexp_replace(name, r"\.jsonl?$", "").alias("session_id"))
    out = out.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))
    return out if session_id is None else out.where(F.col("session_id") == session_id)


def append(rows: DataFrame, path: str) -> None:
    """Append call records as JSON lines with whole inputs and outputs.

    rows: timestamp, tool, inputs, output_summary (JSON strings), duration_s, ok, driver.
    """
    rows.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "tool",
        F.try_parse_json("inputs").alias("inputs"),
        F.try_parse_json("output_summary").alias("output_summary"),
        "duration_s",
        "ok",
        "driver",
    ).write.mode("append").json(path)


def canonical_inputs(json: Column) -> Column:
    """Inputs with sorted keys, for comparing calls."""
    pairs = F.map_entries(F.try_parse_json(json).cast("map<string,variant>"))
    keys = F.array_sort(F.transform(pairs, lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    return F.coalesce(F.to_json(keys), F.lit("[]"))


def analysis_records(log: DataFrame) -> DataFrame:
    """Successful analysis calls, the first of each (session, tool, inputs).

    The first call is taken by a partial ``min`` aggregation, not a window over the
    session.
    """
    done = log.where(F.coalesce("ok", F.lit(True)) & ~F.col("tool").isin(HOUSEKEEPING))
    done = done.withColumn("_inputs", canonical_inputs(F.col("inputs")))
    key = ["session_id", "tool", "_inputs"]
    tie = [c for c in ("event_id", "inputs", "duration_s") if c in done.columns]
    first = F.min_by(F.struct(*[c for c in done.columns if c not in key]), F.struct("timestamp", *tie))
    return done.groupBy(*key).agg(first.alias("r")).select("session_id", "tool", "r.*")


def session_totals(records: DataFrame) -> DataFrame:
    """Operations, distinct tools and summed duration per session."""
    return records.groupBy("session_id").agg(
        F.count("*").alias("n_operations"),
        F.count_distinct("tool").alias("n_tools"),
        F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("total_duration_s"),
    )
