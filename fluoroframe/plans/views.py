"""The canonical tables of this library, seen in the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PLATE = "plate"


def _named(name: str, row: str):
    """The image a row belongs to; a value of the row, not a constant of the plan, so
    that joins on image_id stay what they are with many images."""
    return F.when(F.col(row) >= 0, name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plate(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as one image: row = vector, column = position, with its label."""
    e = table(spark, sf, "embeddings")
    px = e.select("vec_id", "label", F.posexplode("embedding").alias("x", "v"))
    return px.select(
        _named(PLATE, "vec_id").alias("image_id"), F.lit("g").alias("channel"), F.lit(0).alias("t"), F.lit(0).alias("z"),
        F.col("vec_id").cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"),
        (F.col("label") + 1).alias("label"),
    )


def vox(spark: SparkSession, sf: str) -> DataFrame:
    return plate(spark, sf).drop("label")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return plate(spark, sf).select("image_id", "t", "z", "y", "x", "label")


def _images(extent: DataFrame, axes: str, scale: tuple[float, float, float], dtype: str = "float32") -> DataFrame:
    return extent.select(
        _named(PLATE, "size_y").alias("image_id"), F.lit("/data/plate.tif").alias("path"), F.lit(axes).alias("axes"),
        "size_t", "size_z", "size_y", "size_x",
        *[F.lit(s).alias(f"voxel_{a}") for a, s in zip("zyx", scale)],
        F.lit(1.5).alias("time_interval_s"), F.lit(dtype).alias("dtype"),
    )


def images(spark: SparkSession, sf: str, scale=(1.0, 0.5, 0.25)) -> DataFrame:
    e = table(spark, sf, "embeddings")
    size = e.agg((F.max("vec_id") + 1).cast("int").alias("size_y"), F.max(F.size("embedding")).alias("size_x"))
    return _images(size.withColumns({"size_t": F.lit(1), "size_z": F.lit(1)}), "YX", scale)


def two_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Left half of the plate as channel a, right half as channel b."""
    half = F.when(F.col("x") < 32, "a").otherwise("b")
    return vox(spark, sf).withColumn("channel", half).withColumn("x", F.col("x") % 32)


def volume(spark: SparkSession, sf: str) -> DataFrame:
    """The plate folded into planes of 50 rows."""
    return vox(spark, sf).withColumn("z", F.expr("cast(y div 50 as int)")).withColumn("y", F.col("y") % 50)


def film(spark: SparkSession, sf: str) -> DataFrame:
    """The plate as 20 interleaved frames, with its labels."""
    return plate(spark, sf).withColumn("t", F.col("y") % 20).withColumn("y", F.expr("cast(y div 20 as int)"))


def film_images(spark: SparkSession, sf: str) -> DataFrame:
    size = film(spark, sf).agg(
        (F.max("t") + 1).alias("size_t"), (F.max("y") + 1).alias("size_y"), (F.max("x") + 1).alias("size_x")
    )
    return _images(size.withColumn("size_z", F.lit(1)), "TYX", (1.0, 1.0, 1.0))


def mask(spark: SparkSession, sf: str, above: float = 0.2) -> DataFrame:
    return vox(spark, sf).where(F.col("v") > above).select("image_id", "t", "z", "y", "x")


def movie(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as voxels of a movie: frame = day, row = user, channel = event type."""
    e = table(spark, sf, "events")
    base = e.select(
        _named("movie", "event_id").alias("image_id"), F.col("event_type").alias("channel"),
        (F.dayofmonth("ts") - 1).alias("t"), F.lit(0).alias("z"), F.col("user_id").cast("int").alias("y"),
        F.col("event_id").cast("int").alias("x"), F.col("value").alias("v"),
    )
    lab = base.select("image_id", "channel", "t", "z", "y", "x", (F.col("y") + 1).alias("label"))
    return base, lab


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as measured objects; supplier = sample, nation = group."""
    # one small table at a time: Spark takes the size of their join for the product of theirs and shuffles the line items
    o = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    o = o.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return o.select(
        F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("area"),
        F.col("l_extendedprice").alias("mean_intensity"), F.col("s_name").alias("sample_name"),
        F.col("s_suppkey").cast("string").alias("sample_id"), F.col("n_name").alias("group"),
    )


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a provenance log: user = session, event type = operation."""
    e = table(spark, sf, "events")
    # one operation with a sentence of its own per event type, one housekeeping call
    tool = (
        F.when(F.col("event_type") == "click", "rolling_ball")
        .when(F.col("event_type") == "view", "max_projection")
        .when(F.col("event_type") == "purchase", "segment_processes")
        .when(F.col("event_type") == "signup", "list_layers")
        .otherwise("gaussian")
    )
    name = (
        F.when(F.col("event_type") == "click", "radius")
        .when(F.col("event_type") == "view", "axis")
        .when(F.col("event_type") == "purchase", "threshold")
        .otherwise("sigma")
    )
    return e.select(
        "event_id", F.col("ts").alias("timestamp"), tool.alias("tool"),
        F.replace(F.col("props"), F.lit('"k"'), F.concat(F.lit('"'), name, F.lit('"'))).alias("inputs"),
        F.col("value").alias("duration_s"), (F.col("event_type") != "error").alias("ok"),
        F.col("user_id").cast("string").alias("session_id"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as object detections in 20 frames."""
    e = table(spark, sf, "embeddings")
    return e.select(
        _named("film", "vec_id").alias("image_id"), (F.col("vec_id") % 20).cast("int").alias("t"),
        F.col("vec_id").cast("int").alias("label"), F.lit(0.0).alias("z"),
        (F.col("embedding")[0].cast("double") * 100).alias("y"), (F.col("embedding")[1].cast("double") * 100).alias("x"),
    )


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as image layers: brand = image, name = layer name, type = marker."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_brand").alias("image_id"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.lit("image").alias("kind"), F.col("p_type").alias("marker"), F.col("p_size").alias("size"), "p_partkey",
    )


def files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Page addresses as requested paths, long pages as the files that exist."""
    p = table(spark, sf, "pages").withColumn("n", F.length("html"))
    kinds = F.array(*[F.lit(k) for k in (".ome.tif", ".TIFF", ".lsm", ".czi", ".png")])
    p = p.withColumn("path", F.concat("url", F.get(kinds, F.col("n") % 5)))
    requests = p.select("path", F.col("page_id").alias("arrival"))
    listed = p.where("n > 1200").groupBy("path").agg(F.max("n").cast("long").alias("length"))
    return requests, listed


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as samples, market segment = group."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_name").alias("sample_name"), F.col("c_custkey").cast("string").alias("sample_id"),
        F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("position"),
    )
