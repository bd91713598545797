"""Channel tables from metadata documents held in a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.functions.text import channel_info

_OME_CHANNEL = (
    "array<struct<_ID: string, _Name: string, _ExcitationWavelength: string, _EmissionWavelength: string, "
    "_ExcitationWavelengthUnit: string, _EmissionWavelengthUnit: string>>"
)
_OME_PIXELS = (
    "struct<_PhysicalSizeZ: double, _PhysicalSizeY: double, _PhysicalSizeX: double, "
    f"Channel: {_OME_CHANNEL}>"
)
_OME = f"Image array<struct<Pixels: {_OME_PIXELS}>>, Pixels {_OME_PIXELS}"


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def ome_channels(docs: DataFrame, key: str = "image_id", xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """Voxel sizes per document (1.0 by default) and one row per channel.

    Empty or malformed documents give the defaults and no channels.
    """
    parsed = F.from_xml(F.col(xml), _OME, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    doc = docs.select(key, parsed.alias("d"))
    doc = doc.select(key, F.coalesce(F.get("d.Image.Pixels", F.lit(0)), F.col("d.Pixels")).alias("p"))
    size = lambda a: F.coalesce(F.col(f"p._PhysicalSize{a}"), F.lit(1.0)).alias(f"voxel_{a.lower()}")
    voxels = doc.select(key, *[size(a) for a in "ZYX"])
    rows = doc.select(key, F.posexplode("p.Channel").alias("channel_index", "c"))
    numbered = F.concat(F.lit("ch"), F.col("channel_index").cast("string"))
    name = F.coalesce(_text(F.col("c._Name")), _text(F.col("c._ID")), numbered)
    info = channel_info(name, F.col("c._ExcitationWavelength"), F.col("c._EmissionWavelength"))
    channels = rows.select(
        key,
        "channel_index",
        info.alias("info"),
        F.col("c._ExcitationWavelengthUnit").alias("excitation_wavelength_unit"),
        F.col("c._EmissionWavelengthUnit").alias("emission_wavelength_unit"),
    )
    return voxels, channels.select(
        key, "channel_index", "info.*", "excitation_wavelength_unit", "emission_wavelength_unit"
    )


def czi_channels(docs: DataFrame, key: str = "image_id", xml: str = "xml") -> DataFrame:
    """One row per element called channel at any depth, any prefix or letter case."""
    whole = F.from_xml(F.col(xml), "_bad string, _none string", {"columnNameOfCorruptRecord": "_bad"})
    good = F.when(F.col(xml).isNotNull() & (F.length(F.trim(xml)) > 0) & whole.getField("_bad").isNull(), F.col(xml))
    plain = F.regexp_replace(good, r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(plain, F.lit(r"(?is)<(?:[\w.\-]+:)?channel(\s[^>]*|/?)>"), F.lit(1))
    rows = docs.select(key, F.posexplode(tags).alias("channel_index", "a"))

    def first(names: Sequence[str]) -> Column:
        values = [F.regexp_extract("a", rf"(?s)\s{n}\s*=\s*[\"']([^\"']*)[\"']", 1) for n in names]
        return F.coalesce(*[_text(v) for v in values])

    # Attribute names in order of preference.
    name = first(["Name", "ShortName", "Id"])
    excitation = first(["ExcitationWavelength", "Excitation", "LaserWavelength"])
    emission = first(["EmissionWavelength", "Emission", "DetectionWavelength"])
    return rows.select(key, "channel_index", channel_info(name, excitation, emission).alias("info")).select(
        key, "channel_index", "info.*"
    )


_LSM = (
    "VoxelSizeX double, VoxelSizeY double, VoxelSizeZ double, "
    "ChannelColors struct<ColorNames: array<string>>, "
    "ScanInformation struct<Tracks: array<struct<"
    "IlluminationChannels: array<map<string, string>>, DataChannels: array<map<string, string>>>>>"
)


def _pick(m: Column, names: Sequence[str]) -> Column:
    """First present key: exact spelling, then any letter case."""

    def any_case(n):
        same = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == n.lower())
        return F.get(same, F.lit(0)).getField("value")

    return F.coalesce(*[c for n in names for c in (F.try_element_at(m, F.lit(n)), any_case(n))])


def lsm_channels(docs: DataFrame, key: str = "image_id", json: str = "meta") -> tuple[DataFrame, DataFrame]:
    """Voxel sizes in micrometres and one row per channel from scan metadata.

    Data channels of all tracks count through; a missing name comes from the colour
    names at the same position, a missing excitation from the illumination line at the
    same position of the track.  Without data channels the colour names are the rows.
    """
    doc = docs.select(key, F.from_json(json, _LSM).alias("d")).select(key, "d.*")
    um = lambda a: (F.coalesce(F.col(f"VoxelSize{a}"), F.lit(1e-6)) * 1e6).alias(f"voxel_{a.lower()}")
    voxels = doc.select(key, *[um(a) for a in "ZYX"])
    none = F.array().cast("array<map<string,string>>")
    tracks = F.coalesce("ScanInformation.Tracks", F.array().cast(dict(doc.select("ScanInformation.Tracks").dtypes)["Tracks"]))
    # Key names in order of preference.
    lines = ["Wavelength", "LaserWavelength", "ExcitationWavelength"]
    names = ["Name", "DyeName", "ChannelName"]
    excitation = ["ExcitationWavelength", "LaserWavelength", "IlluminationWavelength"]
    emission = ["EmissionWavelength", "DetectionWavelength", "AcquisitionWavelength"]

    def of_track(t):
        illum = F.coalesce(t["IlluminationChannels"], none)
        return F.transform(
            F.coalesce(t["DataChannels"], none),
            lambda c, i: F.struct(
                _pick(c, names).alias("name"),
                F.coalesce(_pick(c, excitation), _pick(F.get(illum, i), lines)).alias("ex"),
                _pick(c, emission).alias("em"),
                F.try_element_at(c, F.lit("Name")).alias("plain"),
            ),
        )

    found = doc.select(
        key,
        F.flatten(F.transform(tracks, of_track)).alias("found"),
        F.coalesce("ChannelColors.ColorNames", F.array().cast("array<string>")).alias("colors"),
    )
    plain = F.filter(F.transform("found", lambda c: _text(c["plain"])), lambda s: s.isNotNull())
    listed = found.withColumn("listed", F.when(F.size("colors") > 0, F.col("colors")).otherwise(plain))
    empty = lambda n: F.struct(n.alias("name"), *[F.lit(None).cast("string").alias(x) for x in ("ex", "em", "plain")])
    rows = F.when(F.size("found") > 0, F.col("found")).otherwise(F.transform("listed", empty))
    out = listed.select(key, "listed", F.posexplode(rows).alias("channel_index", "c"))
    name = F.coalesce(_text(F.col("c.name")), F.get("listed", "channel_index"))
    info = channel_info(name, F.col("c.ex"), F.col("c.em"))
    return voxels, out.select(key, "channel_index", info.alias("info")).select(key, "channel_index", "info.*")
