"""Channel names, colours, wavelengths, file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Colour words of annotations and queries, in order of precedence.
COLOR_ALIASES = {
    "green": "green",
    "gfp": "green",
    "fitc": "green",
    "gcamp": "green",
    "488": "green",
    "red": "red",
    "rfp": "red",
    "dsred": "red",
    "mcherry": "red",
    "tritc": "red",
    "cy3": "red",
    "561": "red",
    "568": "red",
    "594": "red",
    "uv": "uv",
    "ultraviolet": "uv",
    "blue": "uv",
    "dapi": "uv",
    "hoechst": "uv",
    "405": "uv",
    "ir": "ir",
    "infrared": "ir",
    "farred": "ir",
    "far red": "ir",
    "far-red": "ir",
    "cy5": "ir",
    "alexa647": "ir",
    "633": "ir",
    "640": "ir",
    "647": "ir",
}

# Role words.
ROLE_ALIASES = {
    "target": "target",
    "primary": "target",
    "main": "target",
    "reporter": "target",
    "counterstain": "counterstain",
    "counter": "counterstain",
    "reference": "counterstain",
    "anatomy": "counterstain",
    "ignore": "ignore",
    "exclude": "ignore",
    "unused": "ignore",
}

# Fluorophore words in file metadata, in order of precedence.
NAME_COLOR_ALIASES = {
    "gfp": "green",
    "fitc": "green",
    "gcamp": "green",
    "488": "green",
    "rfp": "red",
    "dsred": "red",
    "mcherry": "red",
    "tritc": "red",
    "cy3": "red",
    "561": "red",
    "568": "red",
    "594": "red",
    "dapi": "uv",
    "hoechst": "uv",
    "405": "uv",
    "cy5": "ir",
    "alexa647": "ir",
    "farred": "ir",
    "far red": "ir",
    "633": "ir",
    "640": "ir",
    "647": "ir",
}

# Names of the preprocessing steps.
PREPROCESS_ALIASES = {
    "rolling_ball": "rolling_ball",
    "rb": "rolling_ball",
    "background": "rolling_ball",
    "auto_contrast": "auto_contrast",
    "ac": "auto_contrast",
    "contrast": "auto_contrast",
    "gaussian": "gaussian_denoise",
    "gauss": "gaussian_denoise",
    "denoise": "gaussian_denoise",
}

# Supported image file extensions, longest first.
EXTENSIONS = (".ome.tiff", ".ome.tif", ".tiff", ".lsm", ".czi", ".tif")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.try_element_at(pairs, key)


def once(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated a single time, however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _first_contained(table: dict[str, str], text: Column) -> Column:
    """Value of the first alias found in the text or in the text without spaces."""
    pairs = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(v).alias("value")) for a, v in table.items()])
    compact = F.replace(text, F.lit(" "), F.lit(""))
    hits = F.filter(pairs, lambda e: F.contains(text, e["alias"]) | F.contains(compact, e["alias"]))
    return F.get(hits, F.lit(0)).getField("value")


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _spaced(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))


def normalise_text(c: Column) -> Column:
    """Lower case, separators to spaces, without "channel", spaces squeezed (F1)."""
    base = F.replace(_spaced(c), F.lit("channel"), F.lit(" "))
    return _squeeze(F.replace(base, F.lit("ch."), F.lit("ch ")))


def canonical_color(c: Column) -> Column:
    """green / red / uv / ir by exact, compact, then first contained alias (F2)."""
    found = once(
        normalise_text(c),
        lambda t: F.coalesce(
            _lookup(COLOR_ALIASES, t),
            _lookup(COLOR_ALIASES, F.replace(t, F.lit(" "), F.lit(""))),
            _first_contained(COLOR_ALIASES, t),
        ),
    )
    return F.when(F.length(c) > 0, found)


def canonical_role(c: Column) -> Column:
    """target / counterstain / ignore; blank is target, anything else fails."""
    role = _lookup(ROLE_ALIASES, normalise_text(c))
    bad = F.raise_error(F.lit("role must be target, counterstain, or ignore"))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "target").otherwise(F.coalesce(role, bad))


def wavelength_nm(c: Column) -> Column:
    """Nanometres from metres, micrometres or nanometres; null when unusable."""
    v = c.try_cast("double")
    return F.when(v <= 0, None).when(v < 1e-3, v * 1e9).when(v < 10, v * 1000).otherwise(v)


def color_from_wavelengths(excitation: Column, emission: Column) -> Column:
    """Colour band of the emission, else of the excitation."""
    em = F.when(emission < 500, "uv").when(emission < 570, "green").when(emission < 650, "red").otherwise("ir")
    ex = F.when(excitation <= 430, "uv").when(excitation < 520, "green").when(excitation < 600, "red").otherwise("ir")
    return F.when(emission.isNotNull(), em).when(excitation.isNotNull(), ex)


def color_from_name(c: Column) -> Column:
    """Colour of the first fluorophore word contained in a channel name."""
    return once(_squeeze(_spaced(c)), lambda t: _first_contained(NAME_COLOR_ALIASES, t))


def channel_info(name: Column, excitation: Column, emission: Column) -> Column:
    """Struct name, excitation_wavelength_nm, emission_wavelength_nm, color."""
    ex, em = wavelength_nm(excitation), wavelength_nm(emission)
    color = F.coalesce(color_from_wavelengths(ex, em), color_from_name(name))
    return F.struct(
        F.when(F.length(name) > 0, name).alias("name"),
        ex.alias("excitation_wavelength_nm"),
        em.alias("emission_wavelength_nm"),
        color.alias("color"),
    )


def pad_channels(metadata: Column, n_channels: Column, names: Column) -> Column:
    """Exactly ``n_channels`` channel structs; missing ones are made from names (F8)."""
    none = F.lit(None).cast("double")
    spots = F.when(n_channels > 0, F.sequence(F.lit(0), n_channels.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    made = lambda i: channel_info(F.get(F.coalesce(names, F.array().cast("array<string>")), i), none, none)
    return F.transform(spots, lambda i: F.coalesce(F.get(metadata, i), made(i)))


def channel_index(name: Column, channel_names: Column) -> Column:
    """Position of a layer among the channel names, else its ch<d> or digit token."""
    at = F.array_position(F.coalesce(channel_names, F.array().cast("array<string>")), name)
    token = F.get(F.filter(F.split(normalise_text(name), " "), lambda t: t.rlike("^(ch)?[0-9]+$")), F.lit(0))
    digits = F.regexp_extract(token, "([0-9]+)$", 1).try_cast("int")
    return F.when(at > 0, (at - 1).cast("int")).otherwise(digits)


def slugify(c: Column, default: str = "file", strip_extension: bool = True) -> Column:
    """Identifier from a name: other characters become single underscores."""
    base = F.regexp_replace(c, r"\.[^.]*$", "") if strip_extension else c
    slug = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def file_type(name: Column) -> Column:
    """Extension of a supported image file, longest match first; else null."""
    low = F.lower(name)
    out = None
    for ext in EXTENSIONS:
        out = F.when(low.endswith(ext), ext[1:]) if out is None else out.when(low.endswith(ext), ext[1:])
    return out


def preprocess_step(c: Column) -> Column:
    """Canonical preprocessing step; none/off/blank is null, unknown fails."""
    key = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    known = _lookup({**PREPROCESS_ALIASES, "gaussian_denoise": "gaussian_denoise"}, key)
    bad = F.raise_error(F.concat(F.lit("unknown preprocess step "), c))
    return F.when(key.isNotNull() & ~key.isin("", "none", "off"), F.coalesce(known, bad))


def decide_3d(explicit: Column, axes: Column, ndim: Column) -> Column:
    """Explicit choice, else Z without T in the axes, else three dimensions."""
    z_only = F.coalesce(axes.contains("Z") & ~axes.contains("T"), F.lit(False))
    return F.coalesce(explicit, z_only | (ndim == 3))


def python_repr(v: Column) -> Column:
    """A variant value the way it reads in the log: quoted strings, True/False/None."""
    kind = F.schema_of_variant(v)
    text = v.cast("string")
    return (
        F.when(v.isNull() | (kind == "VOID"), "None")
        .when(kind == "STRING", F.concat(F.lit("'"), text, F.lit("'")))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def short_inputs(inputs: Column) -> Column:
    """``k=value`` pairs of a JSON object, values whole."""
    values = F.try_parse_json(inputs).cast("map<string,variant>")

    def pair(key):
        return F.concat(key, F.lit("="), python_repr(F.try_element_at(values, key)))

    keys = F.when(values.isNotNull(), F.json_object_keys(inputs))
    return F.coalesce(F.array_join(F.transform(keys, pair), ", "), F.lit(""))


def html_escape(c: Column) -> Column:
    """Escape markup characters."""
    # Entity names.
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def no_pipes(c: Column) -> Column:
    """Table cells must not contain the column separator."""
    return F.replace(c, F.lit("|"), F.lit("/"))
