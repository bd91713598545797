"""Channel annotation and resolution.

layers:   image_id, name, kind [, channel_name, marker, color, wavelength, excitation,
          excitation_wavelength_nm, emission_wavelength_nm, channel_names,
          channel_metadata ARRAY<STRUCT>]
channels: image_id, layer_name, role, color, marker, biological_target, notes
requests: request_id, image_id, query
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.functions.text import COLOR_ALIASES, canonical_color, canonical_role, channel_index, normalise_text
from fluoroframe.plans.cut import cut

# Characters at the start of a word by which texts are searched for it.
HEAD = 3

_INFO = ("name", "channel_name", "marker", "color", "excitation_wavelength_nm", "emission_wavelength_nm")


def _has(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")


def layer_metadata(layers: DataFrame) -> DataFrame:
    """layers with ``layer_color`` and ``layer_text`` (M8).

    The struct of the layer's own channel is used when there is one, else the flat
    columns.  Colour: colour field, then name, channel name and marker, then any alias
    in the text.
    """
    info: dict[str, Column] = {c: _has(layers, c) for c in _INFO if c != "name"}
    info["name"] = F.lit(None).cast("string")
    if "channel_metadata" in layers.columns:
        names = F.col("channel_names") if "channel_names" in layers.columns else F.lit(None).cast("array<string>")
        own = F.get("channel_metadata", channel_index(F.col("name"), names))
        element = layers.schema["channel_metadata"].dataType.elementType
        fields = set(element.names)
        for c in _INFO:
            mine = own.getField(c).cast("string") if c in fields else F.lit(None).cast("string")
            info[c] = F.when(own.isNotNull(), mine).otherwise(info[c])
    flat = [_has(layers, c) for c in ("channel_name", "marker", "color", "wavelength", "excitation")]
    own_text = [info[c] for c in ("name", "marker", "color", "excitation_wavelength_nm", "emission_wavelength_nm")]
    text = F.concat_ws(" ", F.col("name"), *flat, *own_text)
    color = F.coalesce(*[canonical_color(info[c]) for c in ("color", "name", "channel_name", "marker")], canonical_color(text))
    return layers.withColumns({"layer_color": color, "layer_text": text})


def annotate(channels: DataFrame, events: DataFrame, layers: DataFrame, order: str = "updated_at") -> DataFrame:
    """Validated upsert of channel annotations (M5).

    An unknown layer, role or colour word is an error.
    """
    known = layers.select("image_id", F.col("name").alias("layer_name"), F.lit(True).alias("_known")).distinct()
    ev = events.join(known, ["image_id", "layer_name"], "left")
    missing = F.raise_error(F.concat(F.lit("layer not found: "), F.col("layer_name")))
    color = canonical_color(F.col("color"))
    bad = F.raise_error(F.concat(F.lit("color must be one of green, red, uv, or ir: "), F.col("color")))
    ev = ev.withColumns(
        {
            "layer_name": F.when(F.col("_known"), F.col("layer_name")).otherwise(missing),
            "role": canonical_role(F.col("role")),
            "color": F.when((F.length("color") > 0) & color.isNull(), bad).otherwise(color),
        }
    ).drop("_known")
    both = channels.unionByName(ev, allowMissingColumns=True)
    key = ["image_id", "layer_name"]
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def _keys(df: DataFrame, layer: str, words: list[Column], color: Column, rank: int) -> DataFrame:
    """(image_id, key) -> how many layers answer to it, and the first of them."""
    tags = [F.struct(F.lit("w").alias("kind"), normalise_text(w).alias("key")) for w in words]
    tags.append(F.struct(F.lit("c").alias("kind"), color.alias("key")))
    rows = df.select("image_id", F.col(layer).alias("layer"), F.explode(F.array(*tags)).alias("k"))
    rows = rows.where("k.key IS NOT NULL AND k.key != ''").select("image_id", "layer", "k.kind", "k.key").distinct()
    return rows.withColumn("rank", F.lit(rank))


def _noted(channels: DataFrame) -> DataFrame:
    words = [F.col(c) for c in ("layer_name", "color", "marker", "role", "biological_target") if c in channels.columns]
    return _keys(channels, "layer_name", words, F.col("color"), 2)


def _hued(meta: DataFrame) -> DataFrame:
    return meta.where("layer_color IS NOT NULL").select("image_id", F.col("name").alias("layer"), F.col("layer_color").alias("hue")).distinct()


def _containing(meta: DataFrame, words: DataFrame) -> DataFrame:
    """(image_id, word, layer) of the words that a layer's text contains.

    A text is cut into the pieces that begin like a word of its image (by ``HEAD``
    characters) and are as long as that word; pieces then equal whole words.  Rows grow
    with the characters of the texts, never with texts times words.
    """
    words = cut(words.distinct())
    size = F.length("word")
    heads = cut(words.select("image_id", F.least(size, F.lit(HEAD)).alias("q"), F.substring("word", 1, HEAD).alias("head"), size.alias("n")).distinct())
    texts = meta.select("image_id", F.col("name").alias("layer"), normalise_text(F.col("layer_text")).alias("text"))
    # few bytes and much work: a given number of partitions is not merged into one task
    texts = texts.repartition(int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "image_id", "layer", "text").distinct()
    pieces = None
    for (q,) in sorted(heads.select("q").distinct().collect()):  # HEAD rows at most
        spots = texts.where(F.length("text") >= q).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text") - (q - 1))))
        spots = spots.withColumn("head", F.col("text").substr(F.col("at"), F.lit(q)))
        cuts = spots.join(heads.where(F.col("q") == q).drop("q"), ["image_id", "head"]).where("at + n - 1 <= length(text)")
        cuts = cuts.select("image_id", "layer", F.col("text").substr(F.col("at"), F.col("n")).alias("word"))
        pieces = cuts if pieces is None else pieces.unionByName(cuts)
    if pieces is None:
        return words.join(texts.select("image_id", "layer").limit(0), "image_id").select("image_id", "word", "layer")
    return pieces.join(words, ["image_id", "word"]).select("image_id", "word", "layer").distinct()


def candidates(layers: DataFrame, channels: DataFrame, requests: DataFrame) -> DataFrame:
    """Layers that answer a request at its best rank: request_id, layer, rank (M6).

    Ranks: 1 exact name, 2 annotation word or colour, 3 colour found in the metadata,
    4 metadata text contains the query.  Ranks 1-3 are equi-joins on words; the text
    search only runs for requests that none of them answered.  One row per match: a
    colour asked for by many requests and worn by many layers is their product, which
    ``resolve_channel`` counts without making it.
    """
    meta = layer_metadata(layers)
    req = requests.select(
        "request_id", "image_id", "query", normalise_text(F.col("query")).alias("word"), canonical_color(F.col("query")).alias("hue")
    )
    own = layers.select("image_id", F.col("name").alias("query"), F.col("name").alias("layer")).distinct()
    exact = req.join(own, ["image_id", "query"]).select("request_id", "layer", F.lit(1).alias("rank"))
    hued = _hued(meta).select("image_id", "layer", F.lit("c").alias("kind"), F.col("hue").alias("key"), F.lit(3).alias("rank"))
    asked = req.select(
        "request_id", "image_id",
        F.explode(F.array(F.struct(F.lit("w").alias("kind"), F.col("word").alias("key")), F.struct(F.lit("c").alias("kind"), F.col("hue").alias("key")))).alias("a"),
    ).select("request_id", "image_id", "a.kind", "a.key").where("key IS NOT NULL")
    by_word = asked.join(_noted(channels).unionByName(hued), ["image_id", "kind", "key"]).select("request_id", "layer", "rank")
    found = exact.unionByName(by_word)
    best = found.groupBy("request_id").agg(F.min("rank").alias("rank"))
    first = found.join(best, ["request_id", "rank"]).distinct()
    open_ = req.join(best.select("request_id"), "request_id", "left_anti").where("word != ''")
    loose = open_.join(_containing(meta, open_.select("image_id", "word")), ["image_id", "word"])
    return first.select("request_id", "layer", "rank").unionByName(
        loose.select("request_id", "layer", F.lit(4).alias("rank")).distinct()
    )


def _answers(layers: DataFrame, channels: DataFrame, requests: DataFrame) -> DataFrame:
    """image_id, query -> n_matches, _layer, rank, for every distinct query.

    Matches are counted per word and per colour before they meet a query.  The layers
    that answer by word, by colour or both are the two counts less the common one.
    """
    meta = layer_metadata(layers)
    asked = requests.select("image_id", "query").distinct()
    asked = asked.withColumns({"word": normalise_text(F.col("query")), "hue": canonical_color(F.col("query"))})
    own = layers.select("image_id", F.col("name").alias("query"), F.lit(True).alias("_own")).distinct()
    noted = _noted(channels)
    words = noted.where("kind = 'w'").select("image_id", "layer", F.col("key").alias("word"))
    hues = noted.where("kind = 'c'").where(F.col("key").isin(*set(COLOR_ALIASES.values()))).select("image_id", "layer", F.col("key").alias("hue"))

    def count(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("layer").alias(f"n_{name}"), F.min("layer").alias(f"l_{name}"))

    known = asked.join(own, ["image_id", "query"], "left")
    known = known.join(count(words, ["image_id", "word"], "word"), ["image_id", "word"], "left")
    known = known.join(count(hues, ["image_id", "hue"], "hue"), ["image_id", "hue"], "left")
    known = known.join(count(words.join(hues, ["image_id", "layer"]), ["image_id", "word", "hue"], "both"), ["image_id", "word", "hue"], "left")
    known = cut(known.join(count(_hued(meta), ["image_id", "hue"], "meta"), ["image_id", "hue"], "left"))
    noted_ = F.col("n_word").isNotNull() | F.col("n_hue").isNotNull()
    rank = F.when(F.col("_own"), 1).when(noted_, 2).when(F.col("n_meta").isNotNull(), 3)
    loose = _containing(meta, known.where(rank.isNull() & (F.col("word") != "")).select("image_id", "word"))
    known = known.withColumn("rank", rank)
    known = known.join(count(loose, ["image_id", "word"], "text"), ["image_id", "word"], "left")
    n = lambda name: F.coalesce(F.col(f"n_{name}"), F.lit(0))
    r = F.coalesce("rank", F.when(F.col("n_text").isNotNull(), 4))
    pick = lambda own_, noted2, hue, text: F.when(r == 1, own_).when(r == 2, noted2).when(r == 3, hue).when(r == 4, text)
    return known.select(
        "image_id", "query",
        pick(F.lit(1).cast("long"), n("word") + n("hue") - n("both"), n("meta"), n("text")).alias("n_matches"),
        pick(F.col("query"), F.least("l_word", "l_hue"), F.col("l_meta"), F.col("l_text")).alias("_layer"),
        r.alias("rank"),
    )


def resolve_channel(layers: DataFrame, channels: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: the layer, how many matched, and the status (M6).

    One match resolves; several are ambiguous (layer null, list them with
    ``candidates``); none returns the query itself, unresolved.  A request is known by
    its own ``request_id``.
    """
    hits = _answers(layers, channels, requests.where("request_id IS NOT NULL"))
    hits = hits.where("rank IS NOT NULL").withColumn("_id", F.lit(True))
    out = requests.withColumn("_id", F.when(F.col("request_id").isNotNull(), True))
    out = out.join(hits, ["image_id", "query", "_id"], "left").na.fill(0, ["n_matches"])
    n = F.col("n_matches")
    return out.select(
        "request_id", "image_id", "query",
        F.when(n == 1, F.col("_layer")).when(n == 0, F.col("query")).alias("layer"),
        "n_matches", "rank",
        F.when(n == 1, "resolved").when(n == 0, "unresolved").otherwise("ambiguous").alias("status"),
    )


def target_candidates(layers: DataFrame, channels: DataFrame) -> DataFrame:
    """Image layers that may be picked as target: not annotated otherwise (M7)."""
    off = channels.where(F.col("role").isin("counterstain", "ignore")).select("image_id", F.col("layer_name").alias("name"))
    return layers.where("kind = 'image'").select("image_id", "name").join(off, ["image_id", "name"], "left_anti")


def resolve_target(layers: DataFrame, channels: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Target layer per image, or per request when a query is given (M7).

    Without a query: the single target annotation, else the single remaining image
    layer, else ambiguous.  With a query: exact layer name, annotation or phrase;
    layers annotated as counterstain or ignore are refused.
    Columns: image_id [, request_id, query], layer, source, status, note.
    """
    if requests is not None:
        found = resolve_channel(layers, channels, requests)
        role = channels.select("image_id", F.col("layer_name").alias("layer"), "role")
        out = found.join(role, ["image_id", "layer"], "left")
        hit = F.col("status") == "resolved"
        exact = hit & (F.col("rank") == 1)
        refused = hit & ~exact & F.coalesce(F.col("role").isin("counterstain", "ignore"), F.lit(False))
        ok = hit & ~refused
        source = F.when(exact, "explicit").when(ok & (F.col("role") == "target"), "annotation").when(ok, "phrase")
        note = F.when(refused, F.concat(F.lit("annotated as "), "role")).when(~hit, F.concat(F.lit("could not resolve channel "), "query"))
        return out.select(
            "request_id", "image_id", "query", F.when(ok, F.col("layer")).alias("layer"), source.alias("source"),
            F.when(ok, "ok").otherwise("ambiguous").alias("status"), note.alias("note"),
        )
    noted = channels.where("role = 'target'").groupBy("image_id").agg(
        F.count("*").alias("n_target"), F.min("layer_name").alias("_target")
    )
    free = target_candidates(layers, channels).groupBy("image_id").agg(
        F.count_distinct("name").alias("n_free"), F.min("name").alias("_free")
    )
    out = layers.select("image_id").distinct().join(noted, "image_id", "left").join(free, "image_id", "left")
    out = out.na.fill(0, ["n_target", "n_free"])
    one = F.col("n_target") == 1
    inferred = (F.col("n_target") == 0) & (F.col("n_free") == 1)
    n = F.when(F.col("n_target") > 0, F.col("n_target")).otherwise(F.col("n_free"))
    return out.select(
        "image_id",
        F.when(one, F.col("_target")).when(inferred, F.col("_free")).alias("layer"),
        F.when(one, "annotation").when(inferred, "inference").alias("source"),
        F.when(one | inferred, "ok").otherwise("ambiguous").alias("status"),
        F.when(inferred, "single image layer; assumed target").when(~one, F.concat(n.cast("string"), F.lit(" candidate layers"))).alias("note"),
    )
