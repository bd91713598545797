"""Distances along skeletons, branching orders, and intensity along processes.

The tables are those of ``operators/skeleton.py``: nodes and edges of a trace carry
``pid``, the packed voxel position.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.operators.skeleton import node_distances
from fluoroframe.plans.blocks import BOX, unpacked
from fluoroframe.plans.cut import cut, forget
from fluoroframe.plans.skew import salted_join

BLOCK = ["trace_id", "bz", "by", "bx"]
#: Written rounds that are made one table again.
ROUNDS_KEPT = 8


# ---------------------------------------------------------------- path distance


def _block_of(pid: str, names: list[str], box: tuple[int, int, int]) -> list[Column]:
    return [F.floor(p / b).cast("int").alias(n) for p, b, n in zip(unpacked(pid), box, names)]


def start_at_soma(nodes_: DataFrame, soma_: DataFrame, ndim: int = 2) -> DataFrame:
    """``trace_id, pid``: the node next to the soma of each trace that has one, the smallest ``node_id`` on ties."""
    own = nodes_.join(soma_.select("trace_id"), "trace_id", "left_semi")
    gap = node_distances(own, soma_, "soma", ndim).join(own.select("trace_id", "pid", "node_id"), ["trace_id", "pid"])
    return gap.groupBy("trace_id").agg(F.min_by("pid", F.struct("distance", "node_id")).alias("pid"))


def path_distances(nodes_: DataFrame, edges_: DataFrame, start: DataFrame, box: tuple[int, int, int] = BOX) -> DataFrame:
    """``trace_id, pid, node_id, path_distance``: shortest scaled length along edges from the nearest start node.

    ``start`` (trace_id, pid) has any number of nodes of a trace; repeated ones count once.  Nodes that no start
    reaches, and all nodes of a trace without one, have a null distance.

    Shortest paths run inside fixed blocks.  A round works only on the blocks that hear of a shorter way to one of
    their nodes, and writes only the nodes that it improved, so a long path costs rounds, but not the whole table in
    each of them.
    """
    both = edges_.select("trace_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_length_scaled").alias("len"))
    both = both.unionByName(both.select("trace_id", F.col("b").alias("a"), F.col("a").alias("b"), "len"))
    links = cut(both.select("trace_id", *_block_of("a", ["bz", "by", "bx"], box), "a", "b", "len", *_block_of("b", ["cz", "cy", "cx"], box)))
    schema = "trace_id string, bz int, by int, bx int, pid long, dist double, own boolean"

    def relax(near: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        key = given[BLOCK].iloc[0]
        here = (key.bz, key.by, key.bx)
        order = np.argsort(near["a"].to_numpy(), kind="stable")
        at = near["a"].to_numpy()[order]
        to, length = near["b"].to_numpy()[order].tolist(), near["len"].to_numpy()[order].tolist()
        homes = list(zip(*(near[c].to_numpy()[order].tolist() for c in ("cz", "cy", "cx"))))
        firsts, starts = np.unique(at, return_index=True)
        span = dict(zip(firsts.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(at)])))
        known = given[~given["fresh"]]
        best = dict(zip(known["pid"].tolist(), known["dist"].tolist()))
        better, sent = {}, {}
        fresh = given[given["fresh"]]
        queue = list(zip(fresh["dist"].tolist(), fresh["pid"].tolist()))
        heapq.heapify(queue)
        while queue:
            far, node = heapq.heappop(queue)
            if far >= best.get(node, np.inf):
                continue
            best[node] = better[node] = far
            for i in range(*span.get(node, (0, 0))):
                way, other = far + length[i], to[i]
                if homes[i] == here:
                    if way < best.get(other, np.inf):
                        heapq.heappush(queue, (way, other))
                elif way < sent.get(other, (np.inf,))[0]:
                    sent[other] = (way, homes[i])
        rows = [(key.trace_id, *here, p, d, True) for p, d in better.items()]
        rows += [(key.trace_id, *home, p, d, False) for p, (d, home) in sent.items()]
        return pd.DataFrame(rows, columns=[*BLOCK, "pid", "dist", "own"])

    least = F.min("dist").alias("dist")
    asked = start.select("trace_id", *_block_of("pid", ["bz", "by", "bx"], box), "pid", F.lit(0.0).alias("dist"))
    asked = cut(asked.join(nodes_.select("trace_id", "pid"), ["trace_id", "pid"], "left_semi").distinct().select(*BLOCK, "pid", "dist"))
    found = [cut(asked.where("false"))]
    while asked.limit(1).count():
        active = asked.select(*BLOCK).distinct()
        known = found[0]
        for more in found[1:]:
            known = known.unionByName(more)
        known = known.join(active, BLOCK, "left_semi").groupBy(*BLOCK, "pid").agg(least)
        given = asked.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False)))
        near = links.join(active, BLOCK, "left_semi")
        step = cut(near.groupBy(*BLOCK).cogroup(given.groupBy(*BLOCK)).applyInPandas(relax, schema))
        found.append(cut(step.where("own").select(*BLOCK, "pid", "dist")))
        asked = cut(step.where("NOT own").groupBy(*BLOCK, "pid").agg(least), asked, step)
        if len(found) > ROUNDS_KEPT:
            found = [_shortest(found, BLOCK)]
    forget(asked, links)
    out = _shortest(found, ["trace_id"]).select("trace_id", "pid", F.col("dist").alias("path_distance"))
    return nodes_.select("trace_id", "pid", "node_id").join(out, ["trace_id", "pid"], "left")


def _shortest(found: list[DataFrame], keys: list[str]) -> DataFrame:
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return cut(whole.groupBy(*keys, "pid").agg(F.min("dist").alias("dist")), *found)


def path_parents(distances: DataFrame, edges_: DataFrame) -> DataFrame:
    """``trace_id, pid, parent``: the forest of shortest paths over the nodes that have a path distance.

    ``parent`` is the neighbour through which the shortest path comes, the smallest ``node_id`` on ties, and null at
    the starts.
    """
    known = distances.where("path_distance IS NOT NULL")
    both = edges_.select("trace_id", F.col("src").alias("pid"), F.col("dst").alias("up"), F.col("edge_length_scaled").alias("len"))
    both = both.unionByName(both.select("trace_id", F.col("up").alias("pid"), F.col("pid").alias("up"), "len"))
    above = known.select("trace_id", F.col("pid").alias("up"), F.col("node_id").alias("un"), F.col("path_distance").alias("ud"))
    met = both.join(known.select("trace_id", "pid", F.col("path_distance").alias("d")), ["trace_id", "pid"]).join(above, ["trace_id", "up"])
    chosen = met.where("ud < d AND ud + len = d").groupBy("trace_id", "pid").agg(F.min_by("up", "un").alias("parent"))
    return known.select("trace_id", "pid").join(chosen, ["trace_id", "pid"], "left")


# ---------------------------------------------------------------- branching order


def _resolved(m: Column, two: Column) -> Column:
    return F.greatest(F.lit(1), m + two.cast("int"))


def strahler_order(tree: DataFrame) -> DataFrame:
    """``trace_id, pid, strahler`` of the nodes of rooted trees ``trace_id, pid, parent`` (null at roots).

    Leaves have order 1; another node has the largest order of its children, plus 1 if two or more children have it.
    A cycle of parents is an error.

    Leaves are taken off and chains are shortened at once.  A node that waits for one child maps the order x of that
    child to ``lo`` for x < ``cut``, to lo + 1 from there to lo, and to x beyond; such maps are closed under
    composition, so a waiting node can jump over waiting nodes below it, and the number of rounds grows with the
    logarithm of the size, for chains too.  A join key that many nodes of a chain jump to is left to adaptive joins.
    """
    none = F.lit(None)
    open_ = cut(
        tree.select(
            "trace_id", "pid", F.col("parent").alias("up"), F.lit(0).alias("m"), F.lit(False).alias("two"),
            none.cast("long").alias("jump"), none.cast("int").alias("lo"), none.cast("int").alias("cut"), none.cast("int").alias("strahler"),
        )
    )
    fresh = open_.select("trace_id", "pid", "up", "strahler").where("false")
    done, still = [], 0
    while open_.limit(1).count():
        told = fresh.groupBy("trace_id", "up", "strahler").agg(F.count("*").alias("n")).groupBy("trace_id", "up").agg(F.max(F.struct("strahler", "n")).alias("b"))
        told = told.select("trace_id", F.col("up").alias("pid"), F.col("b.strahler").alias("hm"), (F.col("b.n") > 1).alias("ht"))
        kids = open_.groupBy("trace_id", "up").agg(F.count("*").alias("n"), F.min("pid").alias("only")).withColumnRenamed("up", "pid")
        step = open_.join(told, ["trace_id", "pid"], "left").join(kids, ["trace_id", "pid"], "left")
        heard = F.coalesce("hm", F.lit(0))
        two = F.when(heard > F.col("m"), F.col("ht")).when((heard == F.col("m")) & (heard > 0), True).otherwise(F.col("two"))
        step = step.withColumns({"two": two, "m": F.greatest("m", heard)})
        waits = (F.col("n") == 1) & F.col("jump").isNull()
        lo = _resolved(F.col("m"), F.col("two"))
        step = step.withColumns({
            "strahler": F.when(F.col("n").isNull(), lo),
            "cut": F.when(waits, F.when(F.col("m") == 0, 2).otherwise(F.col("m") + 2 * F.col("two").cast("int"))).otherwise(F.col("cut")),
            "lo": F.when(waits, lo).otherwise(F.col("lo")),
            "jump": F.when(waits, F.col("only")).otherwise(F.col("jump")),
        })
        step = cut(step.drop("n", "only", "hm", "ht"))
        reached = step.select("trace_id", F.col("pid").alias("jump"), F.col("strahler").alias("x"))
        reached = reached.unionByName(fresh.select("trace_id", F.col("pid").alias("jump"), F.col("strahler").alias("x")))
        mapped = F.expr("CASE WHEN x > lo THEN x WHEN x >= cut THEN lo + 1 WHEN x < cut THEN lo END")
        seen = step.join(reached, ["trace_id", "jump"], "left").withColumn("strahler", F.coalesce("strahler", mapped)).drop("x")
        seen = cut(seen, step, open_)
        fresh = cut(seen.where("strahler IS NOT NULL").select("trace_id", "pid", "up", "strahler"))
        # a target that has just got its order stays the target, so the next round finds it among the fresh ones
        waiting = seen.where("strahler IS NULL")
        below = waiting.where("jump IS NOT NULL").select("trace_id", F.col("pid").alias("jump"), F.col("jump").alias("j"), F.col("lo").alias("l1"), F.col("cut").alias("c1"))
        moved = waiting.join(below, ["trace_id", "jump"], "left").select(
            "trace_id", "pid", "up", "m", "two", F.coalesce("j", "jump").alias("jump"),
            F.expr("CASE WHEN j IS NULL THEN lo WHEN lo < l1 THEN l1 WHEN cut <= l1 THEN lo + 1 ELSE lo END").alias("lo"),
            F.expr("CASE WHEN j IS NULL THEN cut WHEN lo < l1 THEN c1 WHEN cut <= l1 THEN lo + 2 WHEN lo = l1 OR cut = l1 + 1 THEN c1 ELSE cut END").alias("cut"),
            "strahler",
        )
        open_ = cut(moved, seen)
        done.append(fresh)
        # jumps double, so 64 rounds without a result are no chain
        still = 0 if fresh.limit(1).count() else still + 1
        if still > 64:
            raise ValueError("the parents form a cycle")
    out = fresh
    for one in done[:-1]:
        out = out.unionByName(one)
    return out.select("trace_id", "pid", "strahler")


def order_summary(orders: DataFrame, tree: DataFrame) -> DataFrame:
    """Per trace: ``max_strahler``, ``n_nodes``, ``n_tips`` (nodes without children) and ``n_forks`` (with several)."""
    kids = tree.where("parent IS NOT NULL").groupBy("trace_id", F.col("parent").alias("pid")).agg(F.count("*").alias("kids"))
    rows = orders.join(kids, ["trace_id", "pid"], "left")
    return rows.groupBy("trace_id").agg(
        F.max("strahler").alias("max_strahler"), F.count("*").alias("n_nodes"),
        F.count_if(F.col("kids").isNull()).alias("n_tips"), F.count_if(F.col("kids") > 1).alias("n_forks"),
    )


# ---------------------------------------------------------------- intensity


def sample_nodes(nodes_: DataFrame, tiles: DataFrame) -> DataFrame:
    """``trace_id, pid, channel, t, v``: the value of every channel and frame at every node.

    Nodes are gathered by tile, so the join moves tiles and bounded lists, never voxels.  A node without a tile is an
    error.
    """
    grid = tiles.groupBy("image_id").agg(F.max("h").alias("_h"), F.max("w").alias("_w"))
    z, y, x = unpacked("pid")
    placed = nodes_.select(F.col("trace_id").alias("image_id"), "pid", z.alias("z"), y.alias("_y"), x.alias("_x"))
    placed = salted_join(placed, grid, ["image_id"], ["pid"], "left")
    lost = F.raise_error(F.concat(F.lit("no tile below a node of "), F.col("image_id"))).cast("int")
    placed = placed.select(
        "image_id", "z", F.coalesce(F.expr("cast(_y div _h as int)"), lost).alias("ty"), F.expr("cast(_x div _w as int)").alias("tx"),
        F.struct("pid", "_y", "_x").alias("p"),
    )
    lists = placed.groupBy("image_id", "z", "ty", "tx").agg(F.collect_list("p").alias("ps"))
    met = lists.join(tiles, ["image_id", "z", "ty", "tx"], "left")
    at = F.transform("ps", lambda p: F.struct(p["pid"].alias("pid"), F.get("data", (p["_y"] - F.col("y0")) * F.col("w") + p["_x"] - F.col("x0")).alias("v")))
    rows = met.select("image_id", "channel", "t", F.when(F.col("data").isNull(), lost).alias("_lost"), F.explode(at).alias("s"))
    return rows.where("_lost IS NULL").select(F.col("image_id").alias("trace_id"), "s.pid", "channel", "t", F.col("s.v").cast("double").alias("v"))


def _intensity() -> list[Column]:
    return [
        F.count("*").alias("n_nodes"), F.avg("v").alias("mean_intensity"), F.min("v").alias("min_intensity"),
        F.max("v").alias("max_intensity"), F.stddev_pop("v").alias("std_intensity"),
    ]


def branch_intensity(sampled: DataFrame, members: DataFrame) -> DataFrame:
    """Intensity of the nodes of each branch, its ends included, per channel and frame."""
    rows = members.select("trace_id", "pid", "branch_id").distinct().join(sampled, ["trace_id", "pid"])
    return rows.groupBy("trace_id", "branch_id", "channel", "t").agg(*_intensity())


def distance_profile(sampled: DataFrame, distances: DataFrame, step: float) -> DataFrame:
    """Intensity by path distance, in bins of ``step`` that begin at 0; nodes without a distance are a bin of their own (null)."""
    if step <= 0:
        raise ValueError("the step must be above 0")
    rows = distances.select("trace_id", "pid", F.floor(F.col("path_distance") / step).alias("bin")).join(sampled, ["trace_id", "pid"])
    out = rows.groupBy("trace_id", "channel", "t", "bin").agg(*_intensity())
    return out.withColumn("distance_from", F.col("bin") * F.lit(float(step)))
