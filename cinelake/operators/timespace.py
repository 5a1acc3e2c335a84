"""Neighbourhoods in time and space, decided on grid cells instead of pairs of rows.

Two rows are neighbours when max(dt / time, distance / space) <= 1, or dt / time <= 1 when either has no
position. With one minimum sample, density clusters are the components of that graph, and most of it follows
from small aggregates:

* rows of one grid cell (diagonal <= space) and one time slot (length `time`) are all neighbours, so a
  (cell, slot) is one node however many rows it holds;
* rows without a position form one node per slot, and two nodes of adjacent slots are linked exactly when the
  earlier one's last row and the later one's first row are close enough;
* only pairs of cells near the distance limit need their rows compared, and only if they are not connected
  some other way; where that is many rows, cells are divided until what lies across the limit is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions.geo import cartesian, chord_m, haversine_m
from cinelake.operators.components import connected_components
from cinelake.session import cut_lineage

CELLS_PER_REACH = 4
TIME_LIMIT_S = 1800.0
SPACE_LIMIT_M = 500.0


def place_in_grid(rows: DataFrame, ts: str, lat: str, lon: str, time_s: float, space_m: float) -> DataFrame:
    """Add the slot, the cell (null without a position) and the node id of each row. `ts` is in seconds."""
    # A hair below reach / 4 keeps rounding from putting far points into one cell.
    side = chord_m(space_m) / CELLS_PER_REACH * (1 - 1e-9)
    has_gps = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    x, y, z = cartesian(F.col(lat), F.col(lon))
    cell = lambda c: F.when(has_gps, F.floor(c / F.lit(side)).cast("bigint"))
    gridded = rows.withColumns(
        {"slot": F.floor(F.col(ts) / F.lit(time_s)).cast("bigint"), "cx": cell(x), "cy": cell(y), "cz": cell(z)}
    )
    node = F.concat_ws(
        ":", F.coalesce(F.concat_ws(",", "cx", "cy", "cz"), F.lit("")), F.col("slot").cast("string")
    )
    return gridded.withColumn("node", node)


def _nodes(gridded: DataFrame, ident: str, ts: str) -> DataFrame:
    return gridded.groupBy("node", "slot", "cx", "cy", "cz").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min(ident).alias("first_id"), F.count("*").alias("n_rows")
    )


def _timeline_edges(nodes: DataFrame, time_s: float) -> DataFrame:
    """Edges among rows without a position, and between them and everything else."""
    blank = nodes.filter(F.col("cx").isNull()).select(
        F.col("node").alias("b_node"), F.col("slot").alias("b_slot"), F.col("first_ts").alias("b_first"), F.col("last_ts").alias("b_last")
    )
    around = nodes.withColumn("b_slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    close = (
        F.when(F.col("b_slot") == F.col("slot"), F.lit(True))
        .when(F.col("b_slot") > F.col("slot"), F.col("b_first") - F.col("last_ts") <= time_s)
        .otherwise(F.col("first_ts") - F.col("b_last") <= time_s)
    )
    return around.join(blank, "b_slot").filter(close & (F.col("node") != F.col("b_node"))).select(
        F.col("node").alias("a"), F.col("b_node").alias("b")
    )


def _cell_pairs(nodes: DataFrame, time_s: float) -> DataFrame:
    """Pairs of positioned nodes whose cells come within reach, with `sure` when every pair of their rows does."""
    k = CELLS_PER_REACH
    reach = k + 1
    axes = ("cx", "cy", "cz")
    # Coarse cells are twice the reach wide, so along each axis a partner lies in the same one or in the one on
    # the nearer side. Partners are looked for in the same slot and the next, which finds each pair once.
    wide = lambda axis: F.floor(F.col(axis) / (2 * reach))
    placed = nodes.filter(F.col("cx").isNotNull())
    probe = placed.withColumn("slot_to", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
    for axis in axes:
        nearer = F.when(F.pmod(F.col(axis), F.lit(2 * reach)) < reach, wide(axis) - 1).otherwise(wide(axis) + 1)
        probe = probe.withColumn(axis + "_to", F.explode(F.array(wide(axis), nearer)))
    other = placed.select(
        F.col("slot").alias("slot_to"), *[wide(a).alias(a + "_to") for a in axes],
        *[F.col(c).alias("b_" + c) for c in ("node", "slot", "cx", "cy", "cz", "first_ts", "last_ts")],
    )
    once = (F.col("b_slot") > F.col("slot")) | (F.col("node") < F.col("b_node"))
    pairs = probe.join(other, ["slot_to", *[a + "_to" for a in axes]]).filter(once)
    gap, span = F.lit(0), F.lit(0)
    for axis in axes:
        d = F.abs(F.col(axis) - F.col("b_" + axis))
        near, far = F.greatest(d - 1, F.lit(0)), d + 1
        gap, span = gap + near * near, span + far * far
    in_time = (F.col("b_slot") == F.col("slot")) | (F.col("b_first_ts") - F.col("last_ts") <= time_s)
    return pairs.filter(in_time & (gap <= k * k)).select(
        F.col("node").alias("a"), F.col("b_node").alias("b"), (span <= k * k).alias("sure")
    )


def _settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its component; a node without an edge is its own."""
    found = connected_components(edges, "a", "b").withColumnRenamed("component", "__c")
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("__c", "node")).drop("__c")


FINEST = 16
STEP = 2
#: Pairs of spots that are compared at once; more are divided first.
PAIRS_AT_ONCE = 4096
_AXES = ("x", "y", "z")


def _spots(gridded: DataFrame, ts: str, lat: str, lon: str, space_m: float) -> DataFrame:
    """Rows of one place and slot as one: they are neighbours, and the first and last of them decide about the next slot."""
    spots = gridded.filter(F.col("cx").isNotNull()).groupBy("node", "slot", F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    side = chord_m(space_m) / CELLS_PER_REACH * (1 - 1e-9) / (1 << FINEST)
    return spots.withColumns({axis: F.floor(c / F.lit(side)).cast("bigint") for axis, c in zip(_AXES, cartesian(F.col("lat"), F.col("lon")))})


def _parts(spots: DataFrame, level: int) -> DataFrame:
    """The spots of each node by a grid `level` halvings finer than its cell, with the last and the first spot of every part."""
    spot = F.struct("lat", "lon", "first", "last")
    grid = {f"{axis}_in": F.shiftright(axis, FINEST - level) for axis in _AXES}
    parts = spots.withColumns(grid).groupBy("node", "slot", *grid).agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min_by(spot, F.struct("first", "lat", "lon")).alias("early"),
        F.max_by(spot, F.struct("last", "lat", "lon")).alias("late"),
    )
    return parts.withColumns({f"{axis}_of": F.shiftright(f"{axis}_in", STEP) for axis in _AXES})


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "node"])


def _near(a: Column, b: Column, space_m: float) -> Column:
    return haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) <= space_m


def _soon(time_s: float) -> Column:
    """Whether the closest of the two sides in time are close enough."""
    return (
        F.when(F.col("a_slot") == F.col("b_slot"), F.lit(True))
        .when(F.col("b_slot") > F.col("a_slot"), F.col("b_first") - F.col("a_last") <= time_s)
        .otherwise(F.col("a_first") - F.col("b_last") <= time_s)
    )


def meeting_components(
    open_pairs: DataFrame, spots: DataFrame, time_s: float, space_m: float, pairs_at_once: int = PAIRS_AT_ONCE, work: list[int] | None = None
) -> DataFrame:
    """(ca, cb) for which some pair of spots of `open_pairs` (a, b, ca, cb: nodes and their components) are neighbours.

    A pair of nodes with many spots is divided on ever finer grids. Of two parts, both may be out of reach, or one pair that is closest in
    time may be within it, or the parts lie across the limit and are divided again; one hit settles all pairs of the two components. So the
    parts along the limit are looked at, not the product of the spots. `work` is given the number of pairs of each round.
    """
    level, hits = 0, None
    spots = cut_lineage(spots.join(open_pairs.select("a").union(open_pairs.select("b")).distinct().withColumnRenamed("a", "node"), "node"))
    counts = spots.groupBy("node", "slot").agg(F.count(F.lit(1)).alias("n"))
    pairs = open_pairs.select("ca", "cb", "a", "b").join(_sided(counts, "a"), "a").join(_sided(counts, "b"), "b")
    while True:
        pairs = cut_lineage(pairs)
        at = [f"{side}_{axis}_in" for side in "ab" for axis in _AXES] if level else []
        few = (F.col("a_n") * F.col("b_n") <= pairs_at_once) | F.lit(level >= FINEST)
        if work is not None:
            work.append(pairs.agg(F.coalesce(F.sum(F.when(few, F.col("a_n") * F.col("b_n")).otherwise(1)), F.lit(0))).first()[0])
        inside = spots.withColumns({f"{axis}_in": F.shiftright(axis, FINEST - level) for axis in _AXES}).drop(*_AXES) if level else spots.drop(*_AXES)
        spot = F.struct("lat", "lon", "first", "last")
        held = inside.select("node", "slot", *[f"{axis}_in" for axis in _AXES if level], "first", "last", spot.alias("spot"))
        a, b = _sided(held, "a"), _sided(held, "b")
        keys = {side: [side, f"{side}_slot", *[c for c in at if c.startswith(side)]] for side in "ab"}
        met = pairs.filter(few).select("ca", "cb", *keys["a"], *keys["b"]).join(a, keys["a"]).join(b, keys["b"])
        met = met.filter(_soon(time_s) & _near(F.col("a_spot"), F.col("b_spot"), space_m)).select("ca", "cb")
        level += STEP
        parts = _parts(spots, level)
        divided = pairs.filter(~few).select("ca", "cb", *keys["a"], *keys["b"]).withColumnsRenamed({c: c.replace("_in", "_of") for c in at})
        up = {side: [c.replace("_in", "_of") for c in keys[side]] for side in "ab"}
        divided = divided.join(_sided(parts, "a"), up["a"]).join(_sided(parts, "b"), up["b"])
        reach = CELLS_PER_REACH << level
        gap, span = F.lit(0.0), F.lit(0.0)
        for axis in _AXES:
            d = F.abs(F.col(f"a_{axis}_in") - F.col(f"b_{axis}_in")).cast("double")
            gap, span = gap + F.greatest(d - 1, F.lit(0.0)) ** 2, span + (d + 1) ** 2
        ahead = F.col("a_slot") <= F.col("b_slot")
        first = F.when(ahead, F.col("a_late")).otherwise(F.col("a_early"))
        second = F.when(ahead, F.col("b_early")).otherwise(F.col("b_late"))
        # the two spots that are closest in time are within reach, or all spots are
        hit = (span <= float(reach) ** 2) | _near(first, second, space_m)
        kept = [f"{side}{c}" for side in "ab" for c in ("", "_slot", *[f"_{axis}_in" for axis in _AXES])]
        # what lies across the limit; widened by what rounding may have moved
        looked = cut_lineage(divided.filter(_soon(time_s) & (gap <= (reach * (1 + 1e-8)) ** 2)).select("ca", "cb", *kept, "a_n", "b_n", hit.alias("hit")))
        new = cut_lineage(met.union(looked.filter("hit").select("ca", "cb")).distinct())
        hits = new if hits is None else hits.union(new)
        pairs = looked.filter("not hit").drop("hit").join(new, ["ca", "cb"], "left_anti")
        if level > FINEST or pairs.isEmpty():
            return hits.distinct()


def time_space_components(
    rows: DataFrame, ident: str, ts: str, lat: str, lon: str, time_s: float = TIME_LIMIT_S, space_m: float = SPACE_LIMIT_M
) -> tuple[DataFrame, DataFrame]:
    """The rows with their `node`, and per node its component and row count.

    Join the two with `salted_lookup` to label rows.
    """
    gridded = place_in_grid(rows, ts, lat, lon, time_s, space_m)
    nodes = cut_lineage(_nodes(gridded, ident, ts))
    pairs = cut_lineage(_cell_pairs(nodes, time_s))
    easy = _timeline_edges(nodes, time_s).unionByName(pairs.filter("sure").select("a", "b"))
    labelled = cut_lineage(_settle(nodes, easy))

    part = labelled.select("node", "component")
    open_pairs = cut_lineage(
        pairs.filter(~F.col("sure"))
        .join(part.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
        .join(part.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        .filter(F.col("ca") != F.col("cb"))
    )
    if open_pairs.isEmpty():
        return gridded, labelled
    bridges = cut_lineage(meeting_components(open_pairs, _spots(gridded, ts, lat, lon, space_m), time_s, space_m).toDF("a", "b"))
    if bridges.isEmpty():
        return gridded, labelled
    merged = connected_components(bridges, "a", "b")
    final = labelled.join(
        merged.select(F.col("node").alias("component"), F.col("component").alias("__c")), "component", "left"
    ).withColumn("component", F.coalesce("__c", "component")).drop("__c")
    return gridded, final
