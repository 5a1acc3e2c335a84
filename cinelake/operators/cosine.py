"""Density clustering under cosine distance, by exact metric partitioning.

Unit vectors within cosine distance eps of each other are within chord sqrt(2 eps). Cells of too many vectors are split by pivots: a vector
belongs to the cell of its nearest pivot, and is copied to the other cells that may hold a neighbour of it. Two bounds keep copies few: the
distance to the half-space on another pivot's side, and the distance to the ball around the pivot that holds all of its cell. Cells are split
until they are small; how often a vector is copied depends on how close the cells around it are, not on how many there are.

A cell then decides everything about its own vectors: their neighbour counts, the links among cores, the cluster a border vector joins. Its
own vectors are held, what was copied to it streams past them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.functions.vectors import normalise
from cinelake.operators.components import connected_components
from cinelake.operators.skew import row_number_across, salted_lookup
from cinelake.operators.topk import top_k
from cinelake.session import cut_lineage

BLOCK_ROWS = 2048
PIVOTS = 32
#: Vectors of one cell that a task deals to its children.
ROWS_PER_TASK = 200_000
#: Bounds are widened by this against rounding.
_SLACK = 1e-9
_FAR = np.iinfo("int64").max


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches with equal keys, in order; a key may come in several slices."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or any(c[i] != c[start] for c in columns):
                yield tuple(c[start] for c in columns), batch.slice(start, i - start)
                start = i


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivots of a cell, then its own vectors in; (cell, pivot, reach) out, the largest chord to the pivot so far."""
    now, pivots = None, None
    for (cell, salt, is_row), part in _groups(batches, "cell", "salt", "is_row"):
        if (cell, salt) != now:
            now, pivots = (cell, salt), []
        if not is_row:
            pivots.append(_matrix(part.column("unit")))
            continue
        dots = _matrix(part.column("unit")) @ np.concatenate(pivots).T
        best = dots.argmax(axis=1)
        chord = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(best)), best], 0))
        kinds, place = np.unique(best, return_inverse=True)
        reach = np.zeros(len(kinds))
        np.maximum.at(reach, place, chord)
        yield pa.RecordBatch.from_pydict({"cell": [cell] * len(kinds), "pivot": kinds.astype(np.int32), "reach": reach})


def _dealt(radius: float, counted: bool = False):
    """Pivots of a cell, then all its vectors in; vectors in child cells out, once as own and as often as they may have a neighbour elsewhere.

    `counted` gives (cell, n_in, n_out) instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, pivots, reach, apart = None, [], None, None, None
        for (cell, salt, is_row), part in _groups(batches, "cell", "salt", "is_row"):
            if (cell, salt) != now:
                now, parts, pivots = (cell, salt), [], None
            if not is_row:
                parts.append(part)
                continue
            if pivots is None:
                pivots = np.concatenate([_matrix(p.column("unit")) for p in parts])
                reach = np.concatenate([np.asarray(p.column("reach"), dtype=np.float64) for p in parts])
                apart = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0))
            units = _matrix(part.column("unit"))
            dots = units @ pivots.T
            own = np.asarray(part.column("own").to_pylist(), dtype=bool)
            near = np.sqrt(np.maximum(2 - 2 * dots, 0)) <= reach + radius + _SLACK
            with np.errstate(divide="ignore", invalid="ignore"):
                for c in range(len(pivots)):
                    side = (dots - dots[:, [c]]) / apart[c]
                    side[:, apart[c] < 1e-7] = 0
                    near[:, c] &= side.max(axis=1) <= radius + _SLACK
            home = dots.argmax(axis=1)
            near[own, home[own]] = True
            if counted:
                yield pa.RecordBatch.from_pydict({"cell": [cell], "n_in": [len(near)], "n_out": [int(near.sum())]})
                continue
            row, child = np.nonzero(near)
            if not len(row):
                continue
            is_own = own[row] & (home[row] == child)
            moved = part.select(["row_id", "unit", "copies"]).take(pa.array(row))
            yield pa.RecordBatch.from_pydict(
                {"cell": [f"{cell}.{c}" for c in child], "own": is_own, "row_id": moved.column("row_id"), "unit": moved.column("unit"), "copies": moved.column("copies")}
            )

    return run


_CELLS = "cell string, own boolean, row_id bigint, unit array<double>, copies bigint"


#: Copies a vector's cell may hold for each of its own vectors before it is cut into blocks instead of split by pivots, the number of blocks
#: aimed at, how much larger than a split cell a block may be, and how many vectors judge that.
MAX_COPIES, BLOCKS, WIDE, JUDGED = 16, 16, 32, 20_000


def metric_cells(units: DataFrame, eps: float, block_rows: int = BLOCK_ROWS, n_pivots: int = PIVOTS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(cell, own, row_id, unit, copies): every distinct unit vector once as own, and in every cell that may hold one within `eps` of it.

    A cell has at most `block_rows` own vectors. Where pivots do not tell vectors apart (a cell would hold more than `MAX_COPIES` vectors
    for each of its own), the own vectors are cut into `BLOCKS` blocks, each of which all vectors of the cell are copied to, and into more
    of them when a block would exceed `WIDE * block_rows`.
    """
    radius = math.sqrt(2 * eps)
    cells = units.select(F.lit("0").alias("cell"), F.lit(True).alias("own"), "row_id", "unit", F.col("copies").cast("bigint").alias("copies"))
    finished = None
    level = 0
    while True:
        sizes = cut_lineage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own")))
        owns = sizes.filter(F.col("n_own") > block_rows)
        large = owns.drop("n_own")
        small = cells.join(sizes.filter((F.col("n_own") > 0) & (F.col("n_own") <= block_rows)).select("cell"), "cell", "left_semi")
        finished = small if finished is None else finished.unionByName(small)
        if large.isEmpty():
            return finished
        salts = F.ceil(F.col("n") / rows_per_task)
        dealt = salted_lookup(cells, large.withColumn("salts", salts.cast("int")), ["cell"], "n").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts").cast("bigint")).cast("int"))
        chosen = top_k(dealt.filter("own").select("cell", "row_id", "unit", F.xxhash64("row_id", F.lit(level)).alias("draw")), ["cell"], [F.col("draw").asc(), F.col("row_id").asc()], n_pivots)
        chosen = cut_lineage(chosen.select("cell", (F.col("rank") - 1).cast("int").alias("pivot"), "unit"))
        spread = large.select("cell", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)).alias("salt"))

        def streamed(rows: DataFrame, pivots: DataFrame) -> DataFrame:
            heads = pivots.join(spread, "cell").withColumn("is_row", F.lit(False))
            both = heads.unionByName(rows.drop("n", "salts").withColumn("is_row", F.lit(True)), allowMissingColumns=True)
            return both.repartition(F.xxhash64("cell", "salt")).sortWithinPartitions("cell", "salt", "is_row", "pivot")

        reach = streamed(dealt.filter("own"), chosen).mapInArrow(_nearest, "cell string, pivot int, reach double")
        reach = reach.groupBy("cell", "pivot").agg(F.max("reach").alias("reach"))
        placed = cut_lineage(chosen.join(reach, ["cell", "pivot"]))
        some = dealt.filter(F.pmod(F.xxhash64("row_id", "cell"), F.ceil(F.col("n") / JUDGED)) == 0)
        judged = streamed(some, placed).mapInArrow(_dealt(radius, counted=True), "cell string, n_in bigint, n_out bigint")
        growth = judged.groupBy("cell").agg((F.sum("n_out") / F.sum("n_in")).alias("growth"))
        blocks = F.greatest(F.least(F.ceil(F.col("n_own") / block_rows), F.lit(BLOCKS)), F.ceil(F.col("n_own") / (WIDE * block_rows))).cast("int")
        wide = cut_lineage(owns.join(growth, "cell").filter(F.col("growth") * F.col("n") > MAX_COPIES * F.col("n_own")).select("cell", blocks.alias("blocks")))
        if not wide.isEmpty():
            home = F.pmod(F.xxhash64("row_id", F.lit("block")), F.col("blocks"))
            everywhere = cells.join(F.broadcast(wide), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            finished = finished.unionByName(everywhere.select(
                F.concat_ws("/", "cell", "block").alias("cell"), (F.col("own") & (home == F.col("block"))).alias("own"), "row_id", "unit", "copies"
            ))
            dealt = dealt.join(wide.select("cell"), "cell", "left_anti")
            placed = placed.join(wide.select("cell"), "cell", "left_anti")
        cells = cut_lineage(streamed(dealt, placed).mapInArrow(_dealt(radius), _CELLS))
        level += 1


def _cell_by_cell(rows: DataFrame, start, step, end, schema: str) -> DataFrame:
    """Run `start(own)`, then `step(state, others)` per batch of vectors copied to the cell, then `end(state)`; step and end give batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, state = None, [], None

        def begin():
            return start(pa.Table.from_batches(own).combine_chunks()) if own else None

        for (cell, is_own), part in _groups(batches, "cell", "own"):
            if cell != now:
                if own and state is None:
                    state = begin()
                if state is not None:
                    yield from end(state)
                now, own, state = cell, [], None
            if is_own:
                own.append(part)
                continue
            if state is None:
                state = begin()
            if state is not None:
                yield from step(state, part)
        if own and state is None:
            state = begin()
        if state is not None:
            yield from end(state)

    # By a hash of its own: a plain repartition by cell is dropped after a join on cell, whose shuffle may then be read map by map.
    return rows.repartition(F.xxhash64("cell")).sortWithinPartitions("cell", F.col("own").desc()).mapInArrow(run, schema)


def _units(table: pa.Table) -> np.ndarray:
    return _matrix(table.column("unit").combine_chunks())


#: Products of a cell are made in parts of at most about this many entries.
_ENTRIES = 8_000_000


def _parts(n: int, width: int) -> Iterator[slice]:
    rows = max(1, _ENTRIES // max(width, 1))
    return (slice(i, min(i + rows, n)) for i in range(0, n, rows))


def _count(cells: DataFrame, eps: float) -> DataFrame:
    """(row_id, n): rows within eps of every vector, itself and copies included."""

    def start(own):
        units, copies = _units(own), np.asarray(own.column("copies"))
        n = np.zeros(len(units), np.int64)
        for some in _parts(len(units), len(units)):
            close = 1.0 - units[some] @ units.T <= eps
            close[np.arange(len(close)), np.arange(some.start, some.stop)] = True
            n[some] = close @ copies
        return {"ids": own.column("row_id"), "units": units, "n": n}

    def step(state, part):
        others, copies = _matrix(part.column("unit")), np.asarray(part.column("copies"))
        for some in _parts(len(others), len(state["units"])):
            state["n"] += (1.0 - state["units"] @ others[some].T <= eps) @ copies[some]
        return ()

    def end(state):
        yield pa.RecordBatch.from_pydict({"row_id": state["ids"].combine_chunks(), "n": state["n"].astype(np.int64)})

    return _cell_by_cell(cells, start, step, end, "row_id bigint, n bigint")


def _spread(units: np.ndarray, eps: float) -> np.ndarray:
    """Components of vectors within eps of each other, each named by its first row. Neighbours are found as a frontier needs them."""
    label = np.full(len(units), -1, np.int64)
    for seed in range(len(units)):
        if label[seed] >= 0:
            continue
        frontier = np.array([seed])
        label[seed] = seed
        while len(frontier):
            left = np.flatnonzero(label < 0)
            found = np.zeros(len(left), bool)
            for some in _parts(len(frontier), len(left)):
                found |= (1.0 - units[frontier[some]] @ units[left].T <= eps).any(axis=0)
            frontier = left[found]
            label[frontier] = seed
    return label


def _link(cores: DataFrame, eps: float) -> DataFrame:
    """(a, b): links that span what each cell sees of the components of cores."""

    def start(own):
        units = _units(own)
        return {"ids": np.asarray(own.column("row_id")), "units": units, "label": _spread(units, eps)}

    def step(state, part):
        others, ids, label = _matrix(part.column("unit")), np.asarray(part.column("row_id")), state["label"]
        for some in _parts(len(others), len(state["units"])):
            close = 1.0 - state["units"] @ others[some].T <= eps
            touched = np.flatnonzero(close.any(axis=0))
            for j in touched:
                if (label == label[0]).all():
                    break
                met = np.unique(label[close[:, j]])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            if len(touched):
                first = close[:, touched].argmax(axis=0)
                yield pa.RecordBatch.from_pydict({"a": ids[some][touched], "b": state["ids"][first]})

    def end(state):
        yield pa.RecordBatch.from_pydict({"a": state["ids"], "b": state["ids"][state["label"]]})

    return _cell_by_cell(cores, start, step, end, "a bigint, b bigint")


def _adopt(rows: DataFrame, eps: float) -> DataFrame:
    """(row_id, label): for vectors that are no core, the least label among the cores within eps."""

    def labels(table):
        return np.asarray(table.column("label").fill_null(_FAR))

    def least(units, others, of):
        best = np.full(len(units), _FAR)
        for some in _parts(len(others), len(units)):
            best = np.minimum(best, np.where(1.0 - units @ others[some].T <= eps, of[None, some], _FAR).min(axis=1, initial=_FAR))
        return best

    def start(own):
        core = np.asarray(own.column("core").to_pylist(), dtype=bool)
        units = _units(own)
        border = units[~core]
        return {"ids": np.asarray(own.column("row_id"))[~core], "units": border, "label": least(border, units[core], labels(own)[core])}

    def step(state, part):
        core = np.asarray(part.column("core").to_pylist(), dtype=bool)
        state["label"] = np.minimum(state["label"], least(state["units"], _matrix(part.column("unit"))[core], labels(part)[core]))
        return ()

    def end(state):
        found = state["label"] != _FAR
        yield pa.RecordBatch.from_pydict({"row_id": state["ids"][found], "label": state["label"][found].astype(np.int64)})

    return _cell_by_cell(rows, start, step, end, "row_id bigint, label bigint")


def cosine_clusters(vectors: DataFrame, row_id: str, vector: str, eps: float = 0.5, min_samples: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, label) for every row in a cluster; noise is left out.

    Core rows have at least `min_samples` rows within `eps`, themselves included. Labels count from 0 in the
    order of each cluster's smallest core row; a border row takes the smallest label among its core neighbours.
    Exact. Vectors that are all within reach of each other are compared in pairs of cells, whatever the partition.
    """
    rows = vectors.select(F.col(row_id).cast("bigint").alias("row_id"), normalise(F.col(vector)).alias("unit"))
    # Copies share their neighbours, so one of them stands for all, with their number as its weight.
    units = cut_lineage(rows.groupBy("unit").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies")))
    cells = cut_lineage(metric_cells(units, eps, block_rows))

    core = cut_lineage(_count(cells, eps).select("row_id", (F.col("n") >= min_samples).alias("core")))
    links = _link(cells.join(core.filter("core").select("row_id"), "row_id", "left_semi"), eps)
    part = connected_components(links, "a", "b")
    rooted = core.filter("core").select("row_id").join(part.withColumnRenamed("node", "row_id"), "row_id", "left").select(
        "row_id", F.coalesce("component", "row_id").alias("root")
    )
    # One row per cluster is numbered here, not one per vector.
    numbered = _dense_numbers(rooted.select("root").distinct(), "root", "label")
    labelled_core = cut_lineage(rooted.join(numbered, "root").select("row_id", "label"))
    # Cells without a border vector of their own have nothing to decide.
    open_cells = cells.filter("own").join(core.filter("not core").select("row_id"), "row_id", "left_semi").select("cell").distinct()
    asked = cells.join(open_cells, "cell", "left_semi").join(core, "row_id").join(labelled_core, "row_id", "left")
    labels = labelled_core.unionByName(_adopt(asked, eps))
    known = units.join(labels, "row_id").select("unit", "copies", "label")
    return salted_lookup(rows, known, ["unit"], "copies").select("row_id", "label")


def _dense_numbers(values: DataFrame, column: str, name: str) -> DataFrame:
    """0, 1, 2, ... over a whole column, in ranges of values so that no task holds all of them."""
    keyed = values.withColumns({"__all": F.lit(0), "__range": F.floor(F.col(column) / 100_000).cast("bigint")})
    out = row_number_across(keyed, ["__all"], "__range", [column], name)
    return out.select(column, (F.col(name) - 1).alias(name))
