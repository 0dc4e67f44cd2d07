"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label are compared by cosine.  Equal vectors are collapsed first.  Unit vectors whose cosine is at least
``t`` lie within ``epsilon = sqrt(2 - 2t)`` of each other, also after projection on the leading principal dimensions.
The projections are cut into grid cells of that width and sorted by label and cells; the sorted sequence is cut into
blocks with a bounding box.  Blocks meet if they touch neighbouring cells of the first two dimensions and their boxes are
within epsilon.  Pairs of blocks are gathered in tiles of neighbouring blocks, to which each block is sent once; a pair is
joined by splitting the longer interval until the boxes are provably distant or the intervals are short, where cosines
are computed as one matrix product in double precision.

A tile yields the number of links of each vector and a spanning forest of its links, never the pairs, so a group of
thousands of near copies costs rows in proportion to its size.  The principal dimensions come from at most ``MOST_FIT``
vectors; they affect the cost, not the result.  A vector is told by a hash of 64 bits of label and components.

Edge cases: null labels, null, empty and zero vectors and vectors with null or non-finite components link with nothing;
vectors of different lengths do not link; equal rows link with each other; rows that share an id but not the vector have
the links of their own vector each; rows with a null id are left out of links; an empty table gives an empty result;
other columns pass through, and columns that clash with the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.runtime import cut, shuffle_width, spill, without

MOST_FIT = 4096
DIMENSIONS = 6
BLOCK = 512
LEAF = 64
#: Blocks on either side of a tile.
TILE = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _axes(sample: list[list[float]], dimensions: int) -> dict[int, np.ndarray]:
    """For each vector length seen in the sample, an orthonormal basis of its leading principal dimensions."""
    found: dict[int, list[list[float]]] = {}
    for x in sample:
        found.setdefault(len(x), []).append(x)
    axes = {}
    for n, xs in found.items():
        unit = _unit(np.array(xs, float))
        _, _, v = np.linalg.svd(unit - unit.mean(0), full_matrices=True)
        axes[n] = v[: min(dimensions, n)].T
    return axes


def _project(unit: np.ndarray, axes: dict[int, np.ndarray], dimensions: int) -> np.ndarray:
    out = np.zeros((len(unit), dimensions))
    n = unit.shape[1]
    basis = axes[n] if n in axes else np.eye(n)[:, :dimensions]
    out[:, : basis.shape[1]] = unit @ basis
    return out


def _placed(axes: dict[int, np.ndarray], epsilon: float, dimensions: int):
    """Adds the grid cells of each vector."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            cells = np.zeros((len(vectors), dimensions), np.int32)
            sizes = np.array([len(v) for v in vectors])
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                unit = _unit(np.array([vectors[i] for i in at], float))
                cells[at] = np.floor(_project(unit, axes, dimensions) / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(dimensions)]], names=[*batch.schema.names, *[f"c{k}" for k in range(dimensions)]])

    return run


_BLOCKS = "label string, block long, size int, ids binary, weights binary, unit binary, low array<double>, high array<double>"


def _blocked(axes: dict[int, np.ndarray], dimensions: int):
    """Cuts a sorted partition into blocks of one label and vector length, numbered along the order of all vectors."""

    def row(label, held, block):
        ids, weights = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        unit = _unit(np.array([x[2] for x in held], float))
        at = _project(unit, axes, dimensions)
        return {"label": label, "block": block, "size": unit.shape[1], "ids": ids.tobytes(), "weights": weights.tobytes(), "unit": unit.tobytes(), "low": at.min(0).tolist(), "high": at.max(0).tolist()}

    schema = pa.schema([("label", pa.string()), ("block", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("unit", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def run(batches):
        held, key, block = [], None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for r in batch.to_pylist():
                mine = (r["label"], len(r["vector"]))
                if held and (mine != key or len(held) >= BLOCK):
                    yield pa.RecordBatch.from_pylist([row(key[0], held, block)], schema=schema)
                    held, block = [], block + 1
                key = mine
                held.append((r["id"], r["weight"], r["vector"]))
        if held:
            yield pa.RecordBatch.from_pylist([row(key[0], held, block)], schema=schema)

    return run


def _near(low_a, high_a, low_b, high_b, epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) <= epsilon * epsilon


def join_blocks(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, epsilon: float, threshold: float, same: bool) -> list[tuple[int, int, np.ndarray]]:
    """(offset in a, offset in b, matrix of links) of the leaves that hold links; for ``same`` only the upper half."""
    found = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i:
            continue
        x, y = pa_[i:j], pb[k:m]
        if not _near(x.min(0), x.max(0), y.min(0), y.max(0), epsilon):
            continue
        if j - i <= LEAF and m - k <= LEAF:
            links = a[i:j] @ b[k:m].T >= threshold
            if same:
                links &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
            if links.any():
                found.append((i, k, links))
        elif j - i >= m - k:
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]
    return found


def _joined(axes: dict[int, np.ndarray], dimensions: int, epsilon: float, threshold: float):
    """Blocks sorted by tile, with their partners in it -> rows (id, near, root): near adds to the links of id, root is
    linked with it."""

    def links(held):
        """``held``: block -> (ids, weights, unit vectors, partners)."""
        at = {block: _project(h[2], axes, dimensions) for block, h in held.items()}
        found = [(x, y, i, k, m) for x, h in held.items() for y in h[3] for i, k, m in join_blocks(h[2], held[y][2], at[x], at[y], epsilon, threshold, x == y)]
        if not found:
            return None
        near = {block: np.zeros(len(h[0]), np.int64) for block, h in held.items()}
        root = {block: h[0].copy() for block, h in held.items()}
        for x, y, i, k, m in found:
            near[x][i : i + m.shape[0]] += m @ held[y][1][k : k + m.shape[1]]
            near[y][k : k + m.shape[1]] += held[x][1][i : i + m.shape[0]] @ m
        # least id reachable by the links of this tile, by spreading minima until nothing changes
        far = np.iinfo(np.int64).max
        moved = True
        while moved:
            moved = False
            for x, y, i, k, m in found:
                ra, rb = root[x][i : i + m.shape[0]], root[y][k : k + m.shape[1]]
                low_a, low_b = np.where(m, rb[None, :], far).min(1), np.where(m, ra[:, None], far).min(0)
                if (low_a < ra).any() or (low_b < rb).any():
                    np.minimum(ra, low_a, out=ra)
                    np.minimum(rb, low_b, out=rb)
                    moved = True
        return [np.concatenate([part[b] for b in held]) for part in ({b: h[0] for b, h in held.items()}, near, root)]

    def rows(held):
        if held and (found := links(held)) is not None:
            some = found[1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in found], names=["id", "near", "root"])

    def run(batches):
        key, held = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                mine = (r["label"], r["i"], r["j"])
                if mine != key:
                    yield from rows(held)
                    key, held = mine, {}
                ids = np.frombuffer(r["ids"], np.int64)
                held[r["block"]] = ids, np.frombuffer(r["weights"], np.int64), np.frombuffer(r["unit"]).reshape(len(ids), -1), r["partners"]
        yield from rows(held)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label, ...) with n_links, component_id and kept."""
    spark = vectors.sparkSession
    vectors = without(vectors, ["n_links", "component_id", "kept"])
    epsilon = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    raw = F.col("embedding").cast("array<double>")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists(raw, lambda x: x != 0), F.lit(False))
    key = F.col("label").cast("string")
    distinct = vectors.where(good).select(key.alias("label"), raw.alias("vector"), F.col("vec_id").cast("long").alias("low")).groupBy("label", "vector").agg(F.min("low").alias("low"), F.count("*").alias("weight"))
    distinct = cut(distinct.withColumn("id", F.xxhash64("label", "vector")))
    sample = [r["vector"] for r in distinct.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(MOST_FIT).collect()]
    axes = _axes(sample, dimensions)
    cells = [f"c{k}" for k in range(dimensions)]
    fields = "label string, vector array<double>, id long, weight long"
    placed = distinct.select("label", "vector", "id", "weight").mapInArrow(_placed(axes, epsilon, dimensions), fields + "".join(f", {c} int" for c in cells))
    order = ["label", F.size("vector"), *cells, "id"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    blocks = spill(placed.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("label", "vector", "id", "weight").mapInArrow(_blocked(axes, dimensions), _BLOCKS))

    def first(side: str, margin: int) -> DataFrame:
        """A row for each cell of the first two dimensions that a block touches, or is ``margin`` cells from."""
        span = lambda k: F.sequence(*[F.floor(F.get(c, F.lit(k)) / epsilon).cast("int") + m for c, m in (("low", -margin), ("high", margin))])
        rows = blocks.select("label", "size", F.explode(span(0)).alias("c0"), *[F.col(c) for c in ("block", "low", "high")])
        return rows.select("label", "size", "c0", F.explode(span(min(1, dimensions - 1))).alias("c1"), *[F.col(c).alias(c + side) for c in ("block", "low", "high")])

    gap = F.aggregate(
        F.zip_with(
            F.zip_with("low", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
        ),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    # the cells of one block and those near the other: blocks within epsilon share one, whichever of them comes first
    pairs = (
        first("", 0)
        .join(first("_b", 1), ["label", "size", "c0", "c1"])
        .where((F.col("block") <= F.col("block_b")) & (gap <= epsilon * epsilon))
        .select("label", "block", "block_b")
        .distinct()
    )
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    pairs = cut(pairs.withColumns({"i": tile("block"), "j": tile("block_b")}))
    places = ["label", "i", "j"]
    asked = pairs.select(*places, "block", F.col("block_b").alias("partner")).unionByName(pairs.select(*places, F.col("block_b").alias("block"), F.lit(None).cast("long").alias("partner")))
    visits = asked.groupBy(*places, "block").agg(F.array_sort(F.collect_set("partner")).alias("partners"))
    met = visits.join(blocks.select("block", "ids", "weights", "unit"), "block").select(*places, "block", "partners", "ids", "weights", "unit")
    tiles = met.repartition(shuffle_width(spark), *places).sortWithinPartitions(*places, "block")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    found = cut(tiles.mapInArrow(_joined(axes, dimensions, epsilon, threshold), "id long, near long, root long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    near = found.groupBy("id").agg(F.sum("near").alias("near"))
    merged = distinct.select("id", "low", "weight").join(near, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = merged.groupBy("root").agg(F.min("low").alias("_near_root"))
    facts = merged.join(least, "root").select(F.col("id").alias("_near_id"), (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("_near_links"), "_near_root")
    keyed = vectors.withColumn("_near_key", F.when(good, F.xxhash64(key, raw)))
    joined = keyed.join(facts, F.col("_near_key") == F.col("_near_id"), "left").drop("_near_key", "_near_id")
    return (
        joined.withColumn("n_links", F.coalesce(F.col("_near_links"), F.lit(0)).cast("long"))
        .withColumn("component_id", F.coalesce(F.col("_near_root"), F.col("vec_id").cast("long")))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
        .drop("_near_links", "_near_root")
    )
