"""Exact cosine search: every row against every query, as matrix products in Arrow batches.

The queries are a stated set, handled in blocks of bounded size; rows are multiplied with the block a bounded number at a
time and only the best of each query go on, so what reaches the shuffle is k rows a query and task.  Filters are applied before the
search, where Parquet sees them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.operators.bm25 import ranked
from lectern.operators.topk import Best

#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 4096


def unit(vector: Column) -> Column:
    """The vector divided by its length."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) / F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))


def _search(names: list, matrix: np.ndarray, k: int, types: list, groups: list | None = None):
    """``groups``: of each query the group of rows it is asked within, or None; a row's group is the third column."""

    def within(column: pa.Array) -> np.ndarray:
        """A cell for each row and query."""
        places = {g: i for i, g in enumerate(dict.fromkeys(g for g in groups if g is not None))}
        row = np.array([places.get(g, -1) for g in column.to_pylist()])
        query = np.array([-2 if g is None else places[g] for g in groups])
        return (row[:, None] == query) | (query == -2)

    def run(batches):
        unit_q = (matrix / np.sqrt((matrix * matrix).sum(1))[:, None]).T
        best = Best(names, k)
        for batch in batches:
            column = batch.column(1)
            usable = pc.fill_null(pc.equal(pc.list_value_length(column), matrix.shape[1]), False)
            kept, ids = column.filter(usable), batch.column(0).filter(usable).to_pylist()
            cells = within(batch.column(2).filter(usable)) if groups is not None else None
            for i in range(0, len(kept), best.step()):
                part = kept.slice(i, best.step())
                rows = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                norm = np.sqrt((rows * rows).sum(1))
                some = norm > 0
                if some.any():
                    best.take((rows[some] / norm[some][:, None]) @ unit_q, [x for x, y in zip(ids[i : i + len(part)], some, strict=True) if y], None if cells is None else cells[i : i + len(part)][some])
        yield best.batch(types)

    return run


def vector_topk(rows: DataFrame, queries: DataFrame, k: int = 5, where: Column | str | None = None, within: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest of ``rows`` (id, vector, ...) for each of ``queries`` (qid, vector).

    ``where`` filters rows before they are ranked; it may be any boolean expression over their columns.  ``within`` names a
    column of both tables: a query that has a value there is asked among the rows that have the same, in the same pass.
    """
    spark = rows.sparkSession
    more = [] if within is None else [within]
    source = (rows if where is None else rows.where(where)).select("id", "vector", *more)
    qtype, itype = dict(queries.dtypes)["qid"], dict(source.dtypes)["id"]
    found = spark.createDataFrame([], f"qid {qtype}, id {itype}, score double")
    asked = queries.where(F.col("vector").isNotNull()).select("qid", "vector", *more)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        for size in sorted({len(r["vector"]) for r in part}):
            mine = [r for r in part if len(r["vector"]) == size]
            groups = None if within is None else [r[within] for r in mine]
            run = _search([r["qid"] for r in mine], np.array([r["vector"] for r in mine], float), k, [to_arrow_type(f.dataType) for f in found.schema], groups)
            needed = source if groups is None or None in groups else source.where(F.col(within).isin(list(dict.fromkeys(groups))))
            found = found.unionByName(needed.mapInArrow(run, found.schema))
    return ranked(found, k).withColumn("score", F.round("score", 6))
