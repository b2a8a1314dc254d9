"""Exact nearest neighbours by cosine distance.

Queries are a stated set; they go to the tasks in blocks of bounded size.  Each task
keeps its k best for each query, so the shuffle carries k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_k

BLOCK = 4096


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as unit vectors; null, odd-sized and zero vectors become zeros."""
    rows = np.zeros((len(column), size))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == size and all(x is not None for x in v):
            rows[i] = v
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def cosine(a, b) -> F.Column:
    """Cosine of two array columns, in the JVM."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def knn(items: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_key: str = "vec_id", query_vector: str = "embedding", keep_self: bool = True) -> DataFrame:
    """(query, document, score, rank): score is 1 - cosine distance; ties by the smaller id."""
    spark, out = items.sparkSession, None
    source = items.select(F.col(key).cast("long").alias("document"), F.col(vector).alias("vector")).filter("vector is not null")
    schema = "query long, document long, score double"
    block: list = []

    def search(rows: list) -> DataFrame:
        ids, size = np.array([r[0] for r in rows]), len(rows[0][1])
        held = spark.sparkContext.broadcast((ids, _matrix(pa.array([list(r[1]) for r in rows]), size)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit = held.value
            best: tuple | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = np.asarray(batch.column(0))
                scores = np.round(unit @ _matrix(batch.column(1), unit.shape[1]).T, 12)
                if not keep_self:
                    scores[ids[:, None] == names[None, :]] = -2
                names = np.broadcast_to(names, scores.shape)
                if best is not None:
                    names, scores = np.concatenate([best[0], names], axis=1), np.concatenate([best[1], scores], axis=1)
                order = np.lexsort((names, -scores), axis=1)[:, :k]
                best = np.take_along_axis(names, order, 1), np.take_along_axis(scores, order, 1)
            if best is not None:
                names, scores = best
                good = scores.ravel() > -2
                query = np.repeat(ids, names.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in (query, names.ravel(), scores.ravel())], ["query", "document", "score"])

        return source.mapInArrow(run, schema)

    for row in queries.select(F.col(query_key).cast("long"), F.col(query_vector)).filter(F.col(query_vector).isNotNull()).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            found = search(block)
            out, block = found if out is None else out.unionByName(found), []
    if block:
        found = search(block)
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return top_k(out, k, ["query"], [F.desc("score"), F.asc("document")])


def embedding_failures(items: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, reason) of vectors that are missing, empty, of another size, or hold nulls."""
    v = F.col(vector)
    reason = F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(F.size(v) != size, "dimension").when(F.exists(v, lambda x: x.isNull()), "null_value")
    return items.select(key, reason.alias("reason")).filter("reason is not null")
