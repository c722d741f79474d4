"""Vector retrieval with filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import vocabulary as V
from murmur.functions.scalars import cosine


def nearest(vectors: DataFrame, query: list[float], *, k: int | None = V.TOP_K, min_similarity: float | None = V.MIN_SIMILARITY, where: Column | None = None, id_col: str = "event_id", vector: str = "embedding") -> DataFrame:
    """Rows of vectors with ``similarity`` to a query vector, at least min_similarity, k at most, most similar first,
    then by id.  Rows without a vector are not seen; the filter runs before any similarity is taken.  An exact scan:
    each task keeps its own k."""
    rows = vectors.where(F.col(vector).isNotNull())
    if where is not None:
        rows = rows.where(where)
    q = F.array(*[F.lit(round(float(x), 6)) for x in query])
    rows = rows.withColumn("similarity", cosine(vector, q))
    if min_similarity is not None:
        rows = rows.where(F.col("similarity") >= min_similarity)
    return rows.orderBy(F.desc("similarity"), id_col).limit(k) if k is not None else rows


def nearest_batch(vectors: DataFrame, queries: DataFrame, *, k: int, id_col: str, vector: str = "embedding", query_id: str = "query_id", max_queries: int = 1000, max_rows: int = 4096) -> DataFrame:
    """(query_id, id_col, similarity, rank) for a batch of query vectors, an exact scan: queries and rows are dealt by hash to
    blocks of about max_queries and max_rows, each an array in a row of its own; each block of rows meets each block of queries
    once, in a task that keeps the k best of each query."""
    double = F.transform(vector, lambda x: x.cast("double")).alias("v")
    some = vectors.where(F.col(vector).isNotNull()).select(F.struct(F.col(id_col).alias("id"), double).alias("h"))
    rows = _blocks(some, "rows", max_rows)
    held = _blocks(queries.select(F.struct(F.col(query_id).alias("id"), double).alias("h")), "held", max_queries)
    ids = {f.name: f.dataType.simpleString() for f in (queries.schema[query_id], vectors.schema[id_col])}
    names = [query_id, id_col, "similarity"]
    found = rows.crossJoin(held).mapInArrow(_best(k, names), f"`{query_id}` {ids[query_id]}, `{id_col}` {ids[id_col]}, similarity double")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(df: DataFrame, name: str, size: int) -> DataFrame:
    """The structs h of df in arrays of about ``size``, dealt by hash, each in the order of its ids."""
    n = -(-df.count() // size) or 1
    return df.groupBy(F.pmod(F.xxhash64("h"), F.lit(n)).alias("_b")).agg(F.array_sort(F.collect_list("h")).alias(name)).select(name)


def _best(k: int, names: list[str]):
    """For mapInArrow, on rows (rows, held) of blocks: the k most similar rows of each query, ties by place.  Products are summed
    from the first dimension to the last, as Spark's aggregate does, so equal vectors tie.  A similarity is null where lengths
    differ, an element is null or a vector has no length; nulls come last and NaN first, as Spark orders them."""

    def best(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def parts(block):
            """The ids of a block, the places and values of its vectors of each length, and their norms."""
            ids, v = pc.struct_field(block, "id"), pc.struct_field(block, "v")
            size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
            flat = v.flatten()
            own = np.repeat(np.arange(len(size)), np.maximum(size, 0))
            start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            size[own[flat.is_null().to_numpy(zero_copy_only=False)]] = -1  # such a vector has no similarity
            flat = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            out = {}
            for n in set(size[size > 0].tolist()):
                at = np.flatnonzero(size == n)
                x = np.ascontiguousarray(flat[start[at][:, None] + np.arange(n)].T)
                norm = np.zeros(len(at))
                for d in x:
                    norm += d * d
                out[n] = at, x, np.sqrt(norm)
            return ids, out

        def pairs(rows, held):
            r_ids, r = rows
            q_ids, q = held
            score = np.full((len(q_ids), len(r_ids)), -np.inf)  # null
            for n in r.keys() & q.keys():
                (ra, rx, rn), (qa, qx, qn) = r[n], q[n]
                for i in range(0, len(qa), 8):  # what fits a core's cache
                    dot = np.zeros((len(qa[i : i + 8]), len(ra)))
                    part = np.empty_like(dot)
                    for d in range(n):
                        dot += np.multiply(qx[d, i : i + 8, None], rx[d], out=part)
                    norms = qn[i : i + 8, None] * rn
                    got = np.where(norms == 0, -np.inf, dot / np.where(norms == 0, 1, norms))
                    score[qa[i : i + 8, None], ra] = np.where(np.isnan(got), np.inf, got)
            if k < len(r_ids):
                least = np.partition(score, len(r_ids) - k, axis=1)[:, len(r_ids) - k, None]
                at_q, at_r = np.nonzero(score >= least)
            else:
                at_q, at_r = np.nonzero(np.ones_like(score, bool))
            s = score[at_q, at_r]
            order = np.lexsort((at_r, -s, at_q))
            at_q, at_r, s = at_q[order], at_r[order], s[order]
            first = np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < k
            at_q, at_r, s = at_q[first], at_r[first], s[first]
            s = pa.array(np.where(s == np.inf, np.nan, s), pa.float64(), mask=s == -np.inf, from_pandas=False)
            return pa.RecordBatch.from_arrays([q_ids.take(pa.array(at_q)), r_ids.take(pa.array(at_r)), s], names=names)

        with np.errstate(all="ignore"):
            for b in batches:
                for i in range(b.num_rows):
                    yield pairs(parts(b.column("rows")[i].values), parts(b.column("held")[i].values))

    return best
