"""Nearest neighbours by stable random projections and kd-trees.

Largest inner products become smallest distances by one more coordinate (what a vector lacks to the largest norm of its
block), and Gaussian projections to ``low`` dimensions keep distances in distribution: the squared projected distance over
the squared true one is chi-square with ``low`` degrees of freedom. Vectors are dealt to blocks, each with a kd-tree over its
projected points. A query takes a block's leaves by their projected distance and verifies points by exact inner products,
until the chi-square test holds: a vector nearer than the k-th best would have shown up by now with probability ``sure``.

Every row is indexed; blocks of queries meet blocks of rows, and the best of all blocks are merged, so that nothing grows
with the table but the number of blocks.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id; an id that comes
more than once counts with its smallest vector. Vectors of different lengths do not meet. Ties go to the smaller id. With
fewer candidates than k, all are returned; no rows give none. Columns other than vec_id and embedding do not take part.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import materialize

LEAF = 64
AT_ONCE = 8  # leaves visited before the first test; then four times as many before the next


def chi_square_quantile(dims, p):
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""
    def below(x):
        term = total = math.exp(-x / 2)
        for k in range(1, dims // 2):
            term *= x / 2 / k
            total += term
        return 1 - total
    low, high = 0.0, 20.0 * dims
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(dims, low, seed):
    """Gaussian directions for vectors of ``dims`` components and the added one."""
    return np.random.default_rng([seed, dims]).standard_normal((dims + 1, low))


def kd_leaves(points, leaf=LEAF):
    """A kd-tree's leaves: an order of the points, the leaves' starts in it, and the corners of their boxes."""
    order, starts, todo, done = np.arange(len(points)), [], [(0, len(points))], []
    while todo:
        a, b = todo.pop()
        part = points[order[a:b]]
        if b - a <= leaf:
            done.append((a, part.min(axis=0), part.max(axis=0)))
            continue
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
        todo += [(a, a + half), (a + half, b)]
    done.sort(key=lambda d: d[0])
    starts = np.array([d[0] for d in done] + [len(points)])
    return order, starts, np.stack([d[1] for d in done]), np.stack([d[2] for d in done])


def index_block(vectors, ids, low, seed):
    """A block's vectors and ids in the order of its kd-tree's leaves, with projected points, their squared lengths,
    leaf starts, box corners and the largest squared norm."""
    directions = projection(vectors.shape[1], low, seed)
    norms = (vectors ** 2).sum(axis=1)
    most = norms.max()
    points = vectors @ directions[:-1] + np.sqrt(np.maximum(most - norms, 0))[:, None] * directions[-1]
    order, starts, least, largest = kd_leaves(points)
    points = points[order]
    return vectors[order], ids[order], points, (points ** 2).sum(axis=1), starts, least, largest, most


def products(matrix, rows, vector):
    """Products of some rows with a vector; of many rows, out of those of all, which need no copy."""
    return (matrix @ vector)[rows] if 4 * len(rows) > len(matrix) else matrix[rows] @ vector


def search_block(queries, query_ids, index, k, low, sure, seed):
    """The best k of a block for each query, as (query, ids, scores) with the largest scores first and ties by id.

    Leaves come by the distance of their boxes in growing stretches; of each, the points that the test does not rule out
    are verified, until no leaf left passes it."""
    vectors, ids, points, square, starts, least, largest, most = index
    limit, sizes = chi_square_quantile(low, sure), np.diff(starts)
    at_all = queries @ projection(vectors.shape[1], low, seed)[:-1]
    for q, qid, at in zip(queries, query_ids, at_all):
        gap = np.maximum(np.maximum(least - at, at - largest), 0)
        gap = np.einsum("ij,ij->i", gap, gap)
        by_gap = np.argsort(gap, kind="stable")
        best_s, best_i, far = np.empty(0), np.empty(0, np.int64), np.inf
        base, done, step = q @ q + most, 0, AT_ONCE
        while done < len(by_gap) and gap[by_gap[done]] <= limit * far:
            leaves = by_gap[done:done + step]
            leaves = leaves[gap[leaves] <= limit * far]
            done, step = done + step, 4 * step
            chosen = np.zeros(len(starts) - 1, bool)
            chosen[leaves] = True
            rows = np.flatnonzero(np.repeat(chosen, sizes))
            if far < np.inf:
                rows = rows[square[rows] - 2 * products(points, rows, at) <= limit * far - at @ at + 1e-9 * base]
            rows = rows[ids[rows] != qid]
            s = products(vectors, rows, q)
            if len(best_s) == k:  # no worse than the last of the best, but for rounding
                near = s >= best_s.min() - 1e-9 * base
                rows, s = rows[near], s[near]
            elif len(s) > k:
                near = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * base
                rows, s = rows[near], s[near]
            best_s = np.concatenate([best_s, (vectors[rows] * q).sum(axis=1)])  # one order of adding, whatever the rows beside
            best_i = np.concatenate([best_i, ids[rows]])
            keep = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[keep], best_i[keep]
            if len(best_s) == k:
                far = max(base - 2 * best_s.min(), 0) * (1 + 1e-9) + 1e-12
        yield int(qid), best_i, best_s


def _packed(df, name, per_block):
    """Blocks of at most about ``per_block`` vectors of one length, one row each: dims, <name>, ids, data."""
    schema = StructType([StructField("dims", IntegerType()), StructField(name, IntegerType()), StructField("ids", BinaryType()), StructField("data", BinaryType())])
    n = max(1, -(-df.count() // per_block))

    def pack(key, table):
        flat = table.column("embedding").combine_chunks().flatten()
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int32()),
                         "ids": [table.column("vec_id").to_numpy().astype("<i8").tobytes()], "data": [flat.to_numpy(zero_copy_only=False).astype("<f8").tobytes()]})
    dealt = df.withColumn("dims", F.size("embedding")).withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return materialize(dealt.select("dims", name, "vec_id", "embedding").groupBy("dims", name).applyInArrow(pack, schema))


def usable(df):
    """Rows with an id and a finite vector other than zero, one an id."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(df, is_query, k=20, low=16, sure=0.97, seed=11, rows_a_block=8192, queries_a_block=2048):
    """For each row that ``is_query`` holds for: query_id, rank, vec_id, score of the k largest inner products found."""
    rows = materialize(usable(df))
    data, asked = _packed(rows, "block", rows_a_block), _packed(rows.where(is_query), "asked", queries_a_block)
    schema = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)
        for b in batches:
            for r in b.to_pylist():
                ids, qids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["query_ids"], "<i8")
                index = index_block(np.frombuffer(r["data"], "<f8").reshape(len(ids), -1), ids, low, seed)
                found = list(search_block(np.frombuffer(r["queries"], "<f8").reshape(len(qids), -1), qids, index, k, low, sure, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                                                  pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], schema=out)
    # the stated queries against all rows, in blocks: each block of rows goes to the blocks of queries of its length
    targets = asked.groupBy("dims").agg(F.collect_list("asked").alias("to"))
    sources = data.groupBy("dims").agg(F.collect_list("block").alias("from"))
    left = data.join(targets, "dims").withColumn("asked", F.explode("to")).drop("to")
    right = asked.withColumnsRenamed({"ids": "query_ids", "data": "queries"}).join(sources, "dims").withColumn("block", F.explode("from")).drop("from")
    found = left.join(right, ["dims", "block", "asked"]).select("ids", "data", "query_ids", "queries").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
