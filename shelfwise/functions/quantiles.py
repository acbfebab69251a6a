"""Exact quantiles, running sums and neighbours that stay safe when one group holds most of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

FAN = 16
#: Rows of a group up to which it may be gathered as one array.
MOST = 4096


def _edge_table(edges):
    """Sorted edges as a two-level table: the first edge of every run, and the runs."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(edges), F.lit(1)), F.lit(FAN))
    return F.struct(F.transform(starts, lambda i: F.try_element_at(edges, i)).alias("head"),
                    F.transform(starts, lambda i: F.slice(edges, i, F.lit(FAN))).alias("runs"))


def _with_edge_index(df: DataFrame, value, table, out) -> DataFrame:
    """Add how many edges are <= value: first the run, then the place in it."""
    v = F.col(value)
    d = df.withColumn("_run", F.size(F.filter(F.col(table)["head"], lambda e: e <= v)))
    inside = F.size(F.filter(F.get(F.col(table)["runs"], F.col("_run") - 1), lambda e: e <= v))
    return d.withColumn(out, F.when(F.col("_run") == 0, 0).otherwise((F.col("_run") - 1) * FAN + inside)).drop("_run")


def _null_safe(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Join on keys of which a null equals a null, as in a grouping."""
    named = right.withColumnsRenamed({k: f"_r_{i}" for i, k in enumerate(keys)})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def sorted_quantiles(values, probs) -> list[Column]:
    """Linear-interpolated quantiles of a sorted array without nulls; null where it is empty."""
    out = []
    for p in probs:
        h = (F.size(values) - 1) * F.lit(float(p))
        lo, hi, part = F.get(values, F.floor(h).cast("int")), F.get(values, F.ceil(h).cast("int")), h - F.floor(h)
        out.append(F.when((part == 0) | (lo == hi), lo).otherwise(lo * (1 - part) + hi * part))  # equal values stay as they are, to the last bit
    return out


def exact_quantiles(df: DataFrame, value, probs, keys=(), splits=64, edges_per_key=False, weight=None, most=MOST):
    """Linear-interpolated quantiles of ``value`` per ``keys`` as array ``q``; null keys are a group of their own.

    The input is read once, for a written table of distinct values and how often they come (``weight``: a column with the
    number of times a row counts). Ranks come from that table alone: groups are cut into value ranges, and only the ranges
    that hold a wanted rank are sorted, so no task sees a whole group. The cuts only balance the work; ranks are exact
    whatever they are.

    Groups of up to ``most`` rows, where there may be many (keys, no weight, no ``edges_per_key``), skip the table: each is one
    short sorted array, from a written copy of the keys and values.
    """
    keys = list(keys)
    v = F.col(value).cast("double") if isinstance(value, str) else value.cast("double")
    n = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*keys, v.alias("_v"), n.cast("long").alias("_n")).where("_v IS NOT NULL AND NOT isnan(_v) AND abs(_v) < double('infinity')")
    if not keys:
        rows = rows.withColumn("_k", F.lit(0))
    ks = keys or ["_k"]
    few = None
    if keys and weight is None and not edges_per_key:
        rows = materialize(rows)
        many = materialize(rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most).select(*ks))
        some = not many.isEmpty()
        short = _null_safe(rows, F.broadcast(many), ks, "left_anti") if some else rows
        few = short.groupBy(*ks).agg(F.sort_array(F.collect_list("_v")).alias("_l")).select(*ks, F.array(*sorted_quantiles(F.col("_l"), probs)).alias("q"))
        if not some:
            return few
        rows = _null_safe(rows, F.broadcast(many), ks, "left_semi")
    counts = materialize(rows.groupBy(*ks, "_v").agg(F.sum("_n").alias("_n")))
    cuts = [i / splits for i in range(1, splits)]
    if edges_per_key:
        edges = counts.groupBy(*ks).agg(F.percentile_approx("_v", cuts, 1000).alias("_e")).withColumn("_e", _edge_table(F.col("_e")))
        cut = _null_safe(counts, edges, ks)
    else:
        cut = counts.withColumn("_e", counts.agg(F.percentile_approx("_v", cuts, 1000).alias("_e")).select(_edge_table(F.col("_e"))).scalar())
    cut = materialize(_with_edge_index(cut, "_v", "_e", "_b").select(*ks, "_b", "_v", "_n"))
    per_key = Window.partitionBy(*ks)
    ranges = (
        cut.groupBy(*ks, "_b").agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bn").over(per_key))
        .withColumn("_start", F.col("_end") - F.col("_bn"))
    )

    def ranks(p):
        h = (F.col("_total") - 1) * F.lit(float(p))
        return h, F.floor(h), F.ceil(h)

    def held(rank):
        return (rank >= F.col("_start")) & (rank < F.col("_end"))

    wanted = ranges.where(reduce(lambda a, b: a | b, [held(r) for p in probs for r in ranks(p)[1:]]))
    within = Window.partitionBy(*ks, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        _null_safe(cut, wanted.select(*ks, "_b", F.col("_start").alias("_s"), "_total"), [*ks, "_b"])
        .withColumn("_end", F.col("_s") + F.sum("_n").over(within))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    picks = []
    for i, p in enumerate(probs):
        _, lo, hi = ranks(p)
        picks += [F.max(F.when(held(lo), F.col("_v"))).alias(f"_lo{i}"), F.max(F.when(held(hi), F.col("_v"))).alias(f"_hi{i}")]
    got = placed.groupBy(*ks).agg(F.max("_total").alias("_total"), *picks)

    def between(i, p):
        part, lo, hi = ranks(p)[0] - ranks(p)[1], F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when((part == 0) | (lo == hi), lo).otherwise(lo * (1 - part) + hi * part)  # equal values stay as they are, to the last bit
    out = got.select(*keys, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias("q"))
    return out if few is None else out.unionByName(few)


def quantile_scalar(df: DataFrame, value, probs, **kw) -> Column:
    """Global quantiles as a scalar subquery column (array of double)."""
    return exact_quantiles(df, value, probs, **kw).select("q").scalar()


def column_quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """One row with an array of global quantiles per column, all columns in one pass."""
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "_f", "_x")
    q = exact_quantiles(long, "_x", probs, keys=["_f"], edges_per_key=True)
    return q.agg(*[F.max(F.when(F.col("_f") == c, F.col("q"))).alias(c) for c in cols])


def attach_quantiles(df: DataFrame, cols, probs, name="_q") -> DataFrame:
    """Add the global quantiles of ``cols`` as one struct column."""
    return df.withColumn(name, column_quantiles(df, cols, probs).select(F.struct("*")).scalar())


def bin_by_edges(value, edges) -> Column:
    """Zero-based quantile bin: the number of interior edges below ``value``.

    ``edges`` is the raw edge array; repeated edges are merged first, so bins
    are right-closed and the lowest edge belongs to the first bin.
    """
    uniq = F.array_sort(F.array_distinct(edges))
    inner = F.slice(uniq, F.lit(2), F.greatest(F.size(uniq) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e < value)).cast("int")


def qcut(df: DataFrame, columns: dict, q: int) -> DataFrame:
    """Add a bin column per ``{out: column}``; equal values share a bin."""
    d = attach_quantiles(df, list(dict.fromkeys(columns.values())), [i / q for i in range(q + 1)])
    return d.withColumns({out: bin_by_edges(F.col(c), F.col(f"_q.{c}")) for out, c in columns.items()}).drop("_q")


def split_running_sum(df: DataFrame, keys, part, order, sums: dict) -> DataFrame:
    """Running totals ``{value: out}`` per ``keys`` in ``order``, computed on slices of a group.

    ``part`` names a column that rises with ``order`` (a day, a score band).
    Each slice is summed on its own; the totals of earlier slices come from an
    aggregate with one row per slice. A hot key is spread over its slices.
    """
    keys = list(keys)
    ks = keys + [part]
    inner = Window.partitionBy(*ks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*ks).agg(*[F.sum(v).alias(f"_t_{o}") for v, o in sums.items()])
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(
        Window.unboundedPreceding, 0)
    offsets = totals.select(*ks, *[(F.sum(f"_t_{o}").over(across) - F.col(f"_t_{o}")).alias(f"_off_{o}") for o in sums.values()])
    run = df.withColumns({o: F.sum(v).over(inner) for v, o in sums.items()}).join(offsets, ks)
    return run.withColumns({o: F.col(o) + F.col(f"_off_{o}") for o in sums.values()}).drop(*[f"_off_{o}" for o in sums.values()])


def split_neighbor(df: DataFrame, keys, part, order, col, out, ahead=False) -> DataFrame:
    """Previous (or next, with ``ahead``) value of ``col`` per ``keys`` in ``order``, on slices of a group.

    Inside a slice it is a plain window; the first row of a slice takes the edge
    value of the slice before it, found among one row per slice.
    """
    ks = [*keys, part]
    w = Window.partitionBy(*ks).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(part)
    pick, shift = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    edge = df.groupBy(*ks).agg(pick(col, F.struct(*order)).alias("_v"))
    edge = edge.select(*ks, shift("_v").over(across).alias("_carry"))
    inside = F.when(shift(F.lit(1)).over(w) == 1, shift(col).over(w))
    first = shift(F.lit(1)).over(w).isNull()
    return df.withColumns({"_in": inside, "_first": first}).join(edge, ks).withColumn(
        out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in"))).drop("_in", "_first", "_carry")


def balanced_slices(df: DataFrame, col, out="_s", slices=1000, descending=True) -> DataFrame:
    """Slice numbers that follow ``col`` and hold about equally many rows, from a bounded sketch of it."""
    edges = df.agg(F.percentile_approx(F.col(col).cast("double"), [i / slices for i in range(1, slices)], 10000).alias("e")).select(
        _edge_table(F.col("e"))).scalar()
    d = _with_edge_index(df.withColumns({"_e": edges, "_x": F.col(col).cast("double")}), "_x", "_e", out).drop("_e", "_x")
    return d.withColumn(out, -F.col(out)) if descending else d


def attach(df: DataFrame, small: DataFrame, keys=()) -> DataFrame:
    """Add the columns of an aggregate: by its keys, or as a scalar when it is one row."""
    if keys:
        return df.join(small, list(keys))
    return df.withColumn("_z", small.select(F.struct("*")).scalar()).select("*", "_z.*").drop("_z")
