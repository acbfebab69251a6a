"""A durable keyed table that a stream keeps up to date, batch by batch.

    out/delta/<batch id>    what a batch changed, one row a key; a batch that is tried again overwrites itself
    out/base/<batch id>     one row a key after all batches up to that id

A batch counts once its folder is committed, so a job that ends anywhere starts again without losing or doubling a row. Columns
are merged by name: ``sum``, ``min`` and ``max`` add a batch's partial result to what is there, so such a job needs no state in the
stream itself; ``last`` takes the value of the latest batch, for streams whose state the engine holds. Every ``compact_every``
batches the deltas are folded into a new base; the base and deltas before the last one stay for readers that still use them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import folders

MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


class KeyedTable:
    """The table under ``out`` with ``keys``; ``schema`` holds the keys and all columns named in ``merge``."""

    def __init__(self, spark, out, schema, keys, merge, compact_every=10):
        unknown = {c: m for c, m in merge.items() if m != "last" and m not in MERGES}
        if unknown or set(merge) | set(keys) != set(schema.names):
            raise ValueError(f"columns {schema.names} do not match keys {list(keys)} and merges {merge}")
        self.spark, self.out, self.schema, self.keys, self.merge, self.compact_every = spark, out, schema, list(keys), dict(merge), compact_every

    def _ids(self, kind):
        names = folders.children(self.spark, f"{self.out}/{kind}")
        return sorted(int(n) for n in names if n.isdigit() and folders.finished(self.spark, f"{self.out}/{kind}/{n}"))

    def state(self):
        """The id of the newest base (None without one) and the ids of the batches after it."""
        base = max(self._ids("base"), default=None)
        return base, [i for i in self._ids("delta") if base is None or i > base]

    def _folded(self, rows) -> DataFrame:
        last = [c for c, m in self.merge.items() if m == "last"]
        aggs = [MERGES[m](c).alias(c) for c, m in self.merge.items() if m != "last"]
        if last:
            aggs.append(F.max_by(F.struct(*last), "_batch").alias("_last"))
        g = rows.groupBy(*self.keys).agg(*aggs)
        return g.select(*[(F.col(f"_last.{c}") if c in last else F.col(c)).cast(self.schema[c].dataType).alias(c) for c in self.schema.names])

    def read(self) -> DataFrame:
        """One row a key after all committed batches; no rows before the first."""
        base, deltas = self.state()
        paths = ([(base, f"base/{base}")] if base is not None else []) + [(i, f"delta/{i}") for i in deltas]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for i, p in paths:  # at most the base and compact_every deltas
            part = self.spark.read.schema(self.schema).parquet(f"{self.out}/{p}").withColumn("_batch", F.lit(i))
            rows = part if rows is None else rows.unionByName(part)
        return self._folded(rows)

    def commit(self, batch: DataFrame, batch_id):
        """Write what a batch changed, unless a base already holds it, and compact when it is time."""
        base, _ = self.state()
        if base is not None and batch_id <= base:
            return
        folded = self._folded(batch.select(*self.schema.names).withColumn("_batch", F.lit(batch_id)))
        folded.write.mode("overwrite").parquet(f"{self.out}/delta/{batch_id}")
        if len(self.state()[1]) >= self.compact_every:
            self.compact()

    def compact(self):
        """Fold the deltas into a new base and let go of what the base before the last one replaced."""
        base, deltas = self.state()
        if not deltas:
            return
        self.read().write.mode("overwrite").parquet(f"{self.out}/base/{deltas[-1]}")
        if base is not None:
            for kind in ("base", "delta"):
                for i in self._ids(kind):
                    if i < base or (i == base and kind == "delta"):
                        folders.remove(self.spark, f"{self.out}/{kind}/{i}")
