"""Packs token pieces into as few fixed-length sequences as a best-fit start and a swap-based local search can.

Documents are encoded where they lie; only lengths travel. Pieces are dealt to groups of bounded size, each packed by
best fit decreasing. Then bins below the capacity take part in a local search: moves of one document, exchanges of one
for one and of two for one between bins, each of which raises the sum of squared fills, until bins are empty; it ends
when no bin can be emptied or the bins are as few as the total length allows.

Groups are dealt by hash, or (``ordered``) by ranges of the order that the documents have in their files, by names of files and
rows in them: groups and, in a group, sequences by the place of their longest piece are then numbered in that order.

A document is its ids and an end id; only one longer than the capacity is cut, and its last piece may be shorter.
Null and empty texts hold the end id alone. Repeated rows are packed as often as they come, with their null or repeated
ids; no rows give no pieces. Columns other than doc_id and text do not take part.
"""

from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..session import materialize
from .text import RUNS, batch, crc_of, text_column, word_tokenizer


#: Pieces that stand side by side in a file and are counted as one to find their places.
RUN = 1_000
SLICE = 512  # texts at once outside of their Arrow batch
_PLACE = (("file", StringType), ("run_row", LongType), ("run_piece", IntegerType), ("in_run", IntegerType))


def pieces(df, tokenizer, end_id, capacity, with_ids=True, placed=False, runs=RUNS):
    """Per piece: row (a number of its own), doc_id, piece, start, length, ids_crc32 and, if asked, ids; ``placed``: of a frame
    read from files also the file, the first row and piece of a run of pieces in it, and the number in that run. ``runs``: how many runs of characters a
    worker remembers."""
    kinds = (("row", LongType), ("doc_id", LongType), ("piece", IntegerType), ("start", LongType), ("length", LongType), ("ids_crc32", LongType))
    schema = StructType([StructField(c, t()) for c, t in kinds + _PLACE * placed] + [StructField("ids", BinaryType())] * with_ids)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        tok, out = word_tokenizer(tokenizer, runs), to_arrow_schema(schema)
        row = TaskContext.get().partitionId() << 40
        run_of = (None, 0, 0, RUN)
        for b in batches:
            got = {f.name: [] for f in out}
            column = b.column("text").cast(pa.string())
            texts = (t or "" for i in range(0, b.num_rows, SLICE) for t in column.slice(i, SLICE).to_pylist())
            places = zip(*(b.column(c).to_pylist() for c in ("file", "at"))) if placed else repeat(None)
            for d, ids, at in zip(b.column("doc_id").to_pylist(), tok.each(texts), places):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start:start + capacity]
                    for c, v in zip(("row", "doc_id", "piece", "start", "length", "ids_crc32"), (row, d, k, start, len(cut), crc_of(cut))):
                        got[c].append(v)
                    if with_ids:
                        got["ids"].append(cut.tobytes())
                    if placed:
                        file, first, first_piece, n = run_of
                        run_of = (file, first, first_piece, n + 1) if file == at[0] and n + 1 < RUN else (*at, k, 0)
                        for (c, _), v in zip(_PLACE, run_of):
                            got[c].append(v)
                    row += 1
            yield batch(out, **got)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")] * placed
    return text_column(df, F.col("doc_id").cast("long").alias("doc_id"), *where).mapInArrow(run, schema)


def in_order(table):
    """Replaces the place columns of a written table of pieces by ``pack_place``, the number in the order of files and rows."""
    key = ["file", "run_row", "run_piece"]
    runs = materialize(table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    files = sorted((r["file"], r["n"]) for r in runs.groupBy("file").agg(F.sum("n").alias("n")).collect())  # a row a file
    starts = [0, *accumulate(n for _, n in files)]
    first = table.sparkSession.createDataFrame([(f, i) for (f, _), i in zip(files, starts)], "file string, before long")
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("run_row", "run_piece"))  # a row a run
    base = runs.withColumn("base", upto - F.col("n")).join(first, "file").select(*key, (F.col("base") + F.col("before")).alias("base"))
    return table.join(base, key).withColumn("pack_place", F.col("base") + F.col("in_run")).drop(*(c for c, _ in _PLACE), "base")


def best_fit(sizes, capacity):
    """Bins as lists of positions: the largest first, each into the fullest bin that has room."""
    bins, room, by_room, has = [], [], [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        s = int(sizes[i])
        fits = has >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                has &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        room[b] = r - s
        by_room[r - s].append(b)
        has |= 1 << (r - s)
    return bins


class _Search:
    """Local search over bins with room; every step raises the sum of squared fills."""

    def __init__(self, bins, sizes, capacity):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins
        self.fill = np.array([sum(int(sizes[i]) for i in b) for b in bins], np.int64)

    def table(self, donor):
        """Single items and pairs of items of all other bins with room, as arrays: size, bin, first, second."""
        size, of, one, two = [], [], [], []
        for b, items in enumerate(self.bins):
            if b == donor or not items or self.fill[b] >= self.capacity:
                continue
            for i in items:
                size.append(self.sizes[i]), of.append(b), one.append(i), two.append(-1)
            for i, j in combinations(items, 2):
                size.append(self.sizes[i] + self.sizes[j]), of.append(b), one.append(i), two.append(j)
        return [np.array(x, np.int64) for x in (size, of, one, two)]

    def shift(self, out, into, a, b):
        """Items ``out`` of bin a go to bin b, and ``into`` the other way."""
        for i in out:
            self.bins[a].remove(i)
        for i in into:
            self.bins[b].remove(i)
        self.bins[b] += out
        self.bins[a] += into
        d = sum(int(self.sizes[i]) for i in out) - sum(int(self.sizes[i]) for i in into)
        self.fill[a] -= d
        self.fill[b] += d

    def move(self, donor):
        """One item into the fullest bin that has room for it and is at least as full as what is left."""
        for i in sorted(self.bins[donor], key=lambda i: -self.sizes[i]):
            s = int(self.sizes[i])
            ok = (self.fill + s <= self.capacity) & (self.fill + s > self.fill[donor]) & (self.fill > 0)
            ok[donor] = False
            if ok.any():
                self.shift([i], [], donor, int(np.argmax(np.where(ok, self.fill, -1))))
                return True
        return False

    def exchange(self, donor, table):
        """One or two items for one or two smaller in sum, of a bin that stays within the capacity: the largest gain."""
        size, of, one, two = table
        fill = self.fill[of]
        best = (0,)
        items = self.bins[donor]
        for out in [*((i,) for i in items), *combinations(items, 2)]:
            s = sum(int(self.sizes[i]) for i in out)
            d = s - size
            ok = (d > 0) & (fill + d <= self.capacity) & (fill + d > self.fill[donor])
            if len(out) == 2:
                ok &= two < 0
            if ok.any():
                at = int(np.argmax(np.where(ok, d, -1)))
                if d[at] > best[0]:
                    best = (int(d[at]), list(out), at)
        if not best[0]:
            return False
        _, out, at = best
        into = [int(one[at])] + ([int(two[at])] if two[at] >= 0 else [])
        self.shift(out, into, donor, int(of[at]))
        return True

    def run(self, patience):
        failed, tried = 0, set()
        least = -(-int(self.fill.sum()) // self.capacity)
        while failed < patience:
            live = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            if np.count_nonzero(self.fill) <= least:
                break
            live = [int(b) for b in live[np.argsort(self.fill[live], kind="stable")] if int(b) not in tried]
            if not live:
                break
            donor = live[0]
            while self.bins[donor]:
                if self.move(donor):
                    continue
                if not self.exchange(donor, self.table(donor)):
                    break
            if self.bins[donor]:
                failed += 1
                tried.add(donor)
        return [b for b in self.bins if b]


def pack_lengths(sizes, capacity, patience=20):
    """Bins as lists of positions, for lengths of at most ``capacity``."""
    bins = best_fit(sizes, capacity)
    full = [b for b in bins if sum(int(sizes[i]) for i in b) == capacity]
    rest = [b for b in bins if sum(int(sizes[i]) for i in b) < capacity]
    return full + _Search(rest, sizes, capacity).run(patience)


def pack(table, capacity, group=20_000, patience=20, ordered=False):
    """Adds sequence_id and offset to a table of pieces with columns row and length, and if ``ordered`` the place columns
    (read twice, so a written one)."""
    total = table.count()
    n = max(1, -(-total // group))
    if ordered:
        table = in_order(table)
    schema = StructType([*table.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(key, rows):
        if ordered:
            rows = rows.sort_values("pack_place", ignore_index=True)
        sizes = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        bins = pack_lengths(sizes, capacity, patience)
        if ordered:
            bins.sort(key=lambda b: max((sizes[i], -i) for i in b)[1], reverse=True)
        for k, b in enumerate(bins):
            sequence[b] = key[0] * (1 << 32) + k
            offset[b] = np.concatenate([[0], np.cumsum(sizes[b])[:-1]])
        rows = rows.drop(columns="pack_group")
        rows["sequence_id"], rows["offset"] = pd.Series(sequence, rows.index), pd.Series(offset, rows.index)
        return rows
    number = F.floor(F.col("pack_place") * n / max(1, total)).cast("long") if ordered else F.pmod(F.xxhash64("row"), F.lit(n))
    dealt = table.withColumn("pack_group", number)
    return dealt.repartition(n, "pack_group").groupBy("pack_group").applyInPandas(run, schema).drop("pack_place")


def pack_documents(df, tokenizer, end_id=0, capacity=2048, group=20_000, ordered=False, runs=RUNS):
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``ordered``: ``df`` as read from files whose
    order the sequences shall follow."""
    table = materialize(pieces(df, tokenizer, end_id, capacity, with_ids=False, placed=ordered, runs=runs))
    return pack(table, capacity, group, ordered=ordered).drop("row")


def sequences(table):
    """The sequences themselves: sequence_id and its ids, from packed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return table.groupBy("sequence_id").agg(ids.alias("ids"))
