"""Mixes sources to target weights by Pfair scheduling, with DataFrame operations on the data.

Each source's documents, in the order of the md5 of their ids, fill blocks of ``block_chars`` characters. A source of weight
w (a whole number, W the sum of the weights of the sources that still have blocks) gets block i released at slot
floor((i - 1) W / w) and due at slot ceil(i W / w); in each slot the released block with the earliest deadline goes next.
So after any slot, a source has had less than one block more or fewer than its weight asks for. When a source runs out, a
new phase begins in which the others share the slots by their weights, with the same bound counted from its start.

The schedule depends on the weights and the number of blocks of each source alone. One period of W slots is made per
phase (a table of at most sources x W rows, whatever the documents), and a block's slot follows from the period it
falls into and its place there. No document is dropped or repeated.

A document that is longer than a block spans the following blocks of its source, too, and stands in the first.
Null sources count as one source of their own, null and empty texts as of no length; sources without a target get
weight 1, and a weight below 1 counts as 1. Repeated rows stand side by side in an order of no matter; no rows give none.
All columns of the input are kept; position columns replace any of the same names.

Ordered output moves the texts once: places and slots are found on ids and sizes alone, and from them the first document
of each source in each part of the order. These bounds (at most sources x parts rows) tell a whole row its part, and running
sums within the part give the places again.
"""

import heapq

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def period(weights):
    """Sources by slot for one period of sum(weights) slots: released blocks, earliest deadline first."""
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s, 1) for s, w in sorted(weights.items())]
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        w = weights[s]
        heapq.heappush(waiting, (i * total // w, -(-(i + 1) * total // w), s, i + 1))
    return out


def phases(weights, blocks):
    """Phases as (first slot, weights of the live sources, order of a period, blocks each has had before); each ends when
    a source has had its last block."""
    left = {s: n for s, n in blocks.items() if n > 0}
    had, first, out = dict.fromkeys(left, 0), 0, []
    while left:
        live = {s: weights[s] for s in left}
        order, total = period(live), sum(live.values())
        out.append((first, live, order, dict(had)))
        place = {}
        for slot, s in enumerate(order):
            place.setdefault(s, []).append(slot)
        end = {s: (n - 1) // live[s] * total + place[s][(n - 1) % live[s]] for s, n in left.items()}
        last = min(end.values())
        rounds, rest = divmod(last + 1, total)
        for s in list(left):
            got = rounds * live[s] + sum(slot < rest for slot in place[s])
            had[s] += got
            left[s] -= got
            if left[s] == 0:
                del left[s]
        first += last + 1
    return out


def _hash(column):
    return F.md5(F.coalesce(column.cast("string"), F.lit("")))


def _numbered(rows, per_bucket):
    """Adds each document's place in its source, by the order of the md5 of its id: sums over buckets of that order, then
    within a bucket, so that a large source is dealt to many tasks."""
    buckets = max(1, -(-rows.count() // per_bucket))
    hashed = rows.withColumn("hash", _hash(F.col("id")))
    hashed = hashed.withColumn("bucket", F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * buckets, 32))
    key = ["source", "none", "bucket"]
    sums = hashed.groupBy(*key).agg(F.sum("chars").alias("sum"))
    # one row a source and bucket
    before = F.sum("sum").over(Window.partitionBy("source", "none").orderBy("bucket")) - F.col("sum")
    base = sums.select(*key, before.alias("base"))
    within = Window.partitionBy(*key).orderBy("hash", "chars").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("within", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    return placed.join(base, key).withColumn("place", F.col("base") + F.col("within")).drop("bucket", "base", "within")


def square_root_weights(chars, scale=100):
    """Whole weights in proportion to the square roots of the sources' sizes: large sources are held back, small ones raised."""
    roots = {s: max(n, 1) ** 0.5 for s, n in chars.items()}
    total = sum(roots.values()) or 1
    return {s: max(1, round(scale * r / total)) for s, r in roots.items()}


def mix(df, weights=square_root_weights, block_chars=20_000, per_bucket=50_000, size=None, ordered=False):
    """The rows of ``df`` (doc_id, source, text, ...) with ``block`` (in its source), ``slot`` of the block and ``place``
    in the source, in characters; order by slot, place for the mixture. ``weights``: whole numbers by source, or a
    function of the sources' sizes in characters. ``size``: a document's size, its characters if not given. ``ordered``: the
    rows come partitioned and sorted as the mixture has them."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("block", "slot", "place")]
    chars = F.coalesce(F.length("text") if size is None else size, F.lit(0)).cast("long").alias("chars")
    named = [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("source").isNull().alias("none"), chars]
    sizes = df.select(*named).groupBy("source", "none").agg(F.sum("chars").alias("chars")).collect()  # a row a source
    totals = {(r["source"], r["none"]): int(r["chars"]) for r in sizes}
    given = weights(totals) if callable(weights) else {k: weights.get(None if k[1] else k[0], 1) for k in totals}
    blocks = {s: max(1, -(-n // block_chars)) for s, n in totals.items()}
    rows = []
    for phase, (first, live, order, had) in enumerate(phases({s: max(1, int(given.get(s, 1))) for s in totals}, blocks)):
        seen = {}
        for slot, s in enumerate(order):
            seen[s] = seen.get(s, -1) + 1
            rows.append((*s, phase, had[s], live[s], len(order), first, seen[s], slot))
    table = spark.createDataFrame(rows, "source string, none boolean, phase int, had long, weight int, period int, first long, nth int, at int")
    spans = table.select("source", "none", "phase", "had", "weight", "period", "first").distinct()
    until = F.lead("had", 1, 1 << 62).over(Window.partitionBy("source", "none").orderBy("phase"))
    spans = F.broadcast(spans.withColumn("until", until)).alias("s")  # a row a source and phase: at most the square of the sources
    slots = F.broadcast(table.select("source", "none", "phase", "nth", "at"))  # at most sources x W rows for each phase

    def dated(placed):
        inside = F.expr("p.source = s.source and p.none = s.none and p.block >= s.had and p.block < s.until")
        placed = placed.withColumn("block", (F.col("place") / block_chars).cast("long")).alias("p")
        found = placed.join(spans, inside).select("p.*", "s.phase", "s.had", "s.weight", "s.period", "s.first")
        found = found.withColumn("nth", ((F.col("block") - F.col("had")) % F.col("weight")).cast("int"))
        slot = F.col("first") + F.floor((F.col("block") - F.col("had")) / F.col("weight")) * F.col("period") + F.col("at")
        found = found.join(slots, ["source", "none", "phase", "nth"]).withColumn("slot", slot)
        return found.drop("phase", "nth", "had", "weight", "period", "first", "at")

    narrow = df.select(F.col("doc_id").alias("id"), *named)
    whole = df.select(F.struct(*kept).alias("row"), F.col("doc_id").alias("id"), *named)
    if ordered:
        parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, sum(blocks.values()))
        out = _in_parts(whole, dated(_numbered(narrow, per_bucket)), parts, total)
        out = dated(out).sortWithinPartitions("slot", "place", "id")
    else:
        out = dated(_numbered(whole, per_bucket))
    return out.select("row.*", "block", "slot", "place")


def _in_parts(whole, dated, parts, total):
    """The rows of ``whole`` in ``parts`` tasks by stretches of slots, with their places, given the slots of their ids."""
    source = ["source", "none"]
    order = F.struct("hash", "chars")
    part = F.least(F.floor(F.col("slot") * parts / total), F.lit(parts - 1)).cast("int")
    narrow = materialize(dated.select(*source, "hash", "chars", "place", part.alias("part")))
    firsts = narrow.groupBy(*source, "part").agg(F.min(order).alias("first"))
    # at most sources x parts rows, in order of the parts; rows alike that stand on a bound go to the later part together
    bounds = F.broadcast(firsts.groupBy(*source).agg(F.sort_array(F.collect_list(F.struct("first", "part"))).alias("bounds")))
    of_row = F.element_at(F.filter("bounds", lambda b: b["first"] <= order), -1)["part"]
    narrow = narrow.drop("part").join(bounds, source).withColumn("part", of_row)
    base = F.broadcast(narrow.groupBy(*source, "part").agg(F.min("place").alias("base")))
    moved = whole.withColumn("hash", _hash(F.col("id"))).join(bounds, source).withColumn("part", of_row).drop("bounds")
    moved = moved.repartitionById(parts, "part")
    within = Window.partitionBy("part", *source).orderBy("hash", "chars").rowsBetween(Window.unboundedPreceding, -1)
    placed = moved.withColumn("within", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    return placed.join(base, [*source, "part"]).withColumn("place", F.col("base") + F.col("within"))


def mixture(docs, **options):
    """Per document: doc_id, source, block, slot, place."""
    narrow = docs.select("doc_id", "source", F.length("text").alias("size"))
    return mix(narrow, size=F.col("size"), **options).select("doc_id", "source", "block", "slot", "place")


#: The mixture slot by slot: the state of all sources is a list, and a step gives a slot to the released block due first.
ORACLE = """WITH RECURSIVE d AS (SELECT doc_id, source, length(text) AS chars, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
    b AS (SELECT doc_id, source, CAST(coalesce(sum(chars) OVER (PARTITION BY source ORDER BY h, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM d),
    z AS (SELECT source, CAST(sum(chars) AS BIGINT) AS n FROM d GROUP BY 1),
    w AS (SELECT source, greatest(1, CAST(round(100 * sqrt(greatest(n, 1)) / (SELECT sum(sqrt(greatest(n, 1))) FROM z)) AS BIGINT)) AS w,
        greatest(1, (n + 19999) // 20000) AS l FROM z),
    sim AS (SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t, CAST((SELECT sum(w) FROM w) AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS s,
        (SELECT list({'s': source, 'w': w, 'h': CAST(0 AS BIGINT), 'l': l}) FROM w) AS st
    UNION ALL
    SELECT slot + 1, CASE WHEN gone THEN 0 ELSE t + 1 END, CASE WHEN gone THEN CAST(list_sum(list_transform(list_filter(nx, lambda x: x.l > 0), lambda x: x.w)) AS BIGINT) ELSE total END, s2,
        CASE WHEN gone THEN list_transform(nx, lambda x: {'s': x.s, 'w': x.w, 'h': CAST(0 AS BIGINT), 'l': x.l}) ELSE nx END
    FROM (SELECT *, len(list_filter(nx, lambda x: x.s = s2 AND x.l = 0)) > 0 AS gone FROM (
        SELECT *, list_transform(st, lambda x: {'s': x.s, 'w': x.w, 'h': CASE WHEN x.s = s2 THEN x.h + 1 ELSE x.h END, 'l': CASE WHEN x.s = s2 THEN x.l - 1 ELSE x.l END}) AS nx FROM (
        SELECT *, list_sort(list_transform(list_filter(st, lambda x: x.l > 0 AND x.h * total // x.w <= t), lambda x: {'due': ((x.h + 1) * total + x.w - 1) // x.w, 's': x.s}))[1].s AS s2
        FROM sim WHERE total > 0)))),
    q AS (SELECT s, slot, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS block FROM sim WHERE s IS NOT NULL)
    SELECT doc_id, source, b.place // 20000 AS block, slot, place FROM b JOIN q ON q.s = source AND q.block = b.place // 20000"""
