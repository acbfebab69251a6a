"""Near copies by a parity-sketch join on word shingles, and the groups their links make.

A document is the set of its shingles (64-bit hashes of runs of words; a pair of sets would need more than a hundred million
shingles for a likely wrong match), and a node is a distinct set, named by a 64-bit hash of it, so that copies send their keys
once a task and count once in the search. For a size band with largest size m, two
linked sets differ in at most D = 2 m (1 - t) / (1 + t) shingles. A sketch of S > D segments of 64 bits takes each shingle to one bit by
its hash and toggles it, so the Hamming distance of two sketches never exceeds the symmetric difference, and linked sets
agree on at least S - D whole segments: the join is on (band, segment, value). Sets go to their own band and to those
above in which they can be the smaller partner.

Segments of few bits are shared by chance. As S exceeds D + 1 by a margin, a set with more than D segments of at least ``rich`` bits has,
for each partner, such a segment among those they agree on, so it sends only these; any other set sends all.

A caller who bears a small chance of a miss (``miss``, for a pair at the very threshold) gets by with less: differences fall on
segments by hashes, so rich ones alone are sent, out of up to ``COPIES`` sketches by hashes of their own, which lets a small set have
segments as rich as those of a large one, and a linked pair shares at least ``need`` keys, by Chernoff's bound. Pairs of short runs that share less than half of that are dropped, as are the places in longer runs of
sets that have less than half of it there. Sizes for which no such bound holds are searched as above.

Rows that share a key come sorted past one task each, in a stream: runs of up to ``SMALL`` sets become pairs there, and
only longer runs are kept as groups. With ``miss``, runs of more than ``FEW`` are long already, so that a group sends at most three pairs
for two of its keys, and each set also makes a pair with up to ``NEAREST`` of the least ones of its longer runs. Pairs are pruned by a short sketch of fixed length and by
their sketches, and the rest verified on whole sets. Longer runs that these links leave apart are compared in square blocks of bounded size on their short sketches; of what could be links only a spanning
forest goes on to be verified, and rounds follow until each pair of a group is known to be apart or joined by verified
links. So all links count for the groups, and no group's pairs are written out.

Documents without words or text stand alone, as do those without an id; texts that share an id are grouped each by its own.
No rows give no rows. Columns other than doc_id and text do not take part.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..session import materialize
from .text import batch, mix, shingle_hashes, text_column, word_hasher

BAND = 1.3
SMALL = 16
FEW = 4  # the same with ``miss``
NEAREST = 4  # of the least nodes of a set's longer runs, that it makes a pair with at once
BLOCK = 4096
FOLD = 512  # bits of the short sketch
WIDE = 4  # bits a shingle, at least, of the wide one
COPIES = 6  # sketches a set has in a band, at most
FORESTS = 16  # of the pairs left open in a block of a run, that are verified in one round


def _schema(**kinds):
    return StructType([StructField(c, k()) for c, k in kinds.items()])


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def shingle_set(text, hasher, words):
    """Sorted distinct shingle hashes of a text; only A-Z are lower-cased."""
    return np.unique(shingle_hashes(hasher((text or b"").lower().split()), words))


def _at_least(k, rate):
    """Chance of at least k events at a Poisson rate."""
    return 1 - math.exp(-rate) * sum(rate ** i / math.factorial(i) for i in range(k))


class Bands:
    """Size bands and their sketches for links of at least ``percent`` per cent."""

    def __init__(self, percent, miss=0.0):
        self.percent, self.miss = percent, miss
        self.plan = lru_cache(None)(self._plan)
        self.need = lru_cache(None)(self._need)
        self.seeds = lru_cache(None)(self._seeds)

    def most_apart(self, a, b):
        """Largest symmetric difference of two linked sets of sizes a and b."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def of(n):
        return int(math.log(n) / math.log(BAND) + 1e-9)

    @staticmethod
    def least(band):
        """Smallest size of a band."""
        n = max(1, math.floor(BAND ** band) - 1)
        while Bands.of(n) < band:
            n += 1
        return n

    def bands(self, n):
        """The own band of a size and those above with partners for it."""
        return range(self.of(n), self.of(max(n, 100 * n // self.percent)) + 1)

    def _plan(self, band):
        """D, number of segments, least bits of a rich segment, how many rich ones a set has at least to send only these (0: it
        always does, since then a linked pair shares a rich one but for the chance ``miss``), and number of sketches."""
        low, high = self.least(band), self.least(band + 1) - 1
        apart = self.most_apart(high, high)
        if apart == 0:
            return 0, 0, 0, 0, 1
        if self.miss:
            tried = sorted({max(2, round(apart * 2 ** (i / 16))) for i in range(-48, 33)})  # an eighth to four times D
            for rich in (4, 3, 2):
                enough = [(copies * segments * _at_least(rich, low / segments), segments, copies) for copies in range(1, COPIES + 1) for segments in tried
                          if (1 - self._chance(low, apart, segments, rich)) ** (copies * segments) <= self.miss]
                if enough:  # the one that sends the fewest keys
                    _, segments, copies = min(enough)
                    return apart, segments, rich, 0, copies
        for rich in (4, 3, 2):
            for spare in range(1, apart // 3 + 2):
                segments = apart + 1 + spare
                poor = segments * (1 - _at_least(rich, low / segments))
                if poor + 2 * math.sqrt(poor) <= spare:
                    return apart, segments, rich, apart + 1, 1
        return apart, apart + 2, 1, apart + 1, 1

    def _chance(self, low, apart, segments, rich):
        """That a segment of a linked pair is rich and free of all differences; what they share is at least the least size's share."""
        return (1 - 1 / segments) ** apart * _at_least(rich, self.percent * low / 100 / segments)

    def _need(self, band):
        """Keys that a linked pair of a band shares but for the chance ``miss``, by Chernoff's bound; hits of differences on
        segments hold each other back, so that the bound for independent ones holds."""
        apart, segments, rich, least, copies = self.plan(band)
        if not segments or least:
            return 1
        chance, shared = self._chance(self.least(band), apart, segments, rich), 0
        segments *= copies
        while True:
            x = shared / segments
            far = (x * math.log(x / chance) if x else 0) + (1 - x) * math.log((1 - x) / (1 - chance))
            if x >= chance or math.exp(-segments * far) > self.miss:
                return max(1, shared)
            shared += 1

    @staticmethod
    def _seeds(band, copies):
        return np.array([[(band + (c << 32)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1] for c in range(copies)], np.uint64)

    def sketch(self, shingles, band):
        """Segments of a set's sketch, or of its sketches one after the other, 64 bits each."""
        _, segments, _, _, copies = self.plan(band)
        if not segments:  # sets of such sizes link only when equal
            return np.empty(0, "<u8")
        place = mix(shingles ^ self.seeds(band, copies)) % np.uint64(64 * segments) + np.arange(copies, dtype=np.uint64)[:, None] * np.uint64(64 * segments)
        bits = (np.bincount(place.ravel().astype(np.int64), minlength=64 * segments * copies) & 1).astype(np.uint8)
        return np.packbits(bits, bitorder="little").view("<u8")

    def keys(self, shingles):
        """Join keys of a set: a hash of band, segment and value for each segment sent."""
        out = []
        for band in self.bands(len(shingles)):
            _, segments, rich, least, _ = self.plan(band)
            if segments:
                s = self.sketch(shingles, band)
                where = np.flatnonzero(np.bitwise_count(s) >= rich)
                if len(where) < least:
                    where = np.arange(len(s))
                with np.errstate(over="ignore"):
                    out.append(mix(mix(s[where] + np.uint64(band << 32)) + where.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _node(shingles):
    """The name of a set: a hash of its sorted shingles."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sets(batches, words):
    """Per slice of a batch: its part and the parts' sets."""
    hasher = word_hasher()
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            yield part, [shingle_set(t, hasher, words) for t in part.column("text").to_pylist()]


def _fold(shingles, size=FOLD):
    """A parity sketch of a power of two of bits, for sets of any size; the halves of a longer one add up to it."""
    bits = np.bincount((mix(shingles) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _wide(shingles):
    return _fold(shingles, max(FOLD, 1 << (WIDE * len(shingles) - 1).bit_length()) if len(shingles) else FOLD)


def _shorter(folds, words):
    """Folds, one a row, cut to some 64-bit words by adding up their parts."""
    return np.bitwise_xor.reduce(folds.reshape(len(folds), -1, words), axis=1)


def _signatures(df, words):
    """Per row: doc_id, a hash of the text, size of the set, its node and its short sketch."""
    schema = _schema(doc_id=LongType, text_hash=LongType, n_shingles=LongType, node=LongType, fold=BinaryType, wide=BinaryType)

    def run(batches):
        out = _arrow(schema)
        for part, sets in _sets(batches, words):
            yield batch(out, doc_id=part.column("doc_id"), text_hash=part.column("text_hash"), n_shingles=[len(s) for s in sets], node=[_node(s) for s in sets],
                        fold=[_fold(s) for s in sets], wide=[_wide(s) for s in sets])
    return df.mapInArrow(run, schema)


def _keys(docs, words, percent, miss=0.0):
    """Rows (key, node, size) of the distinct sets of each task's slices."""
    schema = _schema(key=LongType, node=LongType, size=IntegerType)

    def run(batches):
        out, bands = _arrow(schema), Bands(percent, miss)
        for _, sets in _sets(batches, words):
            once = {_node(s): s for s in sets if len(s)}
            keys = [bands.keys(s) for s in once.values()]
            sent = [len(k) for k in keys]
            if sum(sent):
                yield batch(out, key=np.concatenate(keys).view(np.int64), node=np.repeat(np.array(list(once)), sent),
                            size=np.repeat(np.array([len(s) for s in once.values()], np.int32), sent))
    return docs.mapInArrow(run, schema)


def _runs(keys, percent, miss=0.0):
    """Runs of equal keys: pairs (a < b, key null) of short ones that sizes allow, with the keys shared so far, and members b of
    longer ones, with the least node a of the run (shared null); ``need`` is what they have to share in all."""
    schema = _schema(key=LongType, a=LongType, na=IntegerType, b=LongType, nb=IntegerType, shared=IntegerType, need=IntegerType)

    def run(batches):
        out, bands, small = _arrow(schema), Bands(percent, miss), min(SMALL, FEW) if miss else SMALL
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        long_key = centre = None

        def needs(sizes, least):
            each, at = np.unique(sizes, return_inverse=True)
            return np.array([min(map(bands.need, bands.bands(int(n)))) if least else bands.need(bands.of(int(n))) for n in each], np.int32)[at]

        def results(key, node, size):
            nonlocal long_key, centre
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            of = np.repeat(np.arange(len(start)), length)
            is_long = (length > small)[of]
            if long_key is not None and len(key):
                is_long |= key == long_key
            cols = [[], [], [], [], []]
            for step in range(1, small):
                i = np.flatnonzero((of[step:] == of[:-step]) & ~is_long[step:]) if len(key) > step else []
                if not len(i):
                    break
                j = i + step
                x, y = np.minimum(size[i], size[j]).astype(np.int64), np.maximum(size[i], size[j])
                fits = (100 * x >= percent * y) & (node[i] != node[j])
                i, j = i[fits], j[fits]
                for c, v in zip(cols, (None, node[i], size[i], node[j], size[j])):
                    c.append(v)
            if any(map(len, cols[1])):
                a, na, b, nb = (np.concatenate(c) for c in cols[1:])
                order = np.lexsort((b, a))
                a, na, b, nb = a[order], na[order], b[order], nb[order]
                once = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                shared = np.diff(np.r_[once, len(a)]).astype(np.int32)
                a, na, b, nb = a[once], na[once], b[once], nb[once]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(once), pa.int64()), *map(pa.array, (a, na, b, nb, shared, needs(np.maximum(na, nb), False)))], schema=out)
            m = np.flatnonzero(is_long)
            if len(m):
                first, first_size = node[start[of[m]]], size[start[of[m]]]
                if long_key is not None:
                    first[key[m] == long_key], first_size[key[m] == long_key] = centre
                yield pa.RecordBatch.from_arrays([pa.array(key[m]), pa.array(first), pa.array(first_size), pa.array(node[m]), pa.array(size[m]),
                                                  pa.nulls(len(m), pa.int32()), pa.array(needs(size[m], True))], schema=out)
                long_key, centre = key[m[-1]], (first[-1], first_size[-1])
        for b in batches:
            got = [np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("key", "node", "size"))]
            key, node, _ = got
            if not len(key):
                continue
            once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]  # copies sent by several tasks
            got = [g[once] for g in got]
            key = got[0]
            last = int(np.searchsorted(key, key[-1], "left"))  # the run at the end may go on
            if len(key) - last > small:
                yield from results(*got)
                held = [g[:0] for g in got]
            else:
                yield from results(*(g[:last] for g in got))
                held = [g[last:] for g in got]
        yield from results(*held)
    parts = keys.repartition("key").sortWithinPartitions("key", "node")
    return parts.mapInArrow(run, schema)


def _described(docs, words, percent):
    """Per node: its size, its sketches of all its bands, one after the other, and its shingles."""
    schema = _schema(node=LongType, size=IntegerType, sketch=BinaryType, shingles=BinaryType)

    def run(batches):
        out, bands = _arrow(schema), Bands(percent)
        for _, sets in _sets(batches, words):
            yield batch(out, node=[_node(s) for s in sets], size=[len(s) for s in sets], shingles=[s.tobytes() for s in sets],
                        sketch=[b"".join(bands.sketch(s, k).tobytes() for k in bands.bands(len(s))) if len(s) else b"" for s in sets])
    return docs.mapInArrow(run, schema)


def _part(bands, sketch, size, band):
    """The sketch of one band out of a document's."""
    at = 8 * sum(bands.plan(k)[1] for k in range(bands.of(size), band))
    return np.frombuffer(sketch, "<u8", bands.plan(band)[1], at)


def _close(pairs, sketches, percent, column, distance):
    """Pairs whose sketches leave the link open: ``distance`` of the two bounds the symmetric difference from below."""
    schema = _schema(a=LongType, na=IntegerType, b=LongType, nb=IntegerType)
    one = sketches.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col(column).alias("sa"))
    two = sketches.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col(column).alias("sb"))

    def run(batches):
        out, bands = _arrow(schema), Bands(percent)
        for batch_ in batches:
            rows = zip(*(batch_.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))
            mask = pa.array([distance(bands, na, nb, sa, sb) <= bands.most_apart(na, nb) for na, nb, sa, sb in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch_.column(c).filter(mask) for c in ("a", "na", "b", "nb")], schema=out)
    return pairs.join(one, ["a", "na"]).join(two, ["b", "nb"]).select("a", "na", "b", "nb", "sa", "sb").mapInArrow(run, schema)


def _of_folds(bands, na, nb, sa, sb):
    return (int.from_bytes(sa, "little") ^ int.from_bytes(sb, "little")).bit_count()


def _of_sketches(bands, na, nb, sa, sb):
    band = bands.of(max(na, nb))
    return int(np.bitwise_count(_part(bands, sa, na, band) ^ _part(bands, sb, nb, band)).sum())


def _verified(pairs, described, percent):
    """Pairs with whether they link, from their whole sets. A written table."""
    schema = _schema(a=LongType, b=LongType, link=IntegerType)
    ends = _ends(pairs)
    sets = materialize(described.select("node", "shingles").join(ends, "node", "left_semi"))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        out = _arrow(schema)
        for b in batches:
            link = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(x) + len(y) - len(np.union1d(x, y))
                link.append(int(100 * both >= percent * (len(x) + len(y) - both)))
            yield batch(out, a=b.column("a"), b=b.column("b"), link=link)
    return materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, schema))


def _ends(pairs):
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def components(edges):
    """Smallest reachable node of each node that has an edge, by large-star and small-star rounds.

    Each round hangs a node's larger neighbours on its smallest and then all on it, until nothing moves: a few rounds
    of two groupings each, over at most as many rows as edges."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        step = materialize(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        sums = step.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sums == before:
            return step.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges, before = step, sums


def _joined(labels, links):
    """Labels after more links, which hang whole components on one another."""
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("component").alias("c" + end))
        links = links.join(of, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    moved = materialize(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(kept.unionByName(moved))


def _forest(members, folds, labels, failed, crowded, percent):
    """For members (node, size, keys) of long runs: up to ``FORESTS`` spanning forests, per pair of blocks of a run, of the pairs of
    different components that short sketches leave open, without those that failed. Each forest takes what those before it leave
    over, so that pairs that fail on their whole sets have others in their place. Joins are by node; keys come after them."""
    schema = _schema(a=LongType, b=LongType)
    placed = members.join(folds.drop("fold"), ["node", "size"]).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bad = failed.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("bad"))
    placed = placed.join(bad, "node", "left")
    dealt = placed.select(F.explode("keys").alias("key"), "node", "size", "component", "wide", "bad")
    if crowded is None:
        dealt = dealt.select("*", F.lit(0).alias("own"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        dealt = dealt.join(crowded, "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "component", "wide", "bad")

    def run(key, table):
        _, i, j = (k.as_py() for k in key)
        order = np.argsort(table.column("size").to_numpy(), kind="stable")
        node, size, own, comp = (table.column(c).to_numpy()[order] for c in ("node", "size", "own", "component"))
        if (comp == comp[0]).all():
            return _arrow(schema).empty_table()
        size = size.astype(np.int64)
        raw = [np.frombuffer(f, "<u8") for f in table.column("wide").to_pylist()]
        raw = [raw[x] for x in order.tolist()]
        width = np.array([len(f) for f in raw])
        folds = {w: np.stack([_shorter(f[None, :], w)[0] for f in raw if len(f) >= w]) for w in np.unique(width).tolist()}  # widths rise with sizes
        skip = {int(n): set(b) for n, b in zip(table.column("node").to_pylist(), table.column("bad").to_pylist()) if b}
        forests, found = [{} for _ in range(FORESTS)], []

        def find(root, x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        for x in range(1, len(node)):  # each with the smaller ones that its size allows
            first = int(np.searchsorted(size, -(-percent * size[x] // 100), "left"))
            w = int(width[first])
            fold = folds[w][first - int(np.searchsorted(width, w)):]
            apart = np.bitwise_count(fold[:x - first] ^ fold[x - first]).sum(axis=1, dtype=np.int64)
            ok = (apart <= (size[first:x] + size[x]) * (100 - percent) // (100 + percent)) & (comp[first:x] != comp[x])
            if i != j:
                ok &= own[first:x] != own[x]
            for y in (first + np.flatnonzero(ok)).tolist():
                a, b = sorted((int(node[x]), int(node[y])))
                if b not in skip.get(a, ()):
                    for root in forests:
                        p, q = find(root, int(comp[x])), find(root, int(comp[y]))
                        if p != q:
                            root[p] = q
                            found.append((a, b))
                            break
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})
    return dealt.groupBy("key", "i", "j").applyInArrow(run, schema).distinct()


def _stars(runs):
    """The members b of longer runs by the least node a, with the keys of the runs they share. A written table."""
    stars = runs.where("shared is null").groupBy("a", "b")
    return materialize(stars.agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("need").alias("need"), F.collect_set("key").alias("keys")))


def _nearest(stars, percent):
    """Pairs of each member of longer runs with the few least nodes that it shares most of these with, of those its size allows: at most
    ``NEAREST`` a node, however long its runs. What they leave apart is compared in blocks."""
    fits = stars.where("a <> b").where(100 * F.least("na", "nb").cast("long") >= percent * F.greatest("na", "nb").cast("long"))
    order = F.row_number().over(Window.partitionBy("b", "nb").orderBy(F.size("keys").desc(), "a", "na"))
    return fits.withColumn("order", order).where(F.col("order") <= NEAREST).select("a", "na", "b", "nb")


def _open_stars(stars, labels):
    """The stars in which not all are of one component with the least node. Most close with their links, and none of their rows goes on."""
    open_ = stars.where("a <> b").select("a", "b")
    for end in ("a", "b"):
        open_ = open_.join(labels.select(F.col("node").alias(end), F.col("component").alias("c" + end)), end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    return stars.join(open_.where("ca <> cb").select("a").distinct(), "a", "left_semi")


def _members(stars):
    """Members (node, size, keys) of longer runs, one row each, without those that are in too few of them for a link. A written table."""
    members = stars.groupBy(F.col("b").alias("node"), F.col("nb").alias("size")).agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), F.first("need").alias("need"))
    return materialize(members.where(2 * F.size("keys") > F.col("need") - F.col("need") % 2).drop("need"))


def _crowded(members):
    """The keys of runs with more than ``BLOCK`` members and the number of blocks they make; None if there are none."""
    n = members.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    crowded = materialize(n.where("k > 1"))
    return None if crowded.isEmpty() else crowded


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def groups(df, words=3, percent=90, miss=0.0):
    """Per row: doc_id, text_hash, n_shingles, component_id (smallest id reachable by links) and root, the name of its group."""
    docs = text_column(df, F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"))
    sig = materialize(_signatures(docs, words))
    named = docs.where("doc_id is not null and text is not null")
    runs = materialize(_runs(_keys(named, words, percent, miss), percent, miss))
    pairs = runs.where("shared is not null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("shared").alias("shared"), F.first("need").alias("need"))
    pairs = pairs.where("2 * shared >= need").select("a", "na", "b", "nb")
    folds = materialize(sig.select("node", F.col("n_shingles").cast("int").alias("size"), "fold", "wide").dropDuplicates(["node", "size"]))
    stars = _stars(runs)
    if miss:  # with all segments sent, as without ``miss``, most stars would be of sets that are apart
        pairs = pairs.unionByName(_nearest(stars, percent)).distinct()
    pairs = materialize(_close(pairs, folds.drop("wide"), percent, "fold", _of_folds))

    def fetch(ends, *hint):
        """Sets and sketches of some nodes: the text of one document of each."""
        ends = materialize(ends)
        some = sig.where("doc_id is not null").join(ends, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
        some = materialize(some)
        found = _described(named.join(some.hint(*hint) if hint else some, "doc_id", "left_semi"), words, percent)
        return materialize(found.join(ends, "node", "left_semi").dropDuplicates(["node", "size"]))

    # a sorted join whatever the size, so that the plan is the same at all
    described = fetch(_ends(pairs), "merge")
    pairs = materialize(_close(pairs, described.select("node", "size", "sketch"), percent, "sketch", _of_sketches))
    checked = _verified(pairs, described, percent)
    labels = materialize(components(checked.where("link = 1")))
    failed = checked.where("link = 0")
    members = _members(_open_stars(stars, labels) if miss else stars)
    crowded = _crowded(members)
    while True:
        more = materialize(_forest(members, folds, labels, failed, crowded, percent))
        if more.isEmpty():
            break
        new = _verified(more, fetch(_ends(more)), percent)
        failed = materialize(failed.unionByName(new.where("link = 0")))
        labels = _joined(labels, new.where("link = 1"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    # ids are settled per node, and only for nodes with copies or links, so that copies meet in one join
    nodes = sig.where(~alone).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    linked = labels.unionByName(labels.select(F.col("component").alias("node"), "component")).distinct()
    placed = materialize(nodes.join(linked, "node", "left").where("copies > 1 or component is not null"))
    whole = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("group"))
    named = placed.join(whole, "component", "left").select("node", F.coalesce("group", "least").alias("group"), F.coalesce("component", "node").alias("root"))
    out = sig.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("group", "doc_id")).alias("component_id"),
                      F.when(~alone, F.coalesce("root", "node")).alias("root"))


def linked_documents(df, words=3, percent=90):
    """Per document: doc_id, n_shingles, component_id."""
    return groups(df, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(df, words=5, percent=80, miss=1e-9):
    """The rows of ``df`` without all but one of each group of linked documents, that of smallest id; where a group's smallest id
    comes with several texts, one of them, and of rows that agree in id and text, one. Texts that do not link stay, whatever their ids, as
    do rows without an id and documents without words (of those that agree in id and text, one)."""
    found = materialize(groups(df, words, percent, miss).where("doc_id is not null").select("doc_id", "text_hash", "root"))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = found.join(first, "root").where(F.struct("doc_id", "text_hash") != F.col("first")).select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct()
    own, text = F.col("doc_id").cast("long"), _text_hash()
    kept = df.join(gone, (own == gone["gone"]) & (text == gone["gone_text"]), "left_anti")  # ids alone; Spark broadcasts them where their size allows
    often = found.groupBy(F.col("doc_id").alias("often"), F.col("text_hash").alias("often_text")).count().where("count > 1").select("often", "often_text")
    often = materialize(often)
    if often.isEmpty():
        return kept
    same = (own == often["often"]) & (text == often["often_text"])
    several = kept.join(often, same, "left_semi")
    once = several.groupBy(own, text).agg(F.first(F.struct(*df.columns)).alias("row"))
    return kept.join(often, same, "left_anti").unionByName(once.select("row.*"))
