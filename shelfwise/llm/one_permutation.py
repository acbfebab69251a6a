"""Near copies by one-permutation hashing, bands and stars.

A document is the set of its shingles' 64-bit hashes, and a node is a distinct set, named by a hash of it. One hash function serves all positions of
a signature: its range is cut into bins, and a bin's value is the least hash in it. Empty bins are filled by optimal densification: each tries other
bins in a fixed random order of its own until it meets one that is not empty, so that two signatures agree at a bin with the chance of their sets'
similarity, however few shingles there are. Runs of ``rows`` bins make a band, and a band's key a bucket; the numbers follow from the threshold, such
that a linked pair shares no bucket with a chance of ``miss`` at most (a pair above the threshold with less).

A bucket sends one candidate a member, to its least node, so that candidates grow with the members and not with their pairs. Candidates whose whole
signatures leave a link open (six standard deviations below the threshold, sets of less than 64 shingles always) are verified on whole sets.
What a star cannot see are links between two members that do not link with the centre. Where members of a bucket are still apart after that, those
outside its largest component meet all members in blocks of bounded size, and only the links found there, a forest, leave a block; buckets of the
same members do so once. So all links between members of a bucket count, and no bucket's pairs are written out. The work of that last step follows
the number of members that are apart times the bucket's size.

Documents without words or text stand alone, as do those without an id (component_id null, kept). Rows that share an id count each by its own text
and are kept if their id is the least of the group. No rows give none. Columns other than doc_id and text do not take part.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..session import materialize
from .parity_join import components
from .text import Memo, batch, mix, shingle_hashes, text_column, word_hasher

MOST_BANDS = 48
BLOCK = 1024
SMALL_SET = 64


@lru_cache(maxsize=None)
def plan(percent, miss=1e-6):
    """(bands, rows): as many rows as ``MOST_BANDS`` bands allow for the chance ``miss`` at the threshold."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(percent / 100) ** rows)) if percent < 100 else 1
        if bands <= MOST_BANDS:
            return bands, rows
    return bands, rows


@lru_cache(maxsize=4)
def _bin_edges(bins):
    return np.array([-(-(i << 64) // bins) for i in range(bins)], np.uint64)


@lru_cache(maxsize=256)
def _tries(bins, attempt):
    """For each bin, the other it looks at in some attempt."""
    return (mix(np.arange(bins, dtype=np.uint64) + np.uint64((attempt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(bins)).astype(np.int64)


def signatures(sets, bins):
    """Densified one-permutation signatures of sorted sets that are not empty, one a row."""
    edges, values, full = _bin_edges(bins), np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges, "left")
        end = np.r_[at[1:], len(s)]
        full[i] = at < end
        values[i] = s[np.minimum(at, len(s) - 1)]
    row, empty = np.nonzero(~full)
    attempt = 0
    while len(row):
        other = _tries(bins, attempt)[empty]
        hit = full[row, other]
        values[row[hit], empty[hit]] = values[row[hit], other[hit]]
        row, empty, attempt = row[~hit], empty[~hit], attempt + 1
    return values


def band_keys(values, bands, rows):
    """A hash of each band of signatures."""
    cut = values.reshape(len(values), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(values), 1))
    for r in range(rows):
        with np.errstate(over="ignore"):
            key = mix(key + cut[:, :, r])
    return key


def shingle_sets(texts, words):
    """Sorted distinct shingle hashes of texts; only A-Z are lower-cased."""
    hasher = word_hasher()
    return [np.unique(shingle_hashes(hasher((t or b"").lower().split()), words)) for t in texts]


def _name(s):
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def linked(x, y, percent):
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def least_agreeing(bins, percent):
    """Bins in which signatures of a linked pair agree at least, six standard deviations below the threshold."""
    t = percent / 100
    return bins * t - 6 * math.sqrt(bins * t * (1 - t))


def _signed(docs, words, percent, miss):
    """Per row doc_id, n_shingles and node; signature and keys once a node and task, where the set can link with another."""
    schema = StructType([StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("node", LongType()),
                         StructField("sig", BinaryType()), StructField("keys", ArrayType(LongType()))])
    bands, rows = plan(percent, miss)

    def run(batches):
        out, seen = to_arrow_schema(schema), Memo(lambda node: True)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids, sets = part.column("doc_id").to_pylist(), shingle_sets(part.column("text").to_pylist(), words)
                nodes, sig, keys, new = [_name(s) for s in sets], [None] * len(sets), [None] * len(sets), []
                for k, s in enumerate(sets):
                    if ids[k] is not None and 100 * len(s) >= percent * (len(s) + 1) and nodes[k] not in seen:
                        seen[nodes[k]]
                        new.append(k)
                if new:
                    values = signatures([sets[k] for k in new], bands * rows)
                    short = (mix(values) & np.uint64(255)).astype(np.uint8)
                    for k, s, key in zip(new, short, band_keys(values, bands, rows).view(np.int64)):
                        sig[k], keys[k] = s.tobytes(), key
                yield batch(out, doc_id=part.column("doc_id"), n_shingles=[len(s) for s in sets], node=nodes, sig=sig, keys=keys)
    return docs.mapInArrow(run, schema)


def _sets_of(docs, words):
    schema = StructType([StructField("node", LongType()), StructField("shingles", BinaryType())])

    def run(batches):
        out = to_arrow_schema(schema)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                sets = shingle_sets(b.column("text").slice(i, 512).to_pylist(), words)
                yield batch(out, node=[_name(s) for s in sets], shingles=[s.tobytes() for s in sets])
    return docs.mapInArrow(run, schema)


def _open(pairs, nodes, percent):
    """Pairs whose sizes and signatures leave a link open."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def run(batches):
        for t in (b for b in batches if b.num_rows):
            na, nb = (t.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            sa, sb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in ("sa", "sb"))
            small, large = np.minimum(na, nb), np.maximum(na, nb)
            ok = (100 * small >= percent * large) & ((small < SMALL_SET) | ((sa == sb).sum(axis=1) >= least_agreeing(sa.shape[1], percent)))
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(ok)) for c in ("a", "b")], schema=to_arrow_schema(schema))
    both = pairs.join(nodes.toDF("a", "na", "sa"), "a").join(nodes.toDF("b", "nb", "sb"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, schema)


def _verified(pairs, sets, percent):
    """Pairs that link, by their whole sets."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def run(batches):
        for t in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(t.column("sa"), t.column("sb"))]
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], schema=to_arrow_schema(schema))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, schema)


def _apart(buckets, labels):
    """Members (key, node, component, main) of buckets in which members other than the centre are still apart; of buckets with the
    same members one."""
    placed = buckets.select("key", "node", "center").distinct().join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") != F.col("center")).alias("others"),
                                                   F.bit_xor(F.xxhash64("node")).alias("members"))
    state = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.bit_xor("members").alias("members"), F.sum(F.col("others").cast("int")).alias("parts"),
                                     F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"))
    state = state.where("parts > 1").groupBy("members", "n").agg(F.min(F.struct("key", "main", "most")).alias("s"))
    return placed.join(state.select("s.key", "s.main", "n", (F.col("n") - F.col("s.most")).alias("out")), "key")


def _leftover(apart, nodes, sets, percent):
    """A forest of the links, in buckets whose members are apart, between those outside the main component and all of another component."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    of, to = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("out") / BLOCK).cast("int")
    own, probe = F.pmod(F.xxhash64("node"), of).cast("int"), F.pmod(F.xxhash64("node"), to).cast("int")
    members = apart.select("*", own.alias("own"), probe.alias("turn"), of.alias("of"), to.alias("to"))
    residents = members.select("key", "node", "component", "main", F.lit(False).alias("probe"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("to") - 1)).alias("j"))
    probes = members.where("component <> main").select("key", "node", "component", "main", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i"),
                                                       F.col("turn").alias("j"))
    dealt = residents.unionByName(probes).join(nodes, "node").join(sets, "node")

    def run(t):
        if not t.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        node, comp, main, size, probe = (t.column(c).to_numpy() for c in ("node", "component", "main", "n_shingles", "probe"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        shingles = t.column("shingles").to_pylist()
        least, root, found = least_agreeing(sig.shape[1], percent), {}, []

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        here = np.flatnonzero(~probe)
        for x in np.flatnonzero(probe).tolist():
            y = here[(comp[here] != comp[x]) & ((comp[here] == main[x]) | (node[here] < node[x]))]
            small, large = np.minimum(size[y], size[x]), np.maximum(size[y], size[x])
            y = y[100 * small >= percent * large]
            y = y[(np.minimum(size[y], size[x]) < SMALL_SET) | ((sig[y] == sig[x]).sum(axis=1) >= least)]
            for k in y.tolist():
                p, q = find(int(comp[x])), find(int(comp[k]))
                if p != q and linked(np.frombuffer(shingles[x], "<u8"), np.frombuffer(shingles[k], "<u8"), percent):
                    root[p] = q
                    found.append((int(node[x]), int(node[k])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})
    return dealt.groupBy("key", "i", "j").applyInArrow(run, schema)


def groups(df, words=3, percent=85, miss=1e-6):
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links) and kept (whether that is its own)."""
    docs = text_column(df, F.col("doc_id").cast("long").alias("doc_id"))
    signed = materialize(_signed(docs, words, percent, miss))
    sent = signed.where("keys is not null")
    keys = sent.select(F.explode("keys").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("key", "center")
    buckets = materialize(keys.hint("merge").join(shared, "key"))
    met = materialize(buckets.select("node").distinct())
    firsts = materialize(sent.join(met, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    nodes = firsts.select("node", "n_shingles", "sig")
    named = docs.where("doc_id is not null and text is not null").join(firsts.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = materialize(_sets_of(named, words).join(met, "node", "left_semi").dropDuplicates(["node"]))
    stars = buckets.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(_verified(materialize(_open(stars, nodes, percent)), sets, percent))
    labels = materialize(components(links))
    more = materialize(_leftover(materialize(_apart(buckets, labels)), nodes, sets, percent))
    if not more.isEmpty():
        labels = materialize(components(more.unionByName(labels.toDF("a", "b"))))

    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    least = signed.where(~alone).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    labels = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())  # the roots, too
    placed = materialize(least.join(labels, "node", "left").where("copies > 1 or component is not null"))
    whole = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("group"))
    named = placed.join(whole, "component", "left").select("node", F.coalesce("group", "least").alias("group"))
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("group", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
