"""Token ids in patched frame-of-reference blocks, written by Spark and read back.

A segment is one self-contained byte string: a header (magic, ids, ids a block, blocks, width of ids), an index with the place of
each block, and the blocks. A block subtracts its minimum and packs the differences at the narrowest width that holds
the ``fit`` share of them; the bits above that width of the others stand in the block's exception list.

``write_ids`` deals the documents to ranges of ids (bounds from quantiles of the ids alone), sorts each range and cuts
it into segments of whole documents; a segment is a row of a Parquet table, so that Spark's committer covers lost tasks
and any store Spark knows will do. ``read_ids`` gives the documents back with the place of their first id in the whole.

Null ids come first, repeated ids in order of their contents; null and empty texts hold the end id alone; no rows give
an empty table. Columns other than doc_id and text do not take part.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import shared_dir
from .text import batch, text_column, word_tokenizer

MAGIC = b"PFB1"
HEADER = struct.Struct("<4sQIII")
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("spare", "u1")])


def _bit_length(x):
    return np.maximum((x.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)  # from the exponent


def pack(ids, block=128, fit=0.9):
    """The bytes of a segment."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    blocks = -(-n // block)
    if not blocks:
        return HEADER.pack(MAGIC, 0, block, 0, 0)
    padded = np.concatenate([ids, np.full(blocks * block - n, ids[-1], "<u4")]).reshape(blocks, block)
    low = padded.min(axis=1)
    rest = padded - low[:, None]
    width = np.sort(_bit_length(rest), axis=1)[:, min(block - 1, int(np.ceil(fit * block)) - 1)]
    high = rest >> np.minimum(width, 31).astype("<u4")[:, None]
    over = high > 0
    over[width == 32] = False
    exceptions = over.sum(axis=1)
    size = BLOCK_HEAD.itemsize + (width.astype(np.int64) * block + 7) // 8 + 6 * exceptions
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint8)
    head = np.zeros(blocks, BLOCK_HEAD)
    head["low"], head["width"], head["exceptions"] = low, width, exceptions
    out[start[:-1, None] + np.arange(BLOCK_HEAD.itemsize)] = head.view(np.uint8).reshape(blocks, -1)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            out[start[rows, None] + BLOCK_HEAD.itemsize + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        entry = np.zeros(len(row), np.dtype([("place", "<u2"), ("high", "<u4")]))
        entry["place"], entry["high"] = place, high[row, place]
        at = start[row] + BLOCK_HEAD.itemsize + (width[row].astype(np.int64) * block + 7) // 8 + 6 * nth
        out[at[:, None] + np.arange(6)] = entry.view(np.uint8).reshape(-1, 6)
    return HEADER.pack(MAGIC, n, block, blocks, 4) + start[:-1].astype("<u4").tobytes() + out.tobytes()


def unpack(data, first=0, last=None):
    """The ids of a segment, or of its blocks ``first`` up to ``last`` by the index."""
    magic, n, block, blocks, _ = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of patched blocks")
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.empty(0, "<u4")
    start = np.frombuffer(data, "<u4", blocks, HEADER.size).astype(np.int64)[first:last]
    body = np.frombuffer(data, np.uint8, offset=HEADER.size + 4 * blocks)
    head = body[start[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD)[:, 0]
    width, exceptions = head["width"], head["exceptions"].astype(np.int64)
    out = np.zeros((last - first, block), "<u4")
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            packed = body[start[rows, None] + BLOCK_HEAD.itemsize + np.arange((int(w) * block + 7) // 8)]
            bits = np.zeros((len(rows), block, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little", count=int(w) * block).reshape(len(rows), block, w)
            out[rows] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    row = np.repeat(np.arange(last - first), exceptions)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        at = start[row] + BLOCK_HEAD.itemsize + (width[row].astype(np.int64) * block + 7) // 8 + 6 * nth
        entry = body[at[:, None] + np.arange(6)].copy().view(np.dtype([("place", "<u2"), ("high", "<u4")]))[:, 0]
        out[row, entry["place"]] |= entry["high"] << width[row].astype("<u4")
    out += head["low"].astype("<u4")[:, None]
    return out.reshape(-1)[:n - first * block]


def _range_bounds(df, parts):
    """Upper bounds of ``parts`` ranges of ids, from the id column alone."""
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx("doc_id", cuts, 1000).alias("b")).first() if cuts else None
    return np.unique(np.array(row["b"] if row and row["b"] else [], np.int64))


def write_ids(df, tokenizer, path, end_id, block=128, fit=0.9, segment=1 << 16, parts=None):
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of doc_id, to a table at ``path``."""
    spark = df.sparkSession
    df = df.withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _range_bounds(df, parts)
    coded = StructType([StructField("part", IntegerType()), StructField("doc_id", LongType()), StructField("ids", BinaryType())])
    stored = StructType([StructField(c, t()) for c, t in (("part", IntegerType), ("first", LongType), ("n_ids", LongType),
                                                         ("doc_ids", BinaryType), ("nulls", LongType), ("lengths", BinaryType), ("data", BinaryType))])

    def kind_of(tok):
        return "<u4" if max(tok.lib.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16 else "<u2"

    def encode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        tok, out = word_tokenizer(tokenizer), to_arrow_schema(coded)
        kind = kind_of(tok)
        end = np.array([end_id], kind).tobytes()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            part = np.searchsorted(bounds, np.array([-1 << 63 if i is None else i for i in ids], np.int64), "left").astype(np.int32)
            yield batch(out, part=part, doc_id=b.column("doc_id"),
                        ids=[i.astype(kind).tobytes() + end for i in tok.each(t or "" for t in b.column("text").cast(pa.string()).to_pylist())])

    def segments(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        tok, out = word_tokenizer(tokenizer), to_arrow_schema(stored)
        kind = np.dtype(kind_of(tok))
        part, first, held, docs, n = None, 0, [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), kind)
            return batch(out, part=[part], first=[first], n_ids=[len(ids)],
                         doc_ids=[np.array([d or 0 for d in docs], "<i8").tobytes()], nulls=[sum(d is None for d in docs)],
                         lengths=[np.array([len(h) // kind.itemsize for h in held], "<u4").tobytes()], data=[pack(ids, block, fit)])
        for b in batches:
            for p, d, raw in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if held and (p != part or n >= segment):
                    yield flush()
                    first = first + n if p == part else 0
                    held, docs, n = [], [], 0
                elif p != part:
                    first = 0
                part = p
                held.append(raw)
                docs.append(d)
                n += len(raw) // kind.itemsize
        if held:
            yield flush()

    rows = text_column(df, "doc_id").mapInArrow(encode, coded)
    rows = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    rows.mapInArrow(segments, stored).write.mode("overwrite").parquet(path)
    return path


def read_ids(spark, path, with_ids=True):
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids."""
    table = spark.read.parquet(path)
    totals = table.select("part", "n_ids").groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range; their number is that of the partitions
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    fields = [StructField(c, LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    schema = StructType([*fields, StructField("ids", BinaryType())] if with_ids else fields)

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)
        for b in batches:
            for r in b.to_pylist():
                ids, lengths = unpack(r["data"]), np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                docs = np.frombuffer(r["doc_ids"], "<i8").tolist()
                docs[:r["nulls"]] = [None] * r["nulls"]
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                cut = [raw[4 * a:4 * z] for a, z in zip((ends - lengths).tolist(), ends.tolist())]
                yield batch(out, doc_id=docs, start=r["base"] + r["first"] + ends - lengths, n_tokens=lengths, ids_crc32=[zlib.crc32(c) for c in cut],
                            **({"ids": [bytes(c) for c in cut]} if with_ids else {}))
    return table.join(F.broadcast(base), "part").mapInArrow(decode, schema)


def round_trip(df, tokenizer, end_id=1):
    """Writes the ids of all documents to the shared folder and reads them back."""
    spark = df.sparkSession
    return read_ids(spark, write_ids(df, tokenizer, shared_dir(spark, "ids"), end_id), with_ids=False)
