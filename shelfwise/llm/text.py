"""Helpers shared by the document operators: rows in Arrow batches, word hashing, memoised tokenizers."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

#: Words are runs of characters other than these six; ``bytes.split()`` cuts at exactly the same ones.
SPACES = " \t\n\x0b\x0c\r"
MEMO = 300_000
RUNS = 1_000_000  # of a tokenizer; some 170 MB


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_column(df, *others):
    """The id, the text as bytes and other columns, ready for ``mapInArrow``; other columns of ``df`` stay out."""
    return df.select(*others, F.col("text").cast("string").cast("binary").alias("text"))


def free_name(df, name):
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def batch(schema, **columns):
    """A record batch with the columns of an Arrow schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array)
                                       else columns[f.name] for f in schema], schema=schema)


class Memo(dict):
    """``make(key)`` for keys not met yet; starts anew when full, so that memory stays bounded."""

    def __init__(self, make, limit=MEMO):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordHasher:
    """64-bit hashes of the words of a text."""

    def __init__(self, seed=0):
        self.memo = Memo(lambda w: xxhash.xxh64_intdigest(w, seed))

    def __call__(self, words):
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def mix(x):
    """Avalanches 64-bit words, so that equal inputs give equal and others unrelated values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(h, k):
    """A hash of each run of ``k`` words, by position; a shorter text counts as one run, no words as none."""
    n = len(h)
    if n == 0:
        return h
    whole = n < k
    width = n if whole else k
    s = np.full(n - width + 1, np.uint64(0x9E3779B97F4A7C15 + whole * n), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            s = mix(s + h[j:len(h) - width + 1 + j])
    return s


def crc_of(ids):
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


class WordTokenizer:
    """Ids of whole texts from a ``tokenizers`` file that drops white space, lower-cases, and cuts letters from marks.

    Texts are cut at blanks and line ends; a run of other characters always gives the same ids, so each distinct
    run is encoded once and remembered, and marks after a letter apart from it. Texts that hold a special token's
    string are encoded by the library as they stand. Tests hold the ids against the library's.
    """

    MARKS = ".,;:!?#*$%&|"

    def __init__(self, path, runs=RUNS):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        added = {str(t.content): i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special, (self.cut, self.cut_id) = list(added), next(iter(added.items()))
        self.memo, self.old, self.most = {"": b""}, {}, runs // 2
        self.plain = self._plain(path)

    def whole(self, text):
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4")

    def _plain(self, path):
        """For runs of lower-case letters alone, which are one piece each to the pattern: the same merges without
        normalizer and pattern, and which ids end a word, which is where such runs can be told apart."""
        from tokenizers import Tokenizer, pre_tokenizers
        lib = Tokenizer.from_file(path)
        suffix = lib.model.end_of_word_suffix
        if not suffix:
            return None
        from tokenizers import normalizers
        lib.normalizer = normalizers.Sequence([])
        lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(lib.get_vocab_size(), bool)
        ends[[i for t, i in lib.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        return lib, ends

    def _keep(self, runs, ids, ends):
        raw, start = ids.tobytes(), 0
        for r, end, after in zip(runs, *ends, strict=True):
            self.memo[r] = raw[4 * start:4 * end]
            start = after

    def _encode(self, runs):
        """Remembers runs; one call encodes many."""
        letters = [r for r in runs if r.isalpha() and r.islower() and (r.isascii() or max(r) < "\u0100")] if self.plain else []
        for i in range(0, len(letters), 2048):
            lib, last = self.plain
            ids = np.array(lib.encode(" ".join(letters[i:i + 2048]), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            self._keep(letters[i:i + 2048], ids, (ends, ends))
        rest = [r for r in runs if r not in self.memo]
        for i in range(0, len(rest), 2048):  # held apart by a special token
            ids = np.array(self.lib.encode(self.cut.join(rest[i:i + 2048]), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.cut_id), len(ids))
            self._keep(rest[i:i + 2048], ids, (ends.tolist(), (ends + 1).tolist()))

    def _learn(self, missing):
        """Remembers a set of runs that are not remembered yet."""
        memo, old = self.memo, self.old
        if len(memo) + len(missing) > self.most:  # what was met lately outlives one turn
            self.old = old = memo
            self.memo = memo = {"": b""}
        new, parts, tails = [], set(), []
        for r in missing:
            known = old.get(r)
            if known is not None:
                memo[r] = known
            elif r.isalpha():
                new.append(r)
            else:
                base = r.rstrip(self.MARKS)
                if base != r and base[-1:].isalpha():
                    tail = r[len(base):]
                    tails.append((r, base, tail))
                    parts.add(base)
                    parts.add(tail)
                else:
                    new.append(r)
        for r in parts - missing:
            if r not in memo:
                known = old.get(r)
                if known is None:
                    new.append(r)
                else:
                    memo[r] = known
        self._encode(new)
        for r, base, tail in tails:
            memo[r] = memo[base] + memo[tail]

    def _runs(self, text):
        """The runs of a text; None where the library has to see the text itself."""
        try:
            text.encode("latin-1")  # no marks that combine with what stands before them: lower case may come first
            text = text.lower()
        except UnicodeEncodeError:
            pass
        if any(s in text for s in self.special):
            return None
        return (text.replace("\n", " ") if "\n" in text else text).split(" ")

    def __call__(self, text):
        """Ids as a little-endian unsigned 32-bit array."""
        return self.many([text])[0]

    def many(self, texts):
        """Ids of some texts; what they have in new runs is learnt at once."""
        runs = [self._runs(t) for t in texts]
        found = [None if x is None else list(map(self.memo.get, x)) for x in runs]
        gaps = [[] if v is None else [i for i, b in enumerate(v) if b is None] for v in found]
        missing = {x[i] for x, g in zip(runs, gaps) for i in g}
        if missing:
            self._learn(missing)
            for x, v, g in zip(runs, found, gaps):
                for i in g:
                    v[i] = self.memo[x[i]]
        return [self.whole(t) if v is None else np.frombuffer(b"".join(v), "<u4") for t, v in zip(texts, found)]

    def each(self, texts, at_once=64):
        """Ids of texts one after the other, learnt by groups of bounded length."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if len(group) == at_once or size > 1 << 20:
                yield from self.many(group)
                group, size = [], 0
        if group:
            yield from self.many(group)


_AT_WORK = {}


def at_work(make, *args):
    """One helper a process, shared by the tasks of a worker. Workers outlive an operator: what its helper has remembered goes
    when the next operator asks for one of its own."""
    if (make, args) not in _AT_WORK:
        _AT_WORK.clear()
        _AT_WORK[make, args] = make(*args)
    return _AT_WORK[make, args]


def word_tokenizer(path, runs=RUNS):
    return at_work(WordTokenizer, path, runs)


def word_hasher():
    return at_work(WordHasher)
