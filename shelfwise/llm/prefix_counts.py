"""Exact token counts at every prefix of a text, by dynamic programming over a sentencepiece BPE vocabulary.

The tokens of a prefix are the tokens of a shorter prefix and one more token: the one whose pair with the token
before it survives the merges. So one step a character finds the last token of each prefix and, with it, the count.
Merges never cross two characters that no piece holds side by side, such as a letter before a blank (which is
checked), so a text is cut there, and the steps of a run of characters are remembered; runs share the steps of their common beginnings.

Null and empty texts have no tokens and an empty list of steps. Rows are kept as they are: repeated rows and null ids
give repeated rows and null ids. Columns other than the id and the text do not take part.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .text import Memo, batch, text_column

BLANK = "▁"
_RUNS = re.compile(" *[^ ]+| +$")


class PrefixCounter:
    def __init__(self, model):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)}
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece goes on over a blank; texts cannot be cut there")
        self.longest = max(map(len, self.score))
        self.together = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        self.edges = Memo(self._edges)
        self.follows = Memo(self._survives, 400_000)
        self.states = {"": (0, "", b"")}  # prefix of a run: its count, last token and changes of the count
        self.deltas = Memo(self._deltas, 300_000)

    def merge(self, text, seen=None):
        """Tokens of a short text: join the best-scored pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            if seen is not None:
                seen.append((best, parts[0] if at == 0 else None, parts[-1] if at == len(parts) - 2 else None))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _edges(self, token):
        """What stands at the left and right end of a token while it is merged, each with the score of the merge that
        ends it. None for a token that merges never give; an empty pair if its merges do not come in order of score."""
        seen = []
        if self.merge(token, seen) != [token]:
            return None
        scores = [s for s, _, _ in seen]
        if scores != sorted(scores, reverse=True):
            return ()
        return tuple([*((part, s) for s, *ends in seen if (part := ends[side])), (token, float("-inf"))] for side in (0, 1))

    def _survives(self, pair):
        """Whether two tokens stay apart: no merge over the seam comes before the merges inside them."""
        one, two = self.edges[pair[0]], self.edges[pair[1]]
        if one is None or two is None:
            return False
        if not one or not two:
            return self.merge(pair[0] + pair[1]) == list(pair)
        right, left, i, j = one[1], two[0], 0, 0
        while True:
            (a, a_ends), (b, b_ends) = right[i], left[j]
            s = self.score.get(a + b)
            if s is not None and s > a_ends and s >= b_ends:
                return False
            if a_ends == b_ends == float("-inf"):
                return True
            if a_ends >= b_ends:
                i += 1
            else:
                j += 1

    def _step(self, run, end):
        """Count, last token and changes of the count of run[:end], from those of shorter prefixes."""
        score, states = self.score, self.states
        for start in range(max(0, end - self.longest), end):
            token = run[start:end]
            if token in score or start == end - 1:
                count, before, _ = states[run[:start]]
                if not before or self.follows[before, token]:
                    count += 1 if token in score else len(token.encode())
                    was, _, changes = states[run[:end - 1]]
                    return count, token, changes + bytes(((count - was) & 255,))
        raise ValueError(f"no last token for {run[:end]!r}")

    def _deltas(self, run):
        """Change of the count at each character of a run, as signed bytes. A blank stands for itself and for its mark."""
        run = run.replace(" ", BLANK)
        if "\n" in run and run != "\n":
            at = run.index("\n")
            if self._seam(run, at) and self._seam(run, at + 1):
                return b"".join(self.deltas[x] for x in (run[:at], "\n", run[at + 1:]) if x)
        if len(run) > 2 and not run[-1].isalnum() and run[-2].isalpha() and self._seam(run, len(run) - 1):
            return self.deltas[run[:-1]] + self.deltas[run[-1]]
        if len(run) > 64:
            return self._long(run)
        states, known = self.states, len(run)
        if len(states) > 700_000:
            states.clear()
            states[""] = (0, "", b"")
        while run[:known] not in states:
            known -= 1
        for end in range(known + 1, len(run) + 1):
            states[run[:end]] = self._step(run, end)
        return states[run][2]

    def _seam(self, run, at):
        """Whether no piece holds the two characters at a place side by side, so that no merge crosses it."""
        return at in (0, len(run)) or run[at - 1:at + 1] not in self.together

    def _long(self, run):
        """The same steps for a long run, by position and without remembering its prefixes."""
        counts, last = [0], [""]
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - self.longest), end):
                token = run[start:end]
                if (token in self.score or start == end - 1) and (not last[start] or self.follows[last[start], token]):
                    counts.append(counts[start] + (1 if token in self.score else len(token.encode())))
                    last.append(token)
                    break
            else:
                raise ValueError("no last token")
        return np.diff(np.array(counts)).astype(np.int8).tobytes()

    def __call__(self, text):
        """Signed bytes, one a character: their running sum is the token count of each prefix."""
        if not text:
            return b""
        text = text.replace(BLANK, " ")  # to the library they are the same
        if "  " in text or text[0] == " " or text[-1] == " ":
            runs = _RUNS.findall(" " + text)
        else:
            runs = [" " + w for w in text.split(" ")]
        raw = b"".join(map(self.deltas.__getitem__, runs))
        first = np.frombuffer(raw[:2], np.int8).sum(dtype=np.int8)  # the mark put before a text is no character of it
        return first.tobytes() + raw[2:]


@lru_cache(maxsize=1)
def _counter(model):
    """One counter a process, so that the tasks of a worker share what it remembers."""
    return PrefixCounter(model)


def longest_prefix(deltas, budget):
    """Characters of the longest prefix with at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(df, model, limit, key="doc_id"):
    """Per row: the id, n_bytes, n_tokens, chars_in_limit (longest prefix with at most ``limit`` tokens) and ``deltas``
    (one signed byte a character, whose running sum is the count at each prefix)."""
    schema = StructType([df.select(key).schema[0], *(StructField(c, LongType()) for c in ("n_bytes", "n_tokens", "chars_in_limit")),
                         StructField("deltas", BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        counter, out = _counter(model), to_arrow_schema(schema)
        for b in batches:
            text = b.column("text")
            deltas = [counter(t) for t in text.cast(pa.string()).to_pylist()]
            tokens = [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas]
            yield batch(out, **{key: b.column(key), "n_bytes": [len(t) if t else 0 for t in text.to_pylist()], "n_tokens": tokens,
                                "chars_in_limit": [len(d) if n <= limit else longest_prefix(d, limit) for d, n in zip(deltas, tokens)],
                                "deltas": deltas})
    return text_column(df, key).mapInArrow(run, schema)


def count_report(df, model, limit=4096):
    """Per document: doc_id, n_bytes, n_tokens, over_limit, chars_in_limit."""
    return prefix_counts(df, model, limit).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_in_limit")
