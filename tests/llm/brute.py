"""Plain single-process versions of what the operators compute, for small tables."""

import zlib

import numpy as np


def encoder(path):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(path)
    return lambda text: np.array(lib.encode(text or "", add_special_tokens=False).ids, "<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def id_stream(docs, path, end_id):
    """(doc_id, start, n, crc) of documents in ascending order of id."""
    enc, out, start = encoder(path), [], 0
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = np.append(enc(t), end_id)
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def cut_pieces(docs, path, end_id, capacity):
    enc, out = encoder(path), []
    for d, t in docs:
        ids = np.append(enc(t), end_id)
        out += [(d, k, s, len(ids[s:s + capacity]), crc(ids[s:s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out)


def shingles(text, k):
    """Distinct runs of k words; only A-Z are lower-cased; a shorter text is one run."""
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def components(docs, k, percent):
    """{id: smallest id reachable by links}, trying all pairs of distinct sets."""
    sets = {d: shingles(t, k) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(d for d in sets if sets[d])
    by_shingle = {}
    for d in ids:
        near = {e for s in sets[d] for e in by_shingle.get(s, ())}
        for e in near:
            both = len(sets[d] & sets[e])
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    return {d: find(d) for d in sets}


def base_statistics(text):
    import re
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def earliest_deadline(weights, blocks):
    """Slot by slot: sources in the order of the mixture, with a new start whenever one runs out."""
    from fractions import Fraction
    import math
    left, out = dict(blocks), []
    while any(left.values()):
        live = {s: weights[s] for s in left if left[s]}
        total, had, t = sum(live.values()), dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [(math.ceil(Fraction((had[s] + 1) * total, w)), s) for s, w in live.items() if math.floor(Fraction(had[s] * total, w)) <= t]
            _, s = min(ready)
            out.append(s)
            had[s] += 1
            left[s] -= 1
            t += 1
    return out


def deleted_letter_words(docs, shortest=5, least=3):
    """{word: n} with one run in 97 short of a letter."""
    import re
    n = {}
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def one_edit_apart(words):
    """{word: near words} by deleting each letter: near words are equal after a deletion in one or at one place of both."""
    by, near = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            by.setdefault((k, w[:k] + w[k + 1:]), set()).add(w)
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1:]
            near[w] |= by[k, short] - {w}
            if short in near:
                near[w].add(short)
                near[short].add(w)
    return near


def variants(docs):
    n = deleted_letter_words(docs)
    near, form = one_edit_apart(n), {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def hard_negatives(rows, every=50, positives=5, negatives=3):
    """``rows`` (id, label, integer vector); labels as they count."""
    out = []
    for a, la, za in rows:
        if a % every:
            continue
        s = sorted((-int(za @ z), i, l) for i, l, z in rows)
        for sp, p in [(-x, i) for x, i, l in s if l == la and i != a][:positives]:
            fit = [(-x, i) for x, i, l in s if l != la and 50 * sp <= -100 * x <= 95 * sp][:negatives]
            out += [(a, p, r, i, sp, x) for r, (x, i) in enumerate(fit, 1)]
    return sorted(out)
