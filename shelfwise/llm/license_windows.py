"""Finds license notices by MinHash bands over overlapping windows and verifies them by exact shingle containment.

Words are lower-cased runs of characters other than white space without the marks around them, and words of marks alone (as at the starts
of comment lines) are left out; a notice of n shingles of ``k`` words (a shorter one is one
shingle of its own width) is looked for in windows of 2n shingles that overlap by half, so that some window holds any n in a row.
A window that contains the share ``least`` of a notice has Jaccard similarity of at least least / (3 - least) with it, and the number of
bands follows from that, so that it meets the notice in a band with probability ``sure``. For the windows met, the notice's distinct
shingles in the window are counted exactly, and of the windows with enough of them the best, then first one is reported.
Notices of which the whole text holds too few shingles are not looked for in its windows.

Whole texts are scanned, whatever their length. Null and empty texts and texts shorter than a notice give nothing for it. Repeated
rows are reported as often as they come. Columns other than doc_id and text do not take part.
"""

import math
import pkgutil
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .text import Memo, batch, mix, shingle_hashes, text_column

#: Licenses whose whole texts, in ``licenses/``, are looked for passage by passage.
WHOLE = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-sa-4.0", "cc0-1.0", "gpl-1", "gpl-2", "gpl-3", "isc", "lgpl-2", "lgpl-2.1", "lgpl-3", "mit", "mpl-1.1", "mpl-2.0", "unlicense")
_SPDX = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
         "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense")


def passages(text, least=25):
    """The whole text in passages of at least so many words: paragraphs, short ones with what follows them."""
    out, held = [], []
    for paragraph in re.split(r"\n\s*\n", text):
        held += paragraph.split()
        if len(held) >= least:
            out.append(" ".join(held))
            held = []
    if held and out:
        out[-1] += " " + " ".join(held)
    elif held:
        out.append(" ".join(held))
    return out


#: Notices looked for, fixed values: statements of a license, opening passages, and all passages of whole license texts by number.
NOTICES = {
    "mit-statement": "Released under the MIT License.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-statement": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "no-rights": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
    "no-rights-statement": "All rights reserved.",
    "mit-license": "licensed under the MIT License",
    "bsd-license": "licensed under the BSD License",
    "bsd-2-clause-license": "licensed under the BSD 2-Clause License",
    "bsd-3-clause-license": "licensed under the BSD 3-Clause License",
    "isc-license": "licensed under the ISC License",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-2.0-license": "licensed under the Mozilla Public License, v. 2.0",
    "mpl-2.0-license-version": "licensed under the Mozilla Public License, version 2.0",
    "gpl-2-or-later": "either version 2 of the License, or (at your option) any later version",
    "gpl-3-or-later": "either version 3 of the License, or (at your option) any later version",
    "gpl-2-only": "GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-3-only": "GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl-2-version": "GNU General Public License, version 2",
    "gpl-3-version": "GNU General Public License, version 3",
    "gpl-2-v": "GNU General Public License v2",
    "gpl-3-v": "GNU General Public License v3",
    "lgpl-2.1-version": "GNU Lesser General Public License, version 2.1",
    "lgpl-3-version": "GNU Lesser General Public License, version 3",
    "lgpl": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-2": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "cc-by-4.0-statement": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-statement": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-statement": "Licensed under CC0 1.0.",
    "cc0-waiver": "has waived all copyright and related or neighboring rights to",
    "unlicense": "This is free and unencumbered software released into the public domain",
    **{f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in _SPDX},
    **{f"{name}#{i:03}": p for name in WHOLE for i, p in enumerate(passages(pkgutil.get_data(__package__, f"licenses/{name}.txt").decode()), 1)},
}
_AROUND = " .,;:!?\"'()[]{}<>*#$%&|-_/=".encode()


def bands_for(similarity, sure):
    """Bands of one row that two sets of a similarity meet in with a probability."""
    return math.ceil(math.log(1 - sure) / math.log(1 - similarity))


class Scanner:
    def __init__(self, notices, k=5, least=0.8, sure=0.9999):
        import xxhash
        self.least, self.widths = least, {}
        self.words = Memo(lambda w: xxhash.xxh64_intdigest(w.strip(_AROUND).lower()), 300_000)
        self.none = np.uint64(xxhash.xxh64_intdigest(b""))
        bands = bands_for(least / (3 - least), sure)
        self.seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        held = {}
        for name, text in sorted(notices.items()):
            h = self.hashes(text.encode().split())
            h = h[h != self.none]
            width = min(k, len(h))
            shingles = np.unique(shingle_hashes(h, width))
            held.setdefault(width, []).append((name, shingles, self.mins(shingles[None, :])[0], len(h) - width + 1))
        for width, of in held.items():  # all shingles of a width with the notices that each belongs to
            flat, owner = np.concatenate([x[1] for x in of]), np.repeat(np.arange(len(of)), [len(x[1]) for x in of])
            order = np.argsort(flat, kind="stable")
            known, first = np.unique(flat[order], return_index=True)
            self.widths[width] = of, known, np.append(first, len(flat)), owner[order], np.array([least * len(x[1]) for x in of])

    def hashes(self, words):
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def mins(self, rows):
        """Smallest value of each row under each band's hash."""
        return np.stack([mix(rows ^ s).min(axis=1) for s in self.seeds], axis=1)

    def scan(self, text):
        """(notice, containment, first word, words) of a text's best windows."""
        h = self.hashes(text.split())
        at = np.flatnonzero(h != self.none)
        h = h[at]
        out = []
        for width, (notices, known, first, owner, needed) in self.widths.items():
            if len(h) < width:
                continue
            s = shingle_hashes(h, width)
            place = np.minimum(np.searchsorted(known, s), len(known) - 1)
            place = np.unique(place[known[place] == s])
            # what the whole text holds of a notice bounds what a window does
            counts = np.zeros(len(notices), np.int64)
            for p in place.tolist():
                counts[owner[first[p]:first[p + 1]]] += 1
            likely = np.flatnonzero(counts >= needed - 1e-9).tolist()
            if likely:
                hashed = np.stack([mix(s ^ seed) for seed in self.seeds])
            by_size = {}
            for i in likely:
                by_size.setdefault(notices[i][3], []).append(notices[i])
            for n, of in by_size.items():
                cuts = np.arange(0, len(s), n)
                half = np.minimum.reduceat(hashed, cuts, axis=1)
                low = np.minimum(half, np.concatenate([half[:, 1:], half[:, -1:]], axis=1))
                for name, shingles, mins, _ in of:
                    best = (0.0, 0)
                    for w in np.flatnonzero((low == mins[:, None]).any(axis=0)).tolist():
                        window = s[cuts[w]:cuts[w] + 2 * n]
                        held = len(np.intersect1d(window, shingles)) / len(shingles)
                        if held > best[0]:
                            inside = np.flatnonzero(np.isin(window, shingles))
                            a, b = at[cuts[w] + inside[0]], at[cuts[w] + inside[-1] + width - 1]
                            best = (held, int(a), int(b - a) + 1)
                    if best[0] >= self.least:
                        out.append((name, *best))
        return out


@lru_cache(maxsize=1)
def _standard(k, least, sure):
    """One scanner for the standard notices a process."""
    return Scanner(NOTICES, k, least, sure)


def word_span(text, first, count):
    """Code points from the start of one word to the end of another."""
    at = [m.span() for m in re.finditer("[^ \t-\r]+", text)]
    return at[first][0], at[first + count - 1][1]


def find_notices(df, notices=None, key="doc_id", k=5, least=0.8, sure=0.9999):
    """Per document and notice found: the key, license, containment and the code points start to end of the best place."""
    schema = StructType([df.select(key).schema[0], StructField("license", StringType()), StructField("containment", DoubleType()),
                         StructField("start", LongType()), StructField("end", LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        scanner, out = _standard(k, least, sure) if notices is None else Scanner(notices, k, least, sure), to_arrow_schema(schema)
        for b in batches:
            got = []
            for i, t in enumerate(b.column("text").to_pylist()):
                for name, held, first, count in scanner.scan(t or b""):
                    got.append((i, name, held, *word_span(t.decode(), first, count)))
            yield batch(out, **{key: b.column(key).take(pa.array([g[0] for g in got], pa.int64()))},
                        **{c: [g[i] for g in got] for i, c in enumerate(("license", "containment", "start", "end"), 1)})
    return text_column(df, key).mapInArrow(run, schema)
