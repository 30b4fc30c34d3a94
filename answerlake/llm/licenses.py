"""License notices in documents: MinHash bands over overlapping windows, then containment.

Words are lower-cased runs of ASCII letters and digits and of other characters beyond
ASCII. Templates are grouped by length; a group has a window of ``size`` n-gram starts that
moves by ``step``, so that every occurrence of a template lies whole in some window. A
window and a template collide when the smallest of their n-gram hashes is the same under
any of the group's hash functions (bands of one row). The number of bands follows from the
smallest similarity that a window with a match can have, so that a match collides with a
probability of at least ``COLLISION``. The n-grams of each collided window are then
compared with the template's: a match contains at least ``threshold`` of 100 of them.
Where a template has telling words, such as a version or "Lesser", a match must also have
each of these runs of words, and none of the runs that tell another license, between its
first and last common n-gram. A name may have several wordings; its best one counts.

Texts are streamed through in blocks of words; windows may span documents of a block, but
the exact comparison only looks at one document's words.

Cases: null and empty texts match nothing; a text that is shorter than a window is one
window; several occurrences of one template are one match at the first place; ties go to
the smaller template name; repeated rows are scanned each; an empty table gives no rows.
Extra columns are not read.
"""

import math
import pkgutil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from answerlake.llm import query
from answerlake.llm.common import ALNUM_LOWER, col, per_text, table

THRESHOLD, COLLISION, BLOCK_WORDS, WORD_CACHE = 80, 0.9999, 1 << 19, 300_000
# (longest template in words, words of an n-gram, step of the windows, steps in a window)
GROUPS = ((5, 2, 2, 3), (9, 2, 4, 3), (18, 3, 8, 4), (97, 5, 32, 4), (385, 5, 128, 4), (1537, 5, 512, 4),
          (6145, 5, 2048, 4))

# Texts of public license notices, by a name for each.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_GNU = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License",
        "agpl": "GNU Affero General Public License"}
_GNU_VERSIONS = (("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3"))
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial",
       "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
       "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED " \
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR " \
    "PURPOSE ARE DISCLAIMED."
_BSD_2 = TEMPLATES["bsd-redistribution"] + (
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = _BSD_2 + (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ")
# Runs of words that a match of the template must have.
TELLING = {
    "apache-2.0": ("apache license version 2 0",), "apache-2.0-header": ("apache license version 2 0",),
    "cc-by-4.0": ("creative commons attribution 4 0",), "cc-by-nc-4.0": ("cc by nc 4 0",),
    "cc-by-sa-4.0": ("cc by sa 4 0",), "gpl-3.0": ("gnu general public license version 3",),
    "gpl-notice": ("the gnu general public license", "version 3"), "mpl-2.0": ("mozilla public license v 2 0",),
    "mit": ("the mit license",),
}
# Files of whole texts, their names, and the words that tell them from their kin.
WHOLE = (
    ("Apache-2.0", "apache-2.0-text", ()), ("Artistic", "artistic-1.0-text", ()), ("CC0-1.0", "cc0-1.0-text", ()),
    ("GFDL-1.2", "gfdl-1.2-text", ("free documentation license version 1 2",)),
    ("GFDL-1.3", "gfdl-1.3-text", ("massive multiauthor collaboration",)), ("GPL-1", "gpl-1.0-text", ()),
    ("GPL-2", "gpl-2.0-text", ()),
    ("GPL-3", "gpl-3.0-text", ("this license refers to version 3 of the gnu general public license",)),
    ("LGPL-2", "lgpl-2.0-text", ("this library general public license",)),
    ("LGPL-2.1", "lgpl-2.1-text", ("this lesser general public license",)), ("LGPL-3", "lgpl-3.0-text", ()),
    ("MPL-1.1", "mpl-1.1-text", ()), ("MPL-2.0", "mpl-2.0-text", ()),
)


def wordings() -> list:
    """(name, text, runs of words that tell it, runs that tell another) of every template."""
    out = [(n, t, TELLING.get(n, ()), ()) for n, t in TEMPLATES.items()]
    for kind, v in _GNU_VERSIONS:
        whole, name = _GNU[kind], f"{kind}-{v}" if "." in v else f"{kind}-{v}.0"
        told = f"{whole.lower()} version {v.replace('.', ' ')}"
        if name not in TEMPLATES:
            out.append((name, f"This work is licensed under the {whole}, version {v}.", (told,), ()))
        for t, tell in ((f"licensed under the {whole}, version {v}", told),
                        (f"licensed under the {whole} v{v}", f"{whole.lower()} v{v.replace('.', ' ')}"),
                        (f"under the GNU {kind} version {v}", f"gnu {kind} version {v.replace('.', ' ')}"),
                        (f"under the {kind}v{v}", f"{kind}v{v.replace('.', ' ')}"),
                        (f"under {kind}-{name[len(kind) + 1:]}", f"{kind} {name[len(kind) + 1:].replace('.', ' ')}"),
                        (f"SPDX-License-Identifier: {name}", f"identifier {name.replace('-', ' ').replace('.', ' ')}")):
            out.append((name, t, (tell,), ()))
        if (kind, v) != ("gpl", "3"):
            what = "library" if (kind, v) == ("lgpl", "2.1") else "program"
            out.append((f"{name}-notice", (
                f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {whole} "
                f"as published by the Free Software Foundation, either version {v} of the License, or (at your option) "
                "any later version."), (f"the {whole.lower()}", f"version {v.replace('.', ' ')} of the license"), ()))
    for kind, whole in _CC.items():
        for v in ("2.0", "2.5", "3.0", "4.0"):
            name, told = f"cc-{kind}-{v}", f"{kind} {v}".replace("-", " ").replace(".", " ")
            where = {"3.0": "Unported ", "4.0": "International "}.get(v, "Generic ")
            # before version 4 the name was NoDerivs
            full = whole if v == "4.0" else whole.replace("Derivatives", "Derivs")
            tell = f"creative commons {full.lower().replace('-', ' ')} {v.replace('.', ' ')}"
            out += [(name, f"Licensed under CC {kind} {v}", (f"cc {told}",), ()),
                    (name, f"This work is licensed under a Creative Commons {full} {v} {where}License.", (tell,), ()),
                    (name, f"licensed under the Creative Commons {full} {v} License", (tell,), ()),
                    (name, f"SPDX-License-Identifier: {name}", (f"identifier cc {told}",), ())]
    for name, called in (("mit", "MIT"), ("isc", "ISC"), ("zlib", "zlib"), ("unlicense", "Unlicense"),
                         ("bsl-1.0", "Boost Software"), ("bsd-2-clause", "BSD 2-Clause"), ("bsd-3-clause", "BSD 3-Clause")):
        spdx = name.replace("-", " ").replace(".", " ")
        out += [(name, f"under the {called} License", (called.lower().replace("-", " ") + " license",), ()),
                (name, f"SPDX-License-Identifier: {name}", (f"identifier {spdx}",), ())]
    out += [("apache-2.0", "under the Apache License 2.0", ("apache license 2 0",), ()),
            ("apache-2.0", "under the Apache 2.0 License", ("apache 2 0 license",), ()),
            ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("identifier apache 2 0",), ()),
            ("mpl-2.0", "under the Mozilla Public License 2.0", ("mozilla public license 2 0",), ()),
            ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0", ("identifier mpl 2 0",), ()),
            ("cc0-1.0", "SPDX-License-Identifier: CC0-1.0", ("identifier cc0 1 0",), ()),
            ("bsd-2-clause-text", _BSD_2 + _AS_IS, (), ("endorse or promote products",)),
            ("bsd-3-clause-text", _BSD_3 + _AS_IS, ("endorse or promote products",), ("all advertising materials",))]
    return out + [(n, pkgutil.get_data(__package__, f"license_texts/{f}.txt").decode(), tell, ()) for f, n, tell in WHOLE]


def words_of(text) -> list:
    return (text or b"").translate(ALNUM_LOWER).split()


def bands(template_grams: int, window_grams: int, threshold: int, collision: float) -> int:
    """Functions that a match of the least similarity needs to collide as surely as asked."""
    common = max(1, math.ceil(template_grams * threshold / 100))
    least = common / (window_grams + template_grams - common)
    return math.ceil(math.log(1 - collision) / math.log(1 - least)) if least < 1 else 1


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def grams_of(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` word hashes."""
    n = len(ids) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n])
    return out


class Scanner:
    """Finds templates in blocks of texts."""

    def __init__(self, templates, threshold: int = THRESHOLD, collision: float = COLLISION):
        """``templates``: texts by name, or wordings as of ``wordings``."""
        self.threshold, self.known, self.groups = threshold, {}, []
        if isinstance(templates, dict):
            templates = [(n, t, (), ()) for n, t in templates.items()]
        sized = [(name, self._ids(words_of(t.encode())), *([self._ids(words_of(run.encode())) for run in runs]
                                                           for runs in (tell, other)))
                 for name, t, tell, other in sorted(templates)]
        shortest = 0
        for longest, width, step, steps in GROUPS:
            own = [(n, np.unique(grams_of(ids, width)), *([(len(r), grams_of(r, len(r))[0]) for r in runs] for runs in (tell, other)))
                   for n, ids, tell, other in sized if shortest < len(ids) <= longest and len(ids) >= width]
            # an n-gram that every match must have, where there is one
            must = [next((grams_of(r, width)[-1] for r in tell if len(r) >= width), None)
                    for n, ids, tell, other in sized if shortest < len(ids) <= longest and len(ids) >= width]
            shortest = longest
            if not own:
                continue
            n = max(bands(len(t[1]), step * steps, threshold, collision) for t in own)
            keys = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
            least = [np.array([(t[1] * k).min() for t in own]) for k in keys]
            self.groups.append((width, step, steps, own, must, keys, least))
        if any(len(ids) > GROUPS[-1][0] or len(ids) < GROUPS[0][1] for _, ids, _, _ in sized):
            raise ValueError(f"templates have {GROUPS[0][1]} to {GROUPS[-1][0]} words")

    def _ids(self, words) -> np.ndarray:
        known, out = self.known, []
        if len(known) > WORD_CACHE:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, texts: list) -> list:
        """For each text a dictionary of template names to (containment, first word)."""
        found, block, size = [{} for _ in texts], [], 0
        for i, text in enumerate(texts):
            ids = self._ids(words_of(text))
            if len(ids):
                block.append((i, ids))
                size += len(ids)
            if size >= BLOCK_WORDS:
                self._scan(block, found)
                block, size = [], 0
        if block:
            self._scan(block, found)
        return found

    def _scan(self, block, found):
        ids = np.concatenate([x for _, x in block])
        starts = np.cumsum([0, *[len(x) for _, x in block]])
        for width, step, steps, templates, must, keys, least in self.groups:
            grams = grams_of(ids, width)
            if not len(grams):
                continue
            n = -(-len(grams) // step)
            filled = np.concatenate([grams, np.full(n * step - len(grams), grams[-1])])
            hits, held = set(), {}
            for g in {g for g in must if g is not None}:
                at = np.flatnonzero(grams == g) // step
                held[g] = {w for x in np.unique(at).tolist() for w in range(max(0, x - steps + 1), x + 1)}
            # only windows that hold such an n-gram, where every template has one
            some = None if None in must else np.array(sorted(set().union(*held.values())), np.int64)
            if some is not None and not len(some):
                continue
            for key, wanted in zip(keys, least):
                low = (filled * key).reshape(n, step).min(axis=1)
                window = low.copy()
                for k in range(1, min(steps, n)):
                    np.minimum(window[:n - k], low[k:], out=window[:n - k])
                near = np.flatnonzero(np.isin(window, wanted)) if some is None else some[np.isin(window[some], wanted)]
                for w in near.tolist():
                    hits.update((w, t) for t in np.flatnonzero(wanted == window[w]).tolist()
                                if must[t] is None or w in held[must[t]])
            for w, t in sorted(hits):
                self._verify(w * step, w * step + step * steps + width - 1, width, *templates[t], block, starts, ids, found)

    def _verify(self, begin, stop, width, name, wanted, tell, other, block, starts, ids, found):
        first = int(np.searchsorted(starts, begin, side="right")) - 1
        for d in range(first, len(block)):
            if starts[d] >= stop:
                break
            a, b = max(begin, starts[d]), min(stop, starts[d + 1])
            own = grams_of(ids[a:b], width)
            inside = np.isin(own, wanted)
            contained = len(np.unique(own[inside]))
            if 100 * contained >= self.threshold * len(wanted):
                places = np.flatnonzero(inside)
                match = ids[a + places[0]:a + places[-1] + width]
                if not (all(g in grams_of(match, n) for n, g in tell) and not any(g in grams_of(match, n) for n, g in other)):
                    continue
                before = found[block[d][0]].get(name, (0.0, 0))
                at = int(a - starts[d] + places[0])
                share = contained / len(wanted)
                if (share, -at) > (before[0], -before[1]):
                    found[block[d][0]][name] = (share, at)


def scan(docs: DataFrame, templates: dict = None, key: str = "doc_id", text: str = "text",
         threshold: int = THRESHOLD, collision: float = COLLISION) -> DataFrame:
    """One row per document: key, n_licenses, licenses (names in order, comma-joined), and
    of the best match containment, license and first_word (null without a match).
    """
    templates = templates or wordings()

    def fn():
        scanner = Scanner(templates, threshold, collision)

        def apply(texts):
            found = scanner(texts)
            best = [min(((-s, n, at) for n, (s, at) in f.items()), default=None) for f in found]
            return {"n_licenses": pa.array([len(f) for f in found], pa.int64()),
                    "licenses": pa.array([",".join(sorted(f)) for f in found], pa.string()),
                    "containment": pa.array([None if b is None else -b[0] for b in best], pa.float64()),
                    "license": pa.array([None if b is None else b[1] for b in best], pa.string()),
                    "first_word": pa.array([None if b is None else b[2] for b in best], pa.int64())}
        return apply

    return per_text(docs, text, fn, "n_licenses long, licenses string, containment double, license string, "
                    "first_word long", {key: col(key)})


@query("op6_license_scan")
def op6(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
