"""License scan: winnowed fingerprints find candidate templates, banded alignment reports spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from launchlens.llm import words as W

#: The MIT license up to its warranty clause, which `mit` stands for, and the liability clause that makes it whole.
_MIT_FIRST = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_MIT_REST = (
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution. "
)


def _bsd_end(by: str, owner: str) -> str:
    return (
        f"THIS SOFTWARE IS PROVIDED BY {by} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        f"PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {owner} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )


_BSD_NOW = _bsd_end("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS")


def _gnu(name: str, version: str, site: str = "https://www.gnu.org/licenses/") -> str:
    """The notice of a license of the GNU family, as its appendix gives it."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <{site}>."
    )


#: Fixed values: (name, text) of short notices and standard license texts or notices, each whole, without the line of its copyright holder.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("mit", _MIT_FIRST),
    ("mit-whole", _MIT_FIRST + _MIT_REST),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0-or-later", _gnu("General Public License", "3")),
    ("lgpl-3.0-or-later", _gnu("Lesser General Public License", "3")),
    ("agpl-3.0-or-later", _gnu("Affero General Public License", "3")),
    ("bsd-2-clause", _BSD_HEAD + _BSD_1_2 + _BSD_NOW),
    (
        "bsd-3-clause",
        _BSD_HEAD
        + _BSD_1_2
        + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission. " + _BSD_NOW,
    ),
    (
        "bsd-4-clause",
        _BSD_HEAD
        + _BSD_1_2
        + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
        "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission. " + _bsd_end("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs "
        "and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
)
SCHEMA = "license string, coverage double, n_matched long, n_template long, start_word long, end_word long, start_char long, end_char long"
_WORD = W.byte_classes("tokens")


def tokens(texts: list[bytes]) -> W.Words:
    """Letter-and-digit runs, A-Z lower-cased; marks are left out."""
    w = W.split(texts, "tokens", lower=True)
    keep = _WORD[w.data[w.start]] == 1 if len(w.start) else np.empty(0, bool)
    return W.Words(w.data, w.start[keep], w.end[keep], w.doc[keep], w.hash[keep], w.n_docs)


def winnow(grams: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the rightmost least gram of every window of one group's grams.

    Two texts that share `window` grams in a row share a fingerprint there. A group with fewer
    grams than a window gives its least one.
    """
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    out = []
    width = min(window, n)
    best = np.arange(n - width + 1)
    for j in range(1, width):
        at = np.arange(j, n - width + 1 + j)
        best = np.where(grams[at] <= grams[best], at, best)
    inside = group[: n - width + 1] == group[width - 1 :]
    out.append(best[inside])
    for k in np.flatnonzero(np.diff(edges) < window):
        lo, hi = edges[k], edges[k + 1]
        out.append(np.array([hi - 1 - int(np.argmin(grams[lo:hi][::-1]))]))
    return np.unique(np.concatenate(out))


class Index:
    """Inverted index from fingerprint to (template, place of its gram)."""

    def __init__(self, templates: Sequence[tuple[str, str]], k: int, window: int):
        self.names, self.k, self.window = [n for n, _ in templates], k, window
        w = tokens([t.encode() for _, t in templates])
        b = w.bounds()
        self.words = [w.hash[b[d] : b[d + 1]] for d in range(len(templates))]
        doc, grams = W.shingles(w, k, short=False)
        first = np.searchsorted(doc, np.arange(len(templates)))
        at = winnow(grams, doc, window)
        order = np.argsort(grams[at], kind="stable")
        at = at[order]
        self.prints, self.template, self.place = grams[at], doc[at], at - first[doc[at]]
        self.sizes = np.bincount(self.template, minlength=len(templates))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in grams, row of the index) of every equal pair."""
        lo, hi = np.searchsorted(self.prints, grams, "left"), np.searchsorted(self.prints, grams, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(grams)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return at, row


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last word of text) of the best alignment with diagonals within `band` of `shift`.

    A longest common subsequence inside the band: cell (i, d) pairs template word i with text word
    i + shift + d. Each row is one pass over the 2 * band + 1 diagonals. The span runs
    from the first to the last matched word; of equal scores the one that starts last is kept.
    """
    m, n, width = len(template), len(text), 2 * band + 1
    none = -1
    score, start, stop = np.zeros(width + 2, np.int64), np.full(width + 2, none), np.full(width + 2, none)
    for i in range(m):
        at = i + shift + np.arange(-band, band + 1)
        same = np.zeros(width, bool)
        ok = (at >= 0) & (at < n)
        same[ok] = text[at[ok]] == template[i]
        # going down a row on the same text word means one diagonal less: cell d comes from d (a pair) or d + 1 (template word left out)
        up_s, up_a, up_z = score[2:], start[2:], stop[2:]
        s, a, z = score[1:-1] + same, np.where(same & (start[1:-1] == none), at, start[1:-1]), np.where(same, at, stop[1:-1])
        better = up_s > s
        s, a, z = np.where(better, up_s, s), np.where(better, up_a, a), np.where(better, up_z, z)
        # text words left out: the best so far on smaller diagonals
        lead = np.maximum.accumulate(s * (width + 1) - np.arange(width))
        src = np.searchsorted(lead, lead, "left") if width else lead
        src = np.where(s >= s[src], np.arange(width), src)
        s, a, z = np.maximum(s, s[src]), a[src], z[src]
        score[1:-1], start[1:-1], stop[1:-1] = s, a, z
    best = int(score.max())
    if not best:
        return 0, 0, -1
    rows = np.flatnonzero(score == best)
    k = rows[np.argmin(stop[rows] - start[rows])]
    return best, int(start[k]), int(stop[k])


def scan_text(words: np.ndarray, grams: np.ndarray, index: Index, band: int, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, last word) of every place where enough of a template stands, without overlaps.

    A candidate is a diagonal on which, within the band, a tenth of the template's fingerprints stand. It is
    aligned narrowly, so that copies next to each other stay apart, and in the whole band if words differ.
    """
    at, row = index.hits(grams)
    if not len(at):
        return []
    found = []
    template, diagonal = index.template[row], at - index.place[row]
    order = np.lexsort((diagonal, template))
    template, diagonal = template[order], diagonal[order]
    cut = np.flatnonzero((np.diff(template) != 0) | (np.diff(diagonal) > 2)) + 1
    for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(order)]]), strict=True):
        t = int(template[lo])
        m = len(index.words[t])
        near = (template == t) & (np.abs(diagonal - diagonal[lo]) <= band)
        if near.sum() < 0.1 * index.sizes[t]:
            continue
        shift = int(np.median(diagonal[lo:hi]))
        n, a, z = align(index.words[t], words, shift, 2)
        if n < m:
            n, a, z = align(index.words[t], words, shift, band)
        if n and n >= coverage * m:
            found.append((n, -(z - a), t, a, z))
    found.sort(key=lambda x: (-x[0], -x[1], x[3], x[2]))
    kept: list[tuple[int, int, int, int]] = []
    for n, _, t, a, z in found:
        if all(z < b or a > y for _, _, b, y in kept):
            kept.append((t, n, a, z))
    return sorted(kept, key=lambda x: (x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = 3, window: int = 2, band: int = 12, coverage: float = 0.8) -> DataFrame:
    """One row per place of a document where a template stands: doc_id and the columns of SCHEMA.

    coverage is matched template words over all of them, n_matched the count; the span is given
    in words (letter-and-digit runs, end inclusive) and in bytes of the UTF-8 text (end exclusive). Where spans
    overlap, the one with the most matched words stays, then the tighter one, then the first template.

    Any window of k + window - 1 equal words between a text and a template is found by a shared
    fingerprint. The index holds the templates only, a fixed small table that travels with the code;
    documents are read whole, each by itself, and nothing is shuffled.

    Null and empty texts and texts without a match give no rows; null ids are kept; repeated
    rows give repeated rows; an empty table gives no rows; other columns are ignored. Templates with
    fewer than k words never match.
    """
    source = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).where("length(_text) > 0")
    kind = source.schema["doc_id"].dataType.simpleString()
    named = list(templates)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(named, k, window)
        for batch in batches:
            out = []
            for rows in W.blocks(W.arrow_rows([batch], "doc_id", "_text"), 1):
                w = tokens([r[1] for r in rows])
                b = w.bounds()
                doc, grams = W.shingles(w, k, short=False)
                known = np.isin(grams, index.prints)
                if not known.any():
                    continue
                g = np.searchsorted(doc, np.arange(len(rows) + 1))
                first = np.concatenate([[0], np.cumsum([len(r[1]) + 1 for r in rows])])
                prints = np.zeros(len(grams), bool)
                prints[winnow(grams, doc, window)] = True
                none = np.uint64(0)
                chosen = np.where(prints & known, grams, none)
                for d in np.unique(doc[prints & known]):
                    words = w.hash[b[d] : b[d + 1]]
                    for t, n, a, z in scan_text(words, chosen[g[d] : g[d + 1]], index, band, coverage):
                        out.append((rows[d][0], index.names[t], n / len(index.words[t]), n, len(index.words[t]), a, z, int(w.start[b[d] + a] - first[d]), int(w.end[b[d] + z] - first[d])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            types = [batch.schema.field(0).type, pa.string(), pa.float64(), *[pa.int64()] * 6]
            names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return source.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
