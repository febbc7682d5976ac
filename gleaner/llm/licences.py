"""Licence scans by a positional rare-token index of licence templates.

The index lists, for every word of the templates (whole licences of the common
families, file headers and short notices), its (template, position) postings.  A
word's inverse document frequency is counted over all documents of the scan.  For
each template whose mandatory key phrases' words a file has, the file's ``RAREST``
highest-IDF words of that template are looked up; postings that agree on the
relative position (document position minus template position, drifting by ``DRIFT``
words at most from one to the next) make a candidate, which counts only if the key
phrases stand in that place and ``COVERAGE`` of its words do too.  The score is the
largest share of a template found, 0.5 at least where a plain phrase is found.
Plain phrases (``BASE_PHRASES``) are found everywhere.

Cases: null and empty texts have no words and score 0; repeated rows are
separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.textkit import Chunk, chunks, lean, small_batches, string_rows

# Phrases and labels that every scan reports.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short notices as their licences word them, and the phrases that must be present.
NOTICES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0", ("except in compliance with the license", "apache org licenses")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted", ("for any purpose with or without fee",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
)

_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU = (
    " as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This "
    "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. You should have "
    "received a copy of the GNU {name} General Public License along with this program.")


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License" + _GNU.format(v=version, name=name)


# Whole licences and file headers of the common families.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software." + _WARRANTY,
     ("permission is hereby granted free of charge", "this permission notice shall be included")),
    ("bsd-2-clause", _BSD_CLAUSES + _BSD_WARRANTY, ("redistributions in binary form must reproduce", "even if advised of the possibility of such damage")),
    ("bsd-3-clause", _BSD_CLAUSES + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission." + _BSD_WARRANTY,
     ("redistributions in binary form must reproduce", "used to endorse or promote products")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
     "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
     "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
     "USE OR PERFORMANCE OF THIS SOFTWARE.", ("for any purpose with or without fee", "disclaims all warranties")),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
     "software must not be misrepresented; you must not claim that you wrote the original software.",
     ("must not be misrepresented", "redistribute it freely")),
    ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or "
     "organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
     "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
     "third-parties to whom the Software is furnished to do so", ("boost software license", "person or organization")),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means.", ("free and unencumbered software", "compiled binary")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
     "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
     "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
     ("apache license version 2 0", "governing permissions and limitations")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license v 2 0", "copy of the mpl")),
    ("gpl-2.0", _gnu("", "2"), ("gnu general public license", "either version 2 of the license")),
    ("gpl-3.0", _gnu("", "3"), ("gnu general public license", "either version 3 of the license")),
    ("agpl-3.0", _gnu("Affero", "3"), ("gnu affero general public license", "either version 3 of the license")),
    ("lgpl-2.1", _gnu("Lesser", "2.1"), ("gnu lesser general public license", "either version 2 1 of the license")),
    ("lgpl-3.0", _gnu("Lesser", "3"), ("gnu lesser general public license", "either version 3 of the license")),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION. 0. You just DO "
     "WHAT THE FUCK YOU WANT TO.", ("want to public license",)),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to "
     "the public domain worldwide. This software is distributed without any warranty.", ("dedicated all copyright", "public domain worldwide")),
)

RAREST, DRIFT, COVERAGE = 12, 2, 0.6


def split_words(text: str) -> list[bytes]:
    chunk = Chunk([text.encode().lower()])
    starts, ends, _ = chunk.words()
    raw = chunk.buf.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Index:
    """The positional index; small, and rebuilt in each worker from its templates and the words' frequencies."""

    def __init__(self, notices=NOTICES + TEMPLATES, phrases=BASE_PHRASES, df: dict[int, int] | None = None, n_docs: int = 0):
        self.labels = [x[0] for x in notices]
        self.words = [split_words(x[1]) for x in notices]
        self.keys = [[split_words(k) for k in x[2]] for x in notices]
        self.base = [(split_words(p), label) for p, label in phrases]
        vocabulary = sorted({w for words in self.words for w in words} | {w for p, _ in self.base for w in p})
        self.at = {w: i for i, w in enumerate(vocabulary)}
        joined = Chunk(vocabulary)
        hashes = joined.span_hash(joined.starts, joined.stops - 1)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        #: a word in few documents weighs much; without counts all weigh alike
        self.idf = np.array([math.log((n_docs + 1) / ((df or {}).get(i, 0) + 1)) for i in range(len(vocabulary))])
        self.own = [sorted({self.at[w] for w in words}) for words in self.words]
        self.key_ids = [{self.at[w] for k in keys for w in k} for keys in self.keys]
        self.anchor = [max(ids, key=lambda i: (self.idf[i], i)) for ids in self.key_ids]
        self.places = [{i: [q for q, w in enumerate(words) if self.at[w] == i] for i in own} for words, own in zip(self.words, self.own, strict=True)]
        self.slack = DRIFT

    def vocabulary_ids(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = chunk.span_hash(starts, ends)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, self.order[i], -1)

    def candidates(self, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, template, lowest and highest offset) where enough of the document's rarest words agree on their relative position.

        The arguments are the documents, positions and ids of the words of the vocabulary, in order.
        """
        out: list[tuple[int, int, int, int]] = []
        for t, anchor in enumerate(self.anchor):
            for d in np.unique(doc[ids == anchor]).tolist():
                a, z = np.searchsorted(doc, [d, d + 1])
                own, at = ids[a:z], pos[a:z]
                present = set(own.tolist())
                if not self.key_ids[t] <= present:
                    continue
                rare = sorted(present.intersection(self.own[t]), key=lambda i: (-self.idf[i], i))[:RAREST]
                need = max(1, len(rare) // 2)
                offsets = np.concatenate([np.subtract.outer(at[own == i], self.places[t][i]).ravel() for i in rare])
                word = np.concatenate([np.repeat(i, np.count_nonzero(own == i) * len(self.places[t][i])) for i in rare])
                order = np.argsort(offsets, kind="stable")
                offsets, word = offsets[order], word[order]
                new = np.flatnonzero(np.concatenate(([True], np.diff(offsets) > self.slack)))
                for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(offsets)], strict=True):
                    if hi - lo >= need and len(set(word[lo:hi].tolist())) >= need:
                        out.append((d, t, int(offsets[lo]), int(offsets[hi - 1])))
        return out

    def verify(self, words: list[bytes], notice: int, low: int, high: int) -> float:
        """The share of the notice found in place, or 0 if a key phrase or too much is missing."""
        own, s = self.words[notice], self.slack
        a = max(0, low - s)
        window = words[a : high + len(own) + s]
        for key in self.keys[notice]:
            if not any(window[i : i + len(key)] == key for i in range(len(window) - len(key) + 1)):
                return 0.0
        hit = sum(w in words[max(0, q + low - s) : max(0, q + high + s + 1)] for q, w in enumerate(own))
        share = hit / len(own)
        return share if share >= COVERAGE else 0.0


def scan_texts(index: Index, encoded: list[bytes]) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
    chunk = Chunk([b.lower() for b in encoded])  # of bytes: A-Z only
    starts, ends, doc = chunk.words()
    n_words = np.bincount(doc, minlength=chunk.n)
    base_at = np.cumsum(n_words) - n_words
    ids = index.vocabulary_ids(chunk, starts, ends)
    raw = chunk.buf.tobytes()
    places: dict[int, list[int]] = defaultdict(list)
    base_labels: dict[int, set[str]] = defaultdict(set)
    for phrase, label in index.base:
        first = np.flatnonzero(ids == index.at[phrase[0]])
        for i in first[first + len(phrase) <= len(ids)].tolist():
            j = i + len(phrase) - 1
            if doc[j] == doc[i] and all(raw[starts[i + k] : ends[i + k]] == w for k, w in enumerate(phrase)):
                places[doc[i]].append(int(i - base_at[doc[i]]))
                base_labels[doc[i]].add(label)
    known = np.flatnonzero(ids >= 0)
    best: dict[int, float] = defaultdict(float)
    labels: dict[int, set[str]] = defaultdict(set)
    for d, t, low, high in index.candidates(doc[known], known - base_at[doc[known]], ids[known]):
        a = int(base_at[d])
        lo = max(0, low - 2 * index.slack)
        hi = min(int(n_words[d]), high + len(index.words[t]) + 2 * index.slack)
        own = [raw[starts[a + i] : ends[a + i]] for i in range(lo, hi)]
        if share := index.verify(own, t, low - lo, high - lo):
            labels[d].add(index.labels[t])
            best[d] = max(best[d], share)
    out = []
    for d in range(chunk.n):
        if (at := places.get(d)) or d in labels:
            every = sorted(base_labels[d] | labels[d])
            out.append((int(n_words[d]), len(at or ()), min(at) if at else None, max(at) if at else None,
                        ",".join(sorted(base_labels[d])), ",".join(every), max(best[d], 0.5 if at else 0.0)))
        else:
            out.append((int(n_words[d]), 0, None, None, "", "", 0.0))
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def word_frequencies(docs: DataFrame, notices, phrases) -> tuple[dict[int, int], int]:
    """In how many documents each word of the vocabulary is, and the number of documents."""

    @lean
    def count(batches):
        index, n_docs = Index(notices, phrases), 0
        df = np.zeros(len(index.at), np.int64)
        for batch in batches:
            for _, texts in string_rows(batch):
                for _, held in chunks(texts):
                    chunk = Chunk([b.lower() for b in held])
                    starts, ends, doc = chunk.words()
                    ids = index.vocabulary_ids(chunk, starts, ends)
                    pairs = np.unique(doc[ids >= 0] * np.int64(len(df)) + ids[ids >= 0])
                    df += np.bincount(pairs % len(df), minlength=len(df))
                    n_docs += chunk.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate(([n_docs], df)))], names=["word", "n"])

    made = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the vocabulary
    found = {r["word"]: r["n"] for r in made}
    return found, found.pop(-1, 0)


def scan_licences(docs: DataFrame, notices=NOTICES + TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """One row per document with the licence phrases and templates in its whole text."""

    small_batches(docs.sparkSession)
    df, n_docs = word_frequencies(docs, notices, phrases)

    @lean
    def scan(batches):
        index = Index(notices, phrases, df, n_docs)
        for batch in batches:
            rows: list[tuple] = []
            for _, texts in string_rows(batch):
                for _, held in chunks(texts):
                    rows += scan_texts(index, held)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
