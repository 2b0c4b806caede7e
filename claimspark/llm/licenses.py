"""Licence scans with a positional index of rare licence words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_set, prepare, slices, span_hashes, words

WORD_BYTES = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
# fixed values: phrases that stand for a licence by themselves
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# fixed values: passages of licence texts and headers, and the phrase that must stand in each at its place
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1"),
)
# fixed values: whole texts of licences, as their files print them, and phrases that must all stand in each at their places
WHOLE_TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
    including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
    WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
     ("this permission notice shall be included in all copies", "the software is provided as is without warranty of any kind")),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.""",
     ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("bsd", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
     ("to endorse or promote products derived from this software",)),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
    copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
    FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
    OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
     ("this permission notice appear in all copies", "the author disclaims all warranties")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
    anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
    source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
     ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such")),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
    compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
     ("anyone is free to copy modify publish use compile sell or distribute this software",)),
)
#: The share of a template's weight that must line up for a label.
ACCEPT = 0.6
#: Starts of a template that are weighed at once.
BLOCK = 1 << 18


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


#: (label, words, phrases) of all passages and whole texts.
LICENSES = [(label, template_words(text), [template_words(p) for p in phrases]) for label, text, phrases in (*((x, t, (p,)) for x, t, p in TEMPLATES), *WHOLE_TEXTS)]


def _hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


VOCABULARY = sorted({w for _, text, _ in LICENSES for w in text})
HASH_OF = {w: _hash(w) for w in VOCABULARY}
SORTED = np.array(sorted(HASH_OF.values()), np.uint64)
WORD_AT = [{h: w for w, h in HASH_OF.items()}[int(x)] for x in SORTED]
PHRASE_HASHES = [(np.array([HASH_OF[w] for w in p.split()], np.uint64), label) for p, label in PHRASES]


def _known(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the licence words among the hashes, and their numbers in the vocabulary."""
    at = np.minimum(np.searchsorted(SORTED, h), len(SORTED) - 1)
    places = np.flatnonzero(SORTED[at] == h)
    return places, at[places]


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, offsets = words(low, at, WORD_BYTES)
    return span_hashes(low, starts, ends), offsets


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """IDF over all documents of each word of the licence texts; the vocabulary is fixed, so that the result has its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(SORTED), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, at in slices(batch.column(0)):
                h, offsets = _hashed(data, at)
                places, word = _known(h)
                row = np.searchsorted(offsets, places, "right") - 1
                seen += np.bincount(np.unique(row * len(SORTED) + word) % len(SORTED), minlength=len(SORTED))
        yield pa.RecordBatch.from_pydict({"word": [-1, *range(len(SORTED))], "n": [n, *seen.tolist()]})

    got = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.get(-1, 0)
    return {WORD_AT[k]: float(np.log((total + 1) / (got.get(k, 0) + 1))) + 1e-3 for k in range(len(SORTED))}


class Index:
    """Postings (word -> places in templates) of each template's rarest words by IDF.

    A template's words are posted from the rarest down until those that are left weigh less than a template may lack: wherever a share of ACCEPT lines up, some
    posted word stands at its place. What the posted words must weigh together at a start, `need`, is what they weigh less that lack.
    """

    def __init__(self, idf: dict[str, float]) -> None:
        self.weight = np.array([idf[w] for w in WORD_AT])
        number = {w: k for k, w in enumerate(WORD_AT)}
        self.templates = []
        for label, text, phrases in LICENSES:
            coded = np.array([number[w] for w in text])
            keys = [(next(i for i in range(len(text)) if text[i : i + len(p)] == p), [number[w] for w in p]) for p in phrases]
            weight = self.weight[coded]
            rarest = np.argsort(-weight, kind="stable")
            lack = (1 - ACCEPT) * weight.sum()
            left = weight.sum() - np.cumsum(weight[rarest])
            posted = rarest[: int(np.argmax(left < lack * (1 - 1e-9))) + 1]  # nothing is left at the end, so that one is found
            self.templates.append((label, coded, keys, posted, float(weight[posted].sum() - lack * (1 + 1e-9))))

    def scan(self, places: np.ndarray, numbers: np.ndarray, offsets: np.ndarray) -> dict[int, dict[str, float]]:
        """Row -> label -> share of the template's weight that lines up, of the licence words of a slice.

        Posted words meet at starts of templates (place in the text less place in the template), block by block; starts at which they weigh enough are
        looked at: all key phrases must stand at their places, and the whole template must reach its share.
        """
        found: dict[int, dict[str, float]] = defaultdict(dict)
        size = int(offsets[-1])
        code = np.full(size, -1)
        code[places] = numbers
        order = np.argsort(numbers, kind="stable")
        bounds = np.searchsorted(numbers[order], np.arange(len(WORD_AT) + 1))
        by_word = [places[order[lo:hi]] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for label, coded, keys, posted, need in self.templates:
            if not any(len(by_word[w]) for w in coded[posted]):
                continue
            for first in range(1 - len(coded), size, BLOCK):
                together = np.zeros(min(BLOCK, size - first))
                for p in posted.tolist():
                    hits = by_word[coded[p]]
                    lo, hi = np.searchsorted(hits, (first + p, first + p + len(together)))
                    together[hits[lo:hi] - p - first] += self.weight[coded[p]]  # a place is hit once
                start = np.flatnonzero(together >= need) + first
                if len(start):
                    for row, share in self._held(start, coded, keys, code, offsets):
                        found[row][label] = max(found[row].get(label, 0.0), share)
        return found

    def _held(self, start: np.ndarray, coded: np.ndarray, keys: list[tuple[int, list[int]]], code: np.ndarray, offsets: np.ndarray) -> list[tuple[int, float]]:
        """(row, share) of the starts at which the template's key phrases stand within one text and its share is reached."""
        at = start + keys[0][0]
        start = start[(at >= 0) & (at < len(code))]
        row = np.searchsorted(offsets, start + keys[0][0], "right") - 1

        def stands(place: int, word: int) -> np.ndarray:
            at = start + place
            inside = (at >= offsets[row]) & (at < offsets[row + 1])
            return inside & (code[np.where(inside, at, 0)] == word)

        for first, key in keys:
            for place, word in enumerate(key, first):
                ok = stands(place, word)
                start, row = start[ok], row[ok]
        share = np.zeros(len(start))
        for place, word in enumerate(coded.tolist()):
            share += self.weight[word] * stands(place, word)
        share /= self.weight[coded].sum()
        best: dict[int, float] = {}
        for r, x in zip(row[share >= ACCEPT].tolist(), share[share >= ACCEPT].tolist(), strict=True):
            best[r] = max(best.get(r, 0.0), x)
        return list(best.items())


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document.

    Words are runs of 0-9, a-z and bytes beyond ASCII after A-Z is lower-cased. Base: the places where a phrase of PHRASES stands. Beyond it,
    the file's rarest licence words, by IDF over all documents, are looked up in an index of licence texts; postings that agree on where a text starts are added
    up, and a text whose key phrases all stand at their places and of whose weight ACCEPT lines up there gives its label, with that share. The score is
    the largest share, 1 for a base label. A text is read whole, whatever its length, in memory of a few times its words. Null and empty texts have no words, no labels and score 0; repeated rows come out as often as they
    came; other columns are ignored; no rows give no rows.
    """
    prepare(docs.sparkSession)
    index = Index(inverse_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for _, _, data, at in slices(batch.column(1)):
                h, offsets = _hashed(data, at)
                n = np.diff(offsets)
                base: dict[int, list[tuple[int, str]]] = defaultdict(list)
                for phrase, label in PHRASE_HASHES:
                    k = len(phrase)
                    hits = np.flatnonzero(np.logical_and.reduce([h[i : len(h) - k + 1 + i] == phrase[i] for i in range(k)])) if len(h) >= k else np.zeros(0, np.int64)
                    row = np.searchsorted(offsets, hits, "right") - 1
                    for r, i in zip(row.tolist(), hits.tolist(), strict=True):
                        if i + k <= offsets[r + 1]:
                            base[r].append((i - int(offsets[r]), label))
                places, numbers = _known(h)
                more = index.scan(places, numbers, offsets)
                for r in range(len(n)):
                    own, found = base.get(r, []), more.get(r, {})
                    labels = {x for _, x in own}
                    out["n_words"].append(int(n[r]))
                    out["n_base"].append(len(own))
                    out["first_word"].append(min(own)[0] if own else None)
                    out["last_word"].append(max(own)[0] if own else None)
                    out["base_labels"].append(",".join(sorted(labels)))
                    out["labels"].append(",".join(sorted(labels | set(found))))
                    out["score"].append(1.0 if own else min(1.0, max(found.values(), default=0.0)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["doc_id", *out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
