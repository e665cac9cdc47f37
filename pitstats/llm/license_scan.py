"""Licence scan by a positional index of rare licence words.

Every template is a run of words, with key phrases that must stand in the file. The templates' words are counted over
all files. The index posts each licence word's positions in the templates. A file looks up the licence words that it
has, those of the highest IDF first, for each template that they can still make up: as many as it takes until the rest
alone can't reach the share of weight that a match needs, so a match always meets some. Each occurrence of such a word
less its posted position is where the template would start; postings are intersected by keeping starts on which the
words' weights together reach what a match must have of them. Those are verified word by word, and their key phrases.
A base phrase must stand there whole; a longer template needs its share of weight, with up to DRIFT words left out or
put in, and all of its key phrases.

Defined results: a null or empty text has no words, no places and no labels; texts may be of any length (one text's
words are held at a time); a phrase that overlaps itself counts at each start; labels of equal places are all given;
words of equal IDF are looked up in the order of their bytes; repeated rows each give their own row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.llm.common import bytes_of, doc_columns, in_batches


@dataclass(frozen=True)
class Template:
    """`exact`: the words must stand consecutively; else `least` of the weight must agree and all `keys` be present."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...] = ()
    exact: bool = True
    least: float = 0.7


def _w(text: str) -> tuple[str, ...]:
    return tuple(text.split())


#: Phrases whose places are counted.
BASE = (
    Template("cc-by", _w("cc by")),
    Template("gpl", _w("general public license")),
    Template("reserved", _w("all rights reserved")),
)

_MIT = _w(
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
    " and this permission notice shall be included in all copies or substantial portions of the software"
)
_BSD = _w(
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met redistributions of source code must retain the above copyright notice this list of"
    " conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"
    " this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
    " distribution"
)
_APACHE = _w(
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
    " license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by"
    " applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
    " without warranties or conditions of any kind either express or implied"
)


def _gnu(name: str) -> tuple[str, ...]:
    return _w(
        f"this program is free software you can redistribute it and or modify it under the terms of the gnu {name} license"
        " as published by the free software foundation either version 3 of the license or at your option any later version"
    )


_WARRANTY = _w("the software is provided as is without warranty of any kind express or implied")
_ISC = _w(
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    " provided that the above copyright notice and this permission notice appear in all copies"
)
_MPL = _w(
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not"
    " distributed with this file you can obtain one at"
)
_UNLICENSE = _w(
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use"
    " compile sell or distribute this software either in source code form or as a compiled binary for any purpose"
)
_ZLIB = _w(
    "in no event will the authors be held liable for any damages arising from the use of this software permission is"
    " granted to anyone to use this software for any purpose including commercial applications and to alter it and"
    " redistribute it freely subject to the following restrictions"
)

#: Labels that the scan adds of its own: whole notices, their first sentences, and short forms.
MORE = (
    Template("mit", _MIT, (_w("free of charge"),), False),
    Template("mit", _MIT[:17], (_w("free of charge"), _w("any person obtaining a copy")), False),
    Template("apache-2.0", _APACHE, (_w("apache license"),), False),
    Template("apache-2.0", _APACHE[:8], (_w("apache license"),), False),
    Template("bsd", _BSD, (_w("source and binary forms"),), False),
    Template("bsd", _BSD[:14], (_w("source and binary forms"),), False),
    Template("gpl-notice", _gnu("general public"), (_w("general public license"), _w("free software")), False),
    Template("lgpl", _gnu("lesser general public"), (_w("lesser general public license"),), False),
    Template("lgpl", _w("gnu lesser general public license")),
    Template("agpl", _gnu("affero general public"), (_w("affero general public license"),), False),
    Template("agpl", _w("gnu affero general public license")),
    Template("mpl", _MPL, (_w("mozilla public license"),), False),
    Template("mpl", _w("subject to the terms of the mozilla public license"), (_w("mozilla public license"),), False),
    Template("isc", _ISC, (_w("for any purpose with or without fee"),), False),
    Template("unlicense", _UNLICENSE, (_w("free and unencumbered software"),), False),
    Template("public-domain", _w("released into the public domain"), (_w("public domain"),), False),
    Template("zlib", _ZLIB, (_w("permission is granted to anyone"),), False),
    Template("no-warranty", _WARRANTY, (_w("without warranty of any kind"),), False),
    Template("cc-by-sa", _w("cc by sa")),
    Template("cc-by-nc", _w("cc by nc")),
    Template("cc0", _w("cc0")),
)
#: Words that may be left out or put in, of a longer template; and the share of a template's weight that is looked up.
DRIFT, LOOKED_UP = 4, 0.6

#: A-Z to a-z; every ASCII byte that is no letter or digit to a blank; the rest is kept.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """The words of UTF-8 bytes: runs of digits, a-z after lower-casing, and all bytes from 0x80 on."""
    return data.translate(_FOLD).split()


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word occurs, over all documents, and how many there are.

    Tasks send one count per word and batch; at most one row per template word reaches the driver.
    """
    wanted = frozenset(w.encode() for w in words)

    def make():
        def step(batch):
            counts = Counter()
            for data in bytes_of(batch):
                counts.update(wanted.intersection(words_of(data)))
            counts[b""] = batch.num_rows
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        return step

    rows = in_batches(docs.select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


class Scanner:
    """The positional index of some templates under given document frequencies."""

    def __init__(self, templates: tuple[Template, ...], frequencies: dict[bytes, int], n_docs: int):
        self.templates = [(t, [w.encode() for w in t.words], [[w.encode() for w in k] for k in t.keys]) for t in templates]
        self.idf = {
            w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 0.5)) + 1.0 for _, words, _ in self.templates for w in words
        }
        #: word -> template -> its positions
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.total: list[float] = []
        for number, (_, words, _) in enumerate(self.templates):
            for position, word in enumerate(words):
                self.postings[word][number].append(position)
            self.total.append(sum(self.idf[w] for w in words))
        self.licence_words = frozenset(self.postings)
        self.rank = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (-self.idf[w], w)))}

    def _weight(self, word: bytes, number: int) -> float:
        return self.idf[word] * len(self.postings[word][number])

    def _lookups(self, number: int, present: list[bytes]) -> tuple[list[bytes], float] | None:
        """The file's words to look up for a template, and the weight of them that any match has; None: no match."""
        template, words, _ = self.templates[number]
        total, own = self.total[number], [w for w in present if number in self.postings[w]]
        if template.exact:
            return (own[:2], 0.0) if len(own) == len(set(words)) else None
        lost = (1 - template.least) * total
        if sum(self._weight(w, number) for w in own) < total - lost - 1e-9:
            return None
        chosen, weight = [], 0.0
        for word in own:
            if weight >= LOOKED_UP * total:
                break
            chosen.append(word)
            weight += self._weight(word, number)
        return chosen, weight - lost - 1e-9

    def _starts(self, number: int, chosen: list[bytes], needed: float, at: dict[bytes, list[int]]) -> list[int]:
        """Starts on which enough of the words looked up agree."""
        template, _, _ = self.templates[number]
        if template.exact:
            sets = [{p - q for p in at[w] for q in self.postings[w][number]} for w in chosen]
            return sorted(s for s in set.intersection(*sets) if s >= 0)
        met = sorted((p - q, q, self.idf[w]) for w in chosen for p in at[w] for q in self.postings[w][number])
        out, first, held, weight = [], 0, Counter(), 0.0
        for start, q, idf in met:
            while met[first][0] < start - DRIFT:
                held[met[first][1]] -= 1
                weight -= met[first][2] * (not held[met[first][1]])
                first += 1
            weight += idf * (not held[q])
            held[q] += 1
            if weight >= needed and (not out or out[-1] < start):
                out.append(start)
        return out

    def _share(self, number: int, words: list[bytes], start: int) -> float:
        """The most of a template's weight that stands in order, up to DRIFT words before the start or as many after."""
        _, own, _ = self.templates[number]
        wide = 2 * DRIFT + 1
        row = [0.0] * (wide + 1)  # best up to this template word, on diagonals from start - DRIFT on
        for i, word in enumerate(own):
            new, weight = [0.0] * (wide + 1), self.idf[word]
            for j in range(wide):
                place = start - DRIFT + i + j
                best = row[j] + weight if 0 <= place < len(words) and words[place] == word else row[j]
                left = new[j - 1] if j else 0.0  # a word of the file is put in
                new[j] = max(best, row[j + 1] if j + 1 < wide else 0.0, left)
            row = new
        return max(row) / self.total[number]

    def places(self, words: list[bytes]) -> dict[int, dict[int, float]]:
        """Template -> start -> share of its weight, for verified starts only."""
        present = self.licence_words.intersection(words)
        if not present:
            return {}
        present = sorted(present, key=self.rank.__getitem__)
        asked = {n: found for n in range(len(self.templates)) if (found := self._lookups(n, present)) is not None}
        if not asked:
            return {}
        at: dict[bytes, list[int]] = {w: [] for chosen, _ in asked.values() for w in chosen}
        for i, word in enumerate(words):
            if word in at:
                at[word].append(i)
        out: dict[int, dict[int, float]] = defaultdict(dict)
        for number, (chosen, needed) in asked.items():
            template, own, keys = self.templates[number]
            for start in self._starts(number, chosen, needed, at):
                if template.exact:
                    if words[start : start + len(own)] == own:
                        out[number][start] = 1.0
                    continue
                share = self._share(number, words, start)
                window = words[max(0, start - DRIFT) : start + len(own) + DRIFT]
                if share >= template.least and all(
                    any(window[i : i + len(k)] == k for i in range(len(window) - len(k) + 1)) for k in keys
                ):
                    out[number][max(0, start)] = min(1.0, share)
        return out


def scan_documents(
    documents: DataFrame,
    base: tuple[Template, ...] = BASE,
    more: tuple[Template, ...] = MORE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start. The score
    is the largest share of a template's weight that was verified, less a tenth where no base phrase stands; 0 without
    any label.
    """
    docs = doc_columns(documents, id_col, text_col)
    templates = (*base, *more)
    frequencies, n_docs = document_frequencies(docs, sorted({w for t in templates for w in t.words}))

    def make():
        scanner = Scanner(templates, frequencies, n_docs)

        def step(batch):
            rows = []
            for data in bytes_of(batch):
                words = words_of(data)
                found = scanner.places(words)
                starts = [s for n, at in found.items() if n < len(base) for s in at]
                base_labels = sorted({templates[n].label for n in found if n < len(base)})
                labels = sorted({templates[n].label for n in found})
                score = max((x for at in found.values() for x in at.values()), default=0.0)
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(base_labels), ",".join(labels), score if starts else score * 0.9,
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

        return step

    return in_batches(
        docs,
        make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
