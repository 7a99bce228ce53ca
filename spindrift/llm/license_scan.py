"""Licence scans with a positional index of rare tokens.

Templates are licence texts and notices, with phrases that must stand in them verbatim. The index holds every template's
postings: for each word, in which templates and at which positions it stands. A file's own licence words are ranked by IDF
over the whole corpus and looked up from the rarest on. Each place of such a word and each of its postings give a place of
the template in the file. There the template's postings are intersected with the file's by relative position, and a place
counts if the words found carry enough of the template's IDF and every mandatory phrase stands at its own position. Lookups
for a template end when the words not yet looked up could not carry that share by themselves, so no place is missed.

``PHRASES`` are templates too, of which every word must be found. Words are those of ``WORD_BYTES``: digits, a-z (A-Z
lower-cased) and all beyond ASCII. Defined cases: a null or empty text has no words, places or labels and score 0; overlapping
places count each; a template may begin before the text if enough of it is there, but not its mandatory phrases; repeated rows
are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.dart_minhash import WORD_BYTES, texts_of
from spindrift.llm.storage import type_of

#: Phrases and the labels that they give.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, public licence text or notice, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2",),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("gnu general public license", "either version 3 of the license"),
    ),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("gnu general public license", "either version 2 of the license"),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms",),
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("unencumbered software released into the public domain",),
    ),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)
#: The share of a template's IDF that must be found at a place.
LEAST_SHARE = 0.6
_TABLE = bytes(int(b) or 0x20 for b in WORD_BYTES)


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    #: First position and words of each mandatory phrase.
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]
    least: float
    base: bool


def _template(label: str, text: str, phrases: tuple[str, ...], least: float = LEAST_SHARE, base: bool = False) -> Template:
    words = tuple(text.encode().split())
    found = []
    for phrase in phrases:
        p = tuple(phrase.encode().split())
        found.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
    return Template(label, words, tuple(found), least, base)


TEMPLATE_LIST = [*(_template(label, phrase, (phrase,), 1.0, True) for phrase, label in PHRASES), *(_template(*t) for t in TEMPLATES)]
VOCABULARY = sorted({w for t in TEMPLATE_LIST for w in t.words})


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def document_frequencies(df: DataFrame, *, text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all documents each template word stands, and the number of documents. Each task sends one row per
    template word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = defaultdict(int), set(VOCABULARY)
        for batch in batches:
            for raw in texts_of(batch.column(0)):
                total[b""] += 1
                if raw is not None:
                    for w in known.intersection(words_of(raw.tobytes())):
                        total[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in total], "n": [*total.values()]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = df.select(F.col(text).cast("string")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word.encode(): r.n for r in rows}
    return found, found.pop(b"", 0)


class Scanner:
    def __init__(self, frequencies: dict[bytes, int], documents: int) -> None:
        self.idf = {w: math.log((documents + 1) / (frequencies.get(w, 0) + 0.5)) for w in VOCABULARY}
        self.vocabulary = frozenset(VOCABULARY)
        self.total = [sum(self.idf[w] for w in t.words) for t in TEMPLATE_LIST]
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, t in enumerate(TEMPLATE_LIST):
            for j, w in enumerate(t.words):
                self.postings[w][k].append(j)
        self.postings = {w: dict(by) for w, by in self.postings.items()}
        self.needed = [frozenset(w for _, p in t.phrases for w in p) for t in TEMPLATE_LIST]

    def _share(self, words: list[bytes], k: int, place: int) -> float:
        """The share of a template's IDF that stands at its own positions from ``place``; 0 without its phrases."""
        t = TEMPLATE_LIST[k]
        if any(place + a < 0 or tuple(words[place + a : place + a + len(p)]) != p for a, p in t.phrases):
            return 0.0
        held = zip(t.words[max(-place, 0) :], words[max(place, 0) : place + len(t.words)], strict=False)
        return sum(self.idf[a] for a, b in held if a == b) / self.total[k] if self.total[k] else 0.0

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Place (of the template's first word; may lie before the text), template and share of each verified template."""
        present = self.vocabulary.intersection(words)
        left = {}
        for k, needed in enumerate(self.needed):
            if needed <= present:
                carried = sum(self.idf[w] for w in TEMPLATE_LIST[k].words if w in present)
                if carried >= TEMPLATE_LIST[k].least * self.total[k] - 1e-9:
                    left[k] = carried
        if not left:
            return []
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                places[w].append(i)
        tried: dict[int, set[int]] = {k: set() for k in left}
        for w in sorted(present, key=lambda w: (-self.idf[w], w)):
            if not left:
                break
            for k, at in self.postings[w].items():
                if k in left:
                    tried[k].update(p - j for j in at for p in places[w])
                    left[k] -= self.idf[w] * len(at)
                    # what is left to look up could not carry a place by itself; of a place, at least this word is looked up
                    if left[k] < TEMPLATE_LIST[k].least * self.total[k] - 1e-9:
                        del left[k]
        found = ((place, k, self._share(words, k, place)) for k, anchors in tried.items() for place in sorted(anchors))
        return [x for x in found if x[2] >= TEMPLATE_LIST[x[1]].least - 1e-9 and x[2] > 0]

    def scan(self, raw: bytes) -> tuple:
        words = words_of(raw)
        found = self.matches(words)
        base = sorted((place, TEMPLATE_LIST[k].label) for place, k, _ in found if TEMPLATE_LIST[k].base)
        listed = lambda labels: ",".join(sorted(labels))
        score = min(max((s for _, _, s in found), default=0.0), 1.0)
        return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, listed({label for _, label in base}), listed({TEMPLATE_LIST[k].label for _, k, _ in found}), score


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(spark: SparkSession, df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its words, places of phrases, labels and the best match's score. One pass counts document
    frequencies over all documents, the next scans them; neither shuffles texts."""
    scanner = spark.sparkContext.broadcast(Scanner(*document_frequencies(df, text=text)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner.value.scan
        for batch in batches:
            rows = [scan(raw.tobytes() if raw is not None else b"") for raw in texts_of(batch.column(1))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)] if rows else [pa.array([], f.type) for f in _OUT]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_OUT.names])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(scanned, f"doc_id {type_of(df, key)}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
