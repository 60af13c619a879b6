"""License scans: a positional index of rare licence words.

1. The words of the licence templates are a bounded vocabulary. Spark counts in how many documents each stands;
   that gives inverse document frequencies over the whole corpus.
2. Each document's licence words are looked up in the templates' postings, those of the highest frequency weight first: a
   posting of one of a template's heavy words votes for a relative position (place in the document less place in the
   template). So many words are heavy that no position at which the template holds enough weight can do without all of them.
3. At each position voted for, the document's and the template's places of every word are intersected, with some drift;
   the share of weight that meets is the alignment's. It counts from `LEAST` on, if all the template's mandatory key
   phrases stand there too, in their order, with gaps. The score is the best share; a fixed phrase counts as a whole one.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Fixed phrases are found where their
words stand consecutively, whatever the index says.

Defined results: null or empty text has no words, labels or places, and the score 0; a text without an alignment that counts and
without a fixed phrase has the score 0 too; null or repeated doc_ids are rows like others; with no documents there are no rows; other columns are ignored. Whole texts are read; a very long one is one step.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import UPPER, plain, small_batches, steps

# Phrases that are always looked for, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed values: (label, a public notice or a usual line of it, as words; key phrases that must stand in the text, in order).
TEMPLATES = (
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license", "2 0")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted", "free of charge", "without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    ("isc", "released under the isc license", ("isc license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "hereby granted")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: The share of weight that an alignment must hold, and how far words may shift: DRIFT, or a word for each LOOSE of a longer template.
LEAST, DRIFT, LOOSE = 0.75, 2, 8

#: ASCII outside words becomes a space, A-Z a-z; bytes of other characters stay.
TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if b in UPPER else 0x20 for b in range(256))
VOCABULARY = frozenset(w.encode() for _, t, _ in TEMPLATES for w in t.split()) | frozenset(w.encode() for p in PHRASES for w in p.split())


def text_words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for text in plain(batch.column("text"), TABLE).cast(pa.binary()).to_pylist():
        yield text.split()


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary stands (at most its size in rows), and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        n = 0
        for batch in steps(batches, "text"):
            n += batch.num_rows
            for own in text_words(batch):
                for w in VOCABULARY.intersection(own):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in seen)]), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    rows = small_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return {w: found.get(w, 0) for w in VOCABULARY}, found.get(b"", 0)


class Template(NamedTuple):
    label: str
    words: dict[bytes, list[int]]  # places of each word
    length: int
    total: float  # weight of all its words
    keys: list[list[bytes]]
    drift: int


class LicenceIndex:
    """Postings of the templates' words by place, weighted by inverse document frequency."""

    def __init__(self, frequencies: dict[bytes, int], documents: int):
        self.weight = {w: max(math.log((documents + 1) / (n + 0.5)), 0.0) + 1e-3 for w, n in frequencies.items()}
        self.templates: list[Template] = []
        self.heavy: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # postings that vote: (template, place)
        for t, (label, text, keys) in enumerate(TEMPLATES):
            own = [w.encode() for w in text.split()]
            places: dict[bytes, list[int]] = defaultdict(list)
            for place, w in enumerate(own):
                places[w].append(place)
            total = sum(self.weight[w] for w in own)
            self.templates.append(Template(label, dict(sorted(places.items(), key=lambda x: (-self.weight[x[0]], x[0]))), len(own), total, [k.encode().split() for k in keys], max(DRIFT, len(own) // LOOSE)))
            left = total
            for place in sorted(range(len(own)), key=lambda p: (-self.weight[own[p]], p)):
                if left < LEAST * total * (1 - 1e-9):  # what is left can't reach LEAST without those before
                    break
                self.heavy[own[place]].append((t, place))
                left -= self.weight[own[place]]
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        self.starts = frozenset(self.heavy) | frozenset(p[0] for p, _ in self.phrases)
        self.words = frozenset(w for t in self.templates for w in t.words) | frozenset(w for p, _ in self.phrases for w in p)

    def base(self, own: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, str]]:
        return [(i, label) for phrase, label in self.phrases for i in places.get(phrase[0], ()) if own[i : i + len(phrase)] == phrase]

    def votes(self, places: dict[bytes, list[int]]) -> dict[int, dict[int, float]]:
        """Of each template, the weight that its heavy words, the heaviest first, give to each relative position."""
        out: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for w in sorted(self.heavy.keys() & places.keys(), key=lambda w: (-self.weight[w], w)):
            for t, place in self.heavy[w]:
                for i in places[w]:
                    out[t][i - place] += self.weight[w]
        return out

    def match(self, own: list[bytes], places: dict[bytes, list[int]]) -> tuple[set[str], float]:
        """(labels, best score): of every template, the positions voted for, those with the most votes first."""
        labels, best = set(), 0.0
        for t, starts in self.votes(places).items():
            template = self.templates[t]
            for start in sorted(starts, key=lambda s: (-starts[s], s)):
                share = self.share(template, start, places)
                if share >= LEAST and self.holds_keys(template, start, own, places):
                    labels.add(template.label)
                    best = max(best, share)
        return labels, best

    def share(self, template: Template, start: int, places: dict[bytes, list[int]]) -> float:
        """The share of the template's weight that stands in the document at the position; 0 as soon as it can't reach LEAST."""
        held = left = template.total
        for w, own in template.words.items():
            found = places.get(w, ())
            for place in own:
                at = bisect_left(found, start + place - template.drift)
                if at == len(found) or found[at] > start + place + template.drift:
                    left -= self.weight[w]
            if left < LEAST * held * (1 - 1e-9):
                return 0.0
        return min(1.0, left / held)

    @staticmethod
    def holds_keys(template: Template, start: int, own: list[bytes], places: dict[bytes, list[int]]) -> bool:
        """All key phrases stand in the alignment's stretch of the document, one after the other."""
        at, stop = start - template.drift, start + template.length + template.drift
        for key in template.keys:
            first = places.get(key[0], ())
            for i in first[bisect_left(first, at) :]:
                if i + len(key) > stop:
                    return False
                if own[i : i + len(key)] == key:
                    at = i + len(key)
                    break
            else:
                return False
        return True


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, index: LicenceIndex) -> DataFrame:
    """Base phrases, labels and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in steps(batches, "text"):
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), text_words(batch)):
                if index.starts.isdisjoint(own):
                    rows.append((doc_id, len(own), 0, None, None, "", "", 0.0))
                    continue
                places: dict[bytes, list[int]] = defaultdict(list)
                for i, w in enumerate(own):
                    if w in index.words:
                        places[w].append(i)
                base = index.base(own, places)
                labels, score = index.match(own, places)
                score = 1.0 if base else score
                at = [i for i, _ in base]
                fixed = {label for _, label in base}
                rows.append((doc_id, len(own), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(fixed)), ",".join(sorted(fixed | labels)), score))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def licence_scan(docs: DataFrame) -> DataFrame:
    """scan() with an index weighted by all of docs."""
    return scan(docs, LicenceIndex(*document_frequencies(docs)))
