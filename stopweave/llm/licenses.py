"""License scan with a positional index of rare words.

Templates are licence notices, split into words. How rare their words are is counted over all documents first (one row
for each word of the templates, bounded by them, and the only thing collected). The index holds, for the highest-IDF
words of each template, postings of (template, position): so many of them that what is left weighs less than a match
must have, so every place that reaches the bar holds one of them where the template has it. A file's words are looked
up there, each posting proposes a start (file position less template position), and a start is intersected with the
whole template by relative position and scored by the IDF of what matches. It counts if its score reaches LEAST_SCORE
and all mandatory key phrases stand where the template has them. No place above the bar is missed.

Files insert words into notices, or wrap them in comments. So each place of a template's first key phrase is aligned as
well: the words before and after it count if they stand in order (the heaviest common subsequence) in a stretch that is
longer than the template's part by a quarter and INSERTED words, and the other key phrases have to stand in that
stretch. And where a word begins COMMENTED lines in a row or more (`dnl`, `rem`), the file is also read without it.

Templates of one phrase (the base) have to match in every word, so all their places are found exactly: each place
holds the template's rarest word, and every occurrence of that word is looked up.

Defined results: null and empty texts have no words, no labels and score 0. The score is that of the best match, 1 for
a base phrase, and 0 without any. Every base place counts, overlapping ones too; of a notice's places the best counts,
of equally good ones the first. Very long texts are read in whole. Rows are judged one by one, so repeated rows agree;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.llm.common import read

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wording of public licence notices, in whole and in the short forms that files often carry, each with its
# label and its mandatory key phrases.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["permission is hereby granted free of charge"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license version 2 0"]),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", ["gnu general public license as published", "free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version", ["gnu lesser general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", ["gnu general public license version 2 as published"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2 of the license"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3 of the license"]),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ["cc by nc sa"]),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ["cc by nc nd"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]
# What is added to "Creative Commons Attribution", in whole notices and in their names alone.
CREATIVE_COMMONS = {"cc-by": "", "cc-by-sa": "sharealike ", "cc-by-nd": "noderivatives ", "cc-by-nc": "noncommercial ", "cc-by-nc-sa": "noncommercial sharealike ", "cc-by-nc-nd": "noncommercial noderivatives "}
for _label, _more in CREATIVE_COMMONS.items():
    _name = f"creative commons attribution {_more}4 0"
    NOTICES += [(_label, f"this work is licensed under a {_name} international license", [_name]), (_label, f"{_name} international", [_name])]
# Identifiers as they follow "SPDX-License-Identifier:", each with its label.
SPDX = {"mit": "mit", "apache 2 0": "apache-2", "isc": "isc", "mpl 2 0": "mpl-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl-3", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "unlicense": "unlicense"}
NOTICES += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for name, label in SPDX.items()]
#: Least IDF-weighted share of a notice that must match in place.
LEAST_SCORE = 0.6
#: Words that may be inserted on either side of a key phrase, beside a quarter of the notice's words there.
INSERTED = 8
#: Lines in a row that a comment word begins at least.
COMMENTED = 3
_SEPARATORS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII digits and letters (A-Z lower-cased) and of all other than ASCII."""
    return (text or b"").lower().translate(_SEPARATORS).split()


def split_lines(text: bytes | None) -> tuple[list[bytes], list[int]]:
    """The words of a text, and the places of those that are left without comment words (none if there are no such words)."""
    lines = [x for x in (line.translate(_SEPARATORS).split() for line in (text or b"").lower().split(b"\n")) if x]
    words, kept, at = [w for line in lines for w in line], [], 0
    for _, run in groupby(lines, key=lambda line: line[0]):
        run = list(run)
        for line in run:
            kept += range(at + (len(run) >= COMMENTED), at + len(line))
            at += len(line)
    return words, kept if len(kept) < len(words) else []


def templates() -> list[dict]:
    cut = lambda s: [w.encode() for w in s.split()]
    out = [{"label": label, "words": cut(p), "keys": [cut(p)], "base": True} for p, label in BASE.items()]
    return out + [{"label": label, "words": cut(t), "keys": [cut(k) for k in keys], "base": False} for label, t, keys in NOTICES]


def document_counts(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """How many rows there are, and how many hold each word of ``vocabulary``."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts, rows = dict.fromkeys(vocabulary, 0), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text"):
                for w in vocabulary.intersection(split_words(text.as_py())):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *counts], pa.binary()), pa.array([rows, *counts.values()], pa.int64())], schema=schema)

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in found.collect()}
    return counts.pop(b"", 0), counts


class Index:
    """Postings of the templates' rare words."""

    def __init__(self, rows: int, counts: dict[bytes, int]):
        self.idf = {w: math.log((1 + rows) / (1 + n)) + 1 for w, n in counts.items()}
        self.templates = templates()
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}  # the rarest word of a first key phrase: template, place in the phrase
        for t, x in enumerate(self.templates):
            words = x["words"]
            x["weight"] = sum(self.idf[w] for w in words)
            spare = 0.0 if x["base"] else (1 - LEAST_SCORE) * x["weight"] + 1e-9
            for k in sorted(range(len(words)), key=lambda k: (-self.idf[words[k]], k)):
                self.postings.setdefault(words[k], []).append((t, k))
                spare -= self.idf[words[k]]
                if spare < 0:
                    break
            if not x["base"] and len(x["keys"][0]) < len(words):
                key = x["keys"][0]
                k = max(range(len(key)), key=lambda k: (self.idf[key[k]], -k))
                self.anchors.setdefault(key[k], []).append((t, k))
            x["key_places"] = [(i, key) for key in x["keys"] for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key]

    def share(self, t: int, start: int, words: list[bytes]) -> float:
        """The IDF-weighted share of a template that stands in place, if it starts at ``start``."""
        x = self.templates[t]
        same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(x["words"])]
        return 1.0 if all(same) else sum(self.idf[w] for w, ok in zip(x["words"], same, strict=True) if ok) / x["weight"]

    def _in_order(self, part: list[bytes], stretch: list[bytes]) -> float:
        """The weight of the heaviest common subsequence."""
        best = [0.0] * (len(stretch) + 1)
        for w in part:
            row = [0.0]
            for j, v in enumerate(stretch):
                row.append(max(best[j] + self.idf[w] if v == w else 0.0, best[j + 1], row[j]))
            best = row
        return best[-1]

    def aligned(self, t: int, at: int, words: list[bytes], bar: float) -> tuple[float, int]:
        """(score, start) of a template whose first key phrase stands at ``at``; score 0 if it can't exceed ``bar``."""
        x = self.templates[t]
        notice, key = x["words"], x["keys"][0]
        k = x["key_places"][0][0]
        before, after = notice[:k], notice[k + len(key) :]
        lo = max(0, at - len(before) - len(before) // 4 - INSERTED)
        hi = at + len(key) + len(after) + len(after) // 4 + INSERTED
        held, own = set(words[lo:hi]), sum(self.idf[w] for w in key)
        if (own + sum(self.idf[w] for w in before + after if w in held)) / x["weight"] <= bar:
            return 0.0, 0
        if not all(any(words[j : j + len(other)] == other for j in range(lo, min(hi, len(words)) - len(other) + 1)) for other in x["keys"][1:]):
            return 0.0, 0
        found = self._in_order(before, words[lo:at]) + own + self._in_order(after, words[at + len(key) : hi])
        return min(1.0, found / x["weight"]), at - k

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, tuple[float, int]]]:
        """Base places as (template, start), and the best (score, start) of each other template that counts."""
        starts = {(t, i - k) for i, w in enumerate(words) if w in self.postings for t, k in self.postings[w]}
        base, notices = [], {}
        for t, start in sorted(starts):
            x, score = self.templates[t], self.share(t, start, words)
            if x["base"]:
                if score == 1.0:
                    base.append((t, start))
            elif score >= LEAST_SCORE and score > notices.get(t, (0.0, 0))[0] and all(words[max(0, start + i) : start + i + len(key)] == key for i, key in x["key_places"]):
                notices[t] = (score, start)
        return base, self._with_insertions(words, notices)

    def _with_insertions(self, words: list[bytes], notices: dict[int, tuple[float, int]]) -> dict[int, tuple[float, int]]:
        """``notices`` and those that only an alignment finds, or finds better."""
        places = sorted({(t, i - k) for i, w in enumerate(words) if w in self.anchors for t, k in self.anchors[w]})
        for t, at in places:
            key, best = self.templates[t]["keys"][0], notices.get(t, (0.0, 0))[0]
            if best < 1 - 1e-9 and at >= 0 and words[at : at + len(key)] == key:
                score, start = self.aligned(t, at, words, max(LEAST_SCORE - 2e-9, best) + 1e-9)
                if score >= LEAST_SCORE and score > best + 1e-9:
                    notices[t] = (score, start)
        return notices

    def notices_without(self, words: list[bytes], kept: list[int], notices: dict[int, tuple[float, int]]) -> dict[int, tuple[float, int]]:
        """``notices`` and those that are found, or found better, in the words at the places ``kept``."""
        for t, (score, start) in self.scan([words[i] for i in kept])[1].items():
            if score > notices.get(t, (0.0, 0))[0] + 1e-9:
                notices[t] = (score, start if start < 0 else kept[start])
        return notices


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): words, base places, labels, score, and the notices found with their starts."""
    vocabulary = {w for x in templates() for w in x["words"]}
    shared = docs.sparkSession.sparkContext.broadcast(Index(*document_counts(docs, vocabulary)))
    found = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", found)])

    def run(batches):
        index = shared.value
        name = lambda t: index.templates[t]["label"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for text in batch.column("text"):
                words, kept = split_lines(text.as_py())
                base, notices = index.scan(words)
                if kept:
                    notices = index.notices_without(words, kept, notices)
                starts, own = [s for _, s in base], {name(t) for t, _ in base}
                labels = own | {name(t) for t in notices}
                score = 1.0 if base else max((s for s, _ in notices.values()), default=0.0)
                evidence = sorted(({"label": name(t), "start": start, "score": s} for t, (s, start) in notices.items()), key=lambda x: (x["label"], x["start"], -x["score"]))
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score, evidence))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,start:long,score:double>>")


def query(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))
