import functools
import math
import random
import re

from stopweave.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score int"


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check(rows, texts):
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["score"] == 1 or not r["n_base"]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def read_twice(text):
    """(words, their places) of a text as it is, and without words that begin three lines in a row or more."""
    lines = [x for x in map(split, (text or "").split("\n")) if x]
    same = lambda i, j: 0 <= i and j < len(lines) and len({x[0] for x in lines[i : j + 1]}) == 1
    left, at = [], 0
    for n, line in enumerate(lines):
        comment = any(same(n - d, n - d + 2) for d in range(3))
        left += [(w, at + k) for k, w in enumerate(line) if k or not comment]
        at += len(line)
    whole = split(text)
    return [(whole, list(range(len(whole)))), ([w for w, _ in left], [i for _, i in left])]


def heaviest(part, stretch, weights):
    @functools.cache
    def best(a, b):
        if a == len(part) or b == len(stretch):
            return 0.0
        return max(best(a + 1, b), best(a, b + 1), best(a + 1, b + 1) + weights[part[a]] if part[a] == stretch[b] else 0.0)

    return best(0, 0)


def brute_aligned(words, t, keys, weights):
    """(score, start) around every place of the first key phrase."""
    key, holds = keys[0], lambda stretch, k: any(stretch[j : j + len(k)] == k for j in range(len(stretch)))
    at = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
    before, after = t[:at], t[at + len(key) :]
    for p in range(len(words)):
        if words[p : p + len(key)] == key and len(key) < len(t):
            left = words[max(0, p - len(before) - len(before) // 4 - licenses.INSERTED) : p]
            right = words[p + len(key) :][: len(after) + len(after) // 4 + licenses.INSERTED]
            if all(holds(left + key + right, k) for k in keys[1:]):
                found = heaviest(before, left, weights) + sum(weights[w] for w in key) + heaviest(after, right, weights)
                yield min(1.0, found / sum(weights[w] for w in t)), p - at


def brute_notices(texts):
    """For each text its labels, score and notices, from every template at every start and around every key phrase."""
    rows = [split(t) for t in texts]
    known = [(label, t.split(), [k.split() for k in keys]) for label, t, keys in licenses.NOTICES]
    idf = lambda w: math.log((1 + len(rows)) / (1 + sum(w in set(r) for r in rows))) + 1
    weights = {w: idf(w) for w in {w for _, t, _ in known for w in t}}
    out = []
    for text in texts:
        found = []
        for label, t, keys in known:
            best = None
            for own, places in read_twice(text):
                here = None
                for start in range(-len(t), len(own)):
                    same = [0 <= start + k < len(own) and own[start + k] == w for k, w in enumerate(t)]
                    score = 1.0 if all(same) else sum(weights[w] for w, ok in zip(t, same, strict=True) if ok) / sum(weights[w] for w in t)
                    stands = all(0 <= start + i and own[start + i : start + i + len(k)] == k for k in keys for i in range(len(t)) if t[i : i + len(k)] == k)
                    if score >= licenses.LEAST_SCORE and stands and (here is None or score > here[0]):
                        here = (score, start)
                for score, start in brute_aligned(own, t, keys, weights):
                    if score >= licenses.LEAST_SCORE and (here is None or score > here[0] + 1e-9):
                        here = (score, start)
                if here and (best is None or here[0] > best[0] + 1e-9):
                    best = (here[0], here[1] if here[1] < 0 else places[here[1]])
            if best:
                found.append((label, best[1], round(best[0], 9)))
        base = brute(text)
        labels = {x for x, *_ in found} | set(filter(None, base[4].split(",")))
        out.append((",".join(sorted(labels)), 1.0 if base[1] else max((s for *_, s in found), default=0.0), sorted(found)))
    return out


WHOLE = {
    "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}


def test_notices_against_brute_force(spark):
    texts = [*WHOLE.values(), *(f"a b c {t[40:]} and {t[:90]}" for t in WHOLE.values()), *(" ".join(split(t)[::2]) for t in WHOLE.values()), *(t for _, t, _ in licenses.NOTICES), "the license of the software", "", None]
    texts += [t.replace("free", "gratis").replace("Software", "work") for t in WHOLE.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(docs).orderBy("doc_id").collect()
    mine = [(r["labels"], round(r["score"], 9), sorted((x["label"], x["start"], round(x["score"], 9)) for x in r["notices"])) for r in got]
    assert mine == [(a, round(b, 9), c) for a, b, c in brute_notices(texts)]
    for r, label in zip(got, WHOLE, strict=False):
        assert label in r["labels"].split(",") and r["score"] == 1.0


def test_edges(spark):
    texts = {
        1: None, 2: "", 3: "Released UNDER the MIT-License. under_the mit license", 4: "Apache License, Version 2.0; apache license version 20", 5: "CC BY-NC cc by nc cc  by  ncé",
        6: "cc by cc by nc by nc " * 5000, 7: "This work is licensed under the GNU General Public License, version 3.", 8: "This work is licensed under the GNU General Public License, version 2.",
        9: "under the mit", 10: "mit license under the", 11: "éü Öunder the mit license", 12: "Permission is hereby granted, free of charge, to any person obtaining a copy of our software and associated documentation, to deal in the Software",
        13: "cc by nc", 14: "cc by nc", 15: "All rights reserved.", 16: "gnu gnu license version", 17: "mit " * 1000,
    }
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in texts.items()] + [(13, texts[13], "x", 0)], SCHEMA)
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(texts) + 1
    check(got, texts)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[7] == "gpl-3" and labels[8] == "" and labels[12] == "mit" and labels[15] == "proprietary" and labels[16] == ""
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == 200
    check(got, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert sum(r["n_base"] for r in got) > 0


def test_versions_and_restrictions_are_told_apart(spark):
    cases = {
        "Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.": "gpl-2",
        WHOLE["gpl"]: "gpl,gpl-3",
        WHOLE["gpl"].replace("General", "Affero General"): "agpl-3",
        "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3",
        "the attribution of this work to a creative person": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = licenses.scan_licenses(docs).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == list(cases.values())
    assert [(r["labels"], round(r["score"], 9)) for r in got] == [(a, round(b, 9)) for a, b, _ in brute_notices(list(cases))]


def test_comment_words_and_insertions(spark):
    grant = WHOLE["mit"].split()
    lines = [" ".join(grant[i : i + 7]) for i in range(0, len(grant), 7)]
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation (FSF, Boston), either version 3 of the License"
    cases = {
        "\n".join(f"dnl {x}" for x in lines): "mit",
        "\n".join(f"# {x}" for x in lines): "mit",
        "head\n\n" + "\n\n".join(f"REM {x}" for x in lines) + "\ntail": "mit",
        WHOLE["mit"].replace("to deal in", "(the 'Software', as we call it from here on) to deal in"): "mit",
        header: "gpl,gpl-3",
        WHOLE["apache-2"].replace("you may not", "and you, dear reader, may not"): "apache-2",
        "permission is hereby granted free of charge " * 300: "",
        "the gnu general public license as published " + "word " * 60 + "free software foundation either version 3 of the license": "",
        "dnl a b\ndnl c d": "",
        "dnl\ndnl\ndnl": "",
        "software " * 3000: "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = licenses.scan_licenses(docs).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == list(cases.values())
    mine = [(r["labels"], round(r["score"], 9), sorted((x["label"], x["start"], round(x["score"], 9)) for x in r["notices"])) for r in got]
    assert mine == [(a, round(b, 9), c) for a, b, c in brute_notices(list(cases))]


def test_random_cuts_and_insertions_against_brute_force(spark):
    r, texts = random.Random(3), []
    for _, notice, _ in licenses.NOTICES:
        words = notice.split()
        for _ in range(2):
            own = [w for w in words if r.random() > 0.1]
            for _ in range(r.randrange(4)):
                own.insert(r.randrange(len(own) + 1), r.choice(["the", "software", "x", "license", "2"]))
            texts.append("".join(w + r.choice("    \n") for w in own))
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    mine = [(r["labels"], round(r["score"], 9), sorted((x["label"], x["start"], round(x["score"], 9)) for x in r["notices"])) for r in got]
    assert mine == [(a, round(b, 9), c) for a, b, c in brute_notices(texts)]
