"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, searched with a block-max inverted index.

Features are lower-cased words (runs of letters) and their prefixes of PREFIXES letters (inflected languages change
endings). A bounded sample of labelled rows (EXAMPLES of each class, by a hash of their ids) gives the examples. The
vocabulary is all features of all examples. A feature weighs (1 + log tf) * idf * phi^2: document frequencies are counted over all
documents, and phi^2 is the squared association of the feature with the label among the examples, less what chance
alone gives (1 / (n - 1)). So words that speak for a class count, and those that tell nothing weigh little or nothing.

The index is inverted: for each feature its postings (example, weight), in blocks of BLOCK examples, and the largest
weight of each block. A text adds up its features' block maxima, which bounds the cosine of every block; the best
blocks are scored from their postings first, and then all blocks whose bound reaches the K-th best of those. The K
neighbours are therefore exact. They vote with weights that fall with cosine distance, a prior fills up what few
neighbours leave open, and a logistic curve fitted on leave-one-out votes of the examples, weighted back to the
classes' true shares, turns votes into probabilities. The nearest examples leave as evidence.

What is collected and broadcast is bounded by the features of 2 * EXAMPLES texts, whatever the number of documents.
Counting and scoring are one pass each over the rows; only (feature, count) pairs are shuffled.

Defined results: texts without any feature, null and empty ones among them, get the calibrated prior. Very long texts
are read in whole. Labels are learnt from rows whose crc32 of the id's text is not divisible by 5; of conflicting
labels of one id the larger counts; null labels and null ids teach nothing; of several texts of one labelled id the
longest counts, of equally long ones the last in order. Rows are scored one by one, so repeated rows and ids agree.
Equally near examples count in the index's order. Without any toxic or any clean example the score is the prior. An
empty table gives an empty result. A column with the result's name is replaced, all others pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopweave.llm.common import read

#: Examples of each class that the index holds at most.
EXAMPLES = 1000
PREFIXES = (5, 7)
BLOCK, K = 32, 15
#: Blocks that are scored before the first bound is known.
FIRST_BLOCKS = 4
#: Bytes of text that are split into features at a time; a longer text is taken by itself.
SLICE_BYTES = 2 << 20


def _slices(texts: pa.Array):
    """``texts`` in stretches of about SLICE_BYTES."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        if hi > lo:
            yield texts.slice(lo, hi - lo)


class Vocabulary:
    """Feature names, sorted, and the features of texts as numbers of these names."""

    def __init__(self, names: pa.Array):
        self.names = names
        prefix = pc.ends_with(names, "*")
        number = pa.array(np.arange(len(names), dtype=np.int64))
        self.words, self.prefixes = (names.filter(x) for x in (pc.invert(prefix), prefix))
        self.word_numbers, self.prefix_numbers = (number.filter(x).to_numpy() for x in (pc.invert(prefix), prefix))

    def __len__(self) -> int:
        return len(self.names)

    @staticmethod
    def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The row of each word of ``texts``, its number among the distinct words, and these."""
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+")
        words = lists.flatten().dictionary_encode()
        return np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), words.indices.to_numpy(), words.dictionary

    @staticmethod
    def _prefixes(words: pa.Array, n: int) -> pa.Array:
        return pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "*", "")

    @staticmethod
    def _numbers(wanted: pa.Array, names: pa.Array, numbers: np.ndarray) -> np.ndarray:
        at = pc.fill_null(pc.index_in(wanted, value_set=names), -1).to_numpy()
        return np.where(at >= 0, numbers[at], -1) if len(numbers) else np.full(len(at), -1)

    @classmethod
    def of(cls, texts: pa.Array) -> Vocabulary:
        """All features of some texts."""
        names = []
        for part in _slices(texts):
            words = cls._split(part)[2]
            words = words.filter(pc.not_equal(words, ""))
            names += [words, *(pc.unique(cls._prefixes(words.filter(pc.greater(pc.utf8_length(words), n)), n)) for n in PREFIXES)]
        return cls(pc.unique(pa.chunked_array(names, pa.string())).sort() if names else pa.array([], pa.string()))

    def bags(self, texts: pa.Array):
        """For each text its known features, as sorted numbers, and how often they occur."""
        for part in _slices(texts):
            row, word, distinct = self._split(part)
            length = pc.utf8_length(distinct).to_numpy()
            known = [self._numbers(distinct, self.words, self.word_numbers)]
            known += [np.where(length > n, self._numbers(self._prefixes(distinct, n), self.prefixes, self.prefix_numbers), -1) for n in PREFIXES]
            number = np.concatenate([x[word] for x in known])
            pairs = (np.tile(row, len(known)) * len(self) + number)[number >= 0]
            pairs, counts = np.unique(pairs, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(part) + 1) * max(1, len(self)))
            terms = pairs % max(1, len(self))
            for lo, hi in zip(ends, ends[1:], strict=False):
                yield terms[lo:hi], counts[lo:hi]


def _held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def _examples(labels: DataFrame) -> tuple[DataFrame, list[int]]:
    """The sampled (example, toxic), and how many clean and toxic rows there are to learn from."""
    own = labels.select(F.col("doc_id").cast("long").alias("example"), F.col("toxic").cast("int").alias("toxic")).where(F.col("example").isNotNull() & F.col("toxic").isNotNull() & ~_held_out(F.col("example")))
    own = own.groupBy("example").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = lambda c: own.where(F.col("toxic") == c).orderBy(F.xxhash64("example"), "example").limit(EXAMPLES)
    chosen = draw(0).unionByName(draw(1)).collect()
    frame = labels.sparkSession.createDataFrame([tuple(r) for r in chosen], "example long, toxic int")
    return frame, [sizes.get(0, 0), sizes.get(1, 0)]


def _example_texts(docs: DataFrame, chosen: DataFrame) -> pa.Table:
    """(example, toxic, text) of the chosen examples, by id; bounded by 2 * EXAMPLES rows."""
    rows = docs.select(F.col("doc_id").alias("example"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "example")  # at most 2 * EXAMPLES rows of two numbers
    one = rows.groupBy("example", "toxic").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("longest"))
    return one.select("example", "toxic", F.col("longest.text").alias("text")).toArrow().sort_by("example")


def _document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Rows, and rows that hold each known feature, over all documents."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own, rows = shared.value, 0
        counts = np.zeros(len(own), dtype=np.int64)
        for batch in batches:
            rows += batch.num_rows
            for terms, _ in own.bags(batch.column("text")):
                counts[terms] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, seen), pa.int32()), pa.array(np.append(rows, counts[seen]), pa.int64())], schema=schema)

    table = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (table.column(c).to_numpy() for c in ("term", "n"))
    counts = np.zeros(len(vocabulary), dtype=np.int64)
    counts[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), counts


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Index:
    """Inverted lists over the examples' features, in blocks with block maxima; ``search`` gives the exact nearest ones.

    ``vectors`` are (feature numbers, counts) of the examples; ``idf`` is by feature number; ``shares`` counts the
    clean and the toxic rows that the examples are drawn from.
    """

    def __init__(self, vocabulary: Vocabulary, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list[int], idf: np.ndarray, shares: list[int]):
        self.vocabulary = vocabulary
        label = np.array(labels, dtype=np.int64)
        self.weight = idf * self._association(vectors, label, len(vocabulary))
        weighted = [self.unit(*v) for v in vectors]
        # examples in order share blocks: sorted by label and heaviest feature, so that block maxima are tight
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in weighted]
        order = [i for i in sorted(range(len(ids)), key=lambda i: (labels[i], heaviest[i], ids[i])) if heaviest[i] >= 0]
        self.labels, self.ids = label[order], [ids[i] for i in order]
        self._invert([weighted[i] for i in order])
        self.prior = (shares[1] + 0.5) / (shares[0] + shares[1] + 1)
        self.curve = (0.0, math.log(self.prior / (1 - self.prior)))
        self._calibrate([vectors[i] for i in order], shares)

    @staticmethod
    def _association(vectors, label: np.ndarray, size: int) -> np.ndarray:
        """phi^2 of each feature's presence and the label, less what chance gives; one where there is only one class."""
        x, y = int(label.sum()), int((1 - label).sum())
        if not x or not y:
            return np.ones(size)
        flat = np.concatenate([t for t, _ in vectors])
        owner = np.repeat(label, [len(t) for t, _ in vectors])
        a, b = (np.bincount(flat[owner == c], minlength=size).astype(np.float64) for c in (1, 0))
        phi2 = (a * (y - b) - b * (x - a)) ** 2 / np.maximum((a + b) * (x + y - a - b) * x * y, 1.0)
        return np.maximum(0.0, phi2 - 1 / (x + y - 1))

    def _invert(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The postings (place, weight) by feature; ``entry_*`` are their stretches within a block, with its maximum."""
        place = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t, _ in rows])
        term = np.concatenate([t for t, _ in rows]) if rows else np.empty(0)
        weight = np.concatenate([w for _, w in rows]) if rows else np.empty(0)
        order = np.lexsort((place, term))
        self.place, term, self.posting = place[order], term[order].astype(np.int64), weight[order]
        first = np.flatnonzero(np.diff(term * (len(rows) // BLOCK + 1) + self.place // BLOCK, prepend=-1))
        self.entry_start = np.append(first, len(term)).astype(np.int32)
        self.entry_block = (self.place[first] // BLOCK).astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.posting, first) if len(first) else np.empty(0)
        self.term_start = np.searchsorted(term[first], np.arange(len(self.vocabulary) + 1)).astype(np.int32)
        self.blocks = -(-len(rows) // BLOCK)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features with a weight, and their weights scaled to length one."""
        w = (1 + np.log(counts)) * self.weight[terms]
        terms, w = terms[w > 0], w[w > 0]
        return terms, w / math.sqrt(float(w @ w)) if len(w) else w

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int = K, without: int = -1) -> list[tuple[float, int]]:
        """The k nearest examples of positive cosine, as (cosine, place), best first; ties go to the smaller place."""
        terms, q = self.unit(terms, counts)
        if not len(terms) or not self.blocks:
            return []
        starts = self.term_start[terms].astype(np.int64)
        lengths = self.term_start[terms + 1] - starts
        entries, q = _ranges(starts, lengths), np.repeat(q, lengths)
        blocks = self.entry_block[entries]
        bounds = np.bincount(blocks, weights=self.entry_max[entries] * q, minlength=self.blocks)
        near, least = np.zeros(len(self.ids)), 0.0
        tried = np.zeros(self.blocks, dtype=bool)
        tried[np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]] = True
        now = tried
        while now.any():
            own = now[blocks]
            start = self.entry_start[entries[own]].astype(np.int64)
            lengths = self.entry_start[entries[own] + 1] - start
            at = _ranges(start, lengths)
            near += np.bincount(self.place[at], weights=self.posting[at] * np.repeat(q[own], lengths), minlength=len(near))
            if without >= 0:
                near[without] = 0
            if now is not tried:
                break
            least = np.partition(near, -k)[-k] if len(near) > k else 0.0
            now = (bounds > 0) & (bounds >= least - 1e-9) & ~tried
        found = np.flatnonzero(near > 0)
        best = found[np.lexsort((found, -near[found]))[:k]]
        return list(zip(near[best].tolist(), best.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic weight; a neighbour weighs the inverse of its distance, the prior as much as a far one."""
        weights = [1 / (1.05 - min(1.0, c)) for c, _ in near]
        return (self.prior + sum(w * int(self.labels[i]) for w, (_, i) in zip(weights, near, strict=True))) / (1 + sum(weights))

    def _calibrate(self, vectors, shares) -> None:
        y = self.labels.astype(np.float64)
        n = [len(y) - y.sum(), y.sum()]
        if not all(n):
            return
        x = np.array([self._logit(self.vote(self.search(*v, without=i))) for i, v in enumerate(vectors)])
        w = np.where(y > 0, shares[1] / n[1], shares[0] / n[0])
        w /= w.mean()
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a small ridge towards the votes as they are
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([np.sum(w * (p - y) * x) + (a - 1), np.sum(w * (p - y)) + 1e-3 * b])
            v = w * p * (1 - p)
            h = np.array([[np.sum(v * x * x) + 1, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.curve = (float(max(a, 0.0)), float(b))

    @staticmethod
    def _logit(p: float) -> float:
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[float, int]]]:
        near = self.search(terms, counts)
        a, b = self.curve
        return 1 / (1 + math.exp(-(a * self._logit(self.vote(near)) + b))), near


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index over a bounded sample of ``labels`` (doc_id, toxic), with frequencies over all of ``docs`` (doc_id, text)."""
    chosen, shares = _examples(labels)
    held = _example_texts(docs, chosen)
    texts = held.column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    vocabulary = Vocabulary.of(texts)
    total, counts = _document_counts(docs, vocabulary)
    idf = np.log((1 + total) / (1 + counts)) + 1
    return Index(vocabulary, list(vocabulary.bags(texts)), held.column("toxic").to_pylist(), held.column("example").to_pylist(), idf, shares)


EVIDENCE = "array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def score_texts(docs: DataFrame, index: Index, score_col: str = "score", evidence_col: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the score, and the three nearest examples if ``evidence_col`` is named; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    added = [T.StructField(score_col, T.DoubleType())] + ([T.StructField(evidence_col, T._parse_datatype_string(EVIDENCE))] if evidence_col else [])
    names = {f.name for f in added}
    out = T.StructType([f for f in docs.schema if f.name not in names] + added)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.score(*x) for x in model.vocabulary.bags(batch.column(text_col))]
            new = [pa.array([s for s, _ in found], pa.float64())]
            if evidence_col:
                new.append(pa.array([[{"doc_id": model.ids[i], "similarity": c, "toxic": int(model.labels[i])} for c, i in near[:3]] for _, near in found], kind))
            kept = [(f, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name not in names]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *new], names=[*(f.name for f, _ in kept), *(f.name for f in added)])

    return docs.mapInArrow(run, out)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_texts(docs, fit(docs, labels), evidence_col="evidence").drop("text")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns unchanged. Without any toxic example all rows stay."""
    name, index = "__sw_toxicity", fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    if not any(index.labels):
        return docs
    return score_texts(docs, index, score_col=name).where(F.col(name) < 0.5).select(docs.columns)


def query(spark, sf_dir):
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
