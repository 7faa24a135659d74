"""Toxicity by nearest labelled examples.

Labelled training texts are examples.  A text's vector holds TF-IDF weights of all its
words that stand in some example, of either label.  A word's inverse document
frequency is multiplied by how unevenly the labels share the word, a number that is never
zero, so that no word is left out and words that tell nothing weigh little.  The ``k`` most
similar examples by exact cosine are found in a block-max inverted index, vote with weights
that fall with distance, and a logistic fit on the examples' leave-one-out
votes, weighted to the labels' true shares, turns the vote into a calibrated score.
The examples of label 1 among the neighbours are the evidence.

The index keeps its examples in blocks of ``BLOCK`` that are alike, each with inverted lists
of its own, and for every word and block the greatest weight.  A block whose bound (the query's
weights times these) is below the k-th best cosine so far cannot change the result and is left out;
no other example is.

Learning uses at most ``examples`` labelled rows per label, those whose ids hash
lowest: a documented bound.  Every text is scored whole.

Defined results: null and empty texts, and texts without any known word, have no neighbours
and get the score of a vote of zero; a very long text is one query like any other; ties of
similarity go to the example of lower id; of labelled rows with equal ids the one of
greatest label and text is learned from; labels that are null or neither 0 nor 1 are not learned from; repeated
rows are answered each; empty tables give no rows; without both labels every score is the
known label's share, or 0; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .langid import held_out, lowest
from .textcore import ALNUM_WORDS, Words, slices

K = 15
EXAMPLES = 2000
BLOCK = 64
#: Rows counted beside each label's own when a word's shares are compared, so that rare words tell little.
PRIOR = 4.0
#: Weight of a word that both labels share evenly, against 1 for one that is e times as frequent with one of them.
EVEN = 0.05
#: What a cosine of unit vectors in single precision may be off by, with room to spare.
ROUGH = 1e-5
#: Pairs that are compared in double precision at once.
PAIRS = 1 << 12
#: Texts that are compared at once.
BATCH = 128
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>"


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word hash) of a column with counts, by text and hash."""
    w = Words(column, ALNUM_WORDS)
    order = np.lexsort((w.hash, w.doc))
    hashes, docs = w.hash[order], w.doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(first)
    return hashes[at], docs[at], np.diff(np.append(at, len(hashes)))


@dataclass
class Vectors:
    """Unit vectors, one after another: those of row i lie in begin[i]:begin[i + 1], words ascending."""

    begin: np.ndarray
    word: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.begin))

    def take(self, order: np.ndarray) -> Vectors:
        size = np.diff(self.begin)[order]
        begin = np.append(0, np.cumsum(size))
        at = np.repeat(self.begin[:-1][order] - begin[:-1], size) + np.arange(begin[-1])
        return Vectors(begin, self.word[at], self.weight[at])

    @classmethod
    def of(cls, column: pa.Array, known: np.ndarray, scale: np.ndarray) -> Vectors:
        """Vectors of texts over the known words (sorted hashes), whose scales multiply 1 + log(count)."""
        h, d, c = counted(column)
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        word, doc = at[hit], d[hit]
        weight = (1.0 + np.log(c[hit])) * scale[word]
        n = len(column)
        norm = np.sqrt(np.bincount(doc, weight * weight, n))
        return cls(np.searchsorted(doc, np.arange(n + 1)), word, weight / norm[doc])

    @classmethod
    def joined(cls, parts: list[Vectors]) -> Vectors:
        if not parts:
            return cls(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ends = np.cumsum([0, *[p.begin[-1] for p in parts]])
        begin = np.concatenate([[0], *[p.begin[1:] + e for p, e in zip(parts, ends)]])
        return cls(begin, np.concatenate([p.word for p in parts]), np.concatenate([p.weight for p in parts]))


def alike(vectors: Vectors, n_words: int, size: int, dims: int = 96, seed: int = 3) -> np.ndarray:
    """An order of the vectors in which those of a run of ``size`` are alike: halves along the widest direction, again and again.

    Directions are sought among random projections; they decide only how tight the bounds are.
    """
    sketch = np.zeros((len(vectors), dims))
    planes = np.random.default_rng(seed).normal(size=(n_words, dims)).astype(np.float32)
    rows = vectors.rows()
    for at in range(0, len(rows), 1 << 16):
        own = slice(at, at + (1 << 16))
        np.add.at(sketch, rows[own], planes[vectors.word[own]] * vectors.weight[own, None])
    done, todo = [], [np.arange(len(vectors))]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        x = sketch[part] - sketch[part].mean(0)
        v = x[np.argmax((x * x).sum(1))]
        for _ in range(8):
            v = x.T @ (x @ v)
            v = v / max(np.sqrt(v @ v), 1e-300)
        half = -(-len(part) // (2 * size)) * size
        order = part[np.argsort(x @ v, kind="stable")]
        todo += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Inverted lists of unit vectors by block of alike examples, with each list's greatest weight."""

    def __init__(self, vectors: Vectors, n_words: int):
        self.n, self.order = len(vectors), alike(vectors, n_words, BLOCK)
        self.vectors = v = vectors.take(self.order)
        v.word = v.word.astype(np.int32)
        place = v.rows()
        self.blocks = -(-self.n // BLOCK)
        self.most = np.zeros((n_words, self.blocks), np.float32)
        self.words, self.begin, self.place, self.weight = [], [], [], []
        for b in range(self.blocks):
            own = slice(v.begin[b * BLOCK], v.begin[min(self.n, (b + 1) * BLOCK)])
            by = np.argsort(v.word[own], kind="stable")
            word, weight = v.word[own][by], v.weight[own][by]
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            self.words.append(word[start])
            self.begin.append(np.append(start, len(word)))
            self.place.append((place[own][by] - b * BLOCK).astype(np.int8))
            self.weight.append(weight)
            # Rounded up, so that a bound in single precision is never too low.
            if len(word):
                self.most[word[start], b] = np.nextafter(np.maximum.reduceat(weight, start).astype(np.float32), np.float32(2))

    def nearest(self, queries: Vectors, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For every query the k examples of greatest positive cosine (-1 where there are fewer) and these, exactly.

        Ties go to the lower example.  ``skip`` names an example per query that is not an answer.
        Queries with the same first block are compared together, as they leave out much the same blocks.
        """
        n = len(queries)
        best, near = np.zeros((n, k)), np.full((n, k), self.n, np.int64)
        bound = self.bounds(queries)
        order = np.argsort(bound.argmax(1), kind="stable") if n else np.zeros(0, np.int64)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            best[own], near[own] = self._nearest(queries.take(own), bound[own], k, None if skip is None else skip[own])
        return np.where(near == self.n, -1, near), best

    def bounds(self, queries: Vectors) -> np.ndarray:
        """For every query and block a number that no cosine with an example of the block exceeds."""
        bound = np.zeros((len(queries), self.blocks))
        for at in range(0, len(queries), BATCH):
            part = queries.take(np.arange(at, min(len(queries), at + BATCH)))
            some = np.flatnonzero(np.diff(part.begin))
            if len(some):
                bound[at + some] = np.add.reduceat(self.most[part.word] * part.weight[:, None], part.begin[some]) + 1e-9
        return bound

    def _nearest(self, queries: Vectors, bound: np.ndarray, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Single precision tells which few examples may be among the best; these are compared in double precision."""
        n = len(queries)
        best, near = np.zeros((n, k)), np.full((n, k), self.n, np.int64)
        words, inverse = np.unique(queries.word, return_inverse=True)
        if not len(words):
            return best, near
        dense = np.zeros((len(words), n), np.float32)
        dense[inverse, queries.rows()] = queries.weight
        none = len(words)  # the place of words that no query has
        place = np.full(len(self.most), none, np.int32)
        place[words] = np.arange(len(words), dtype=np.int32)
        rough, top = np.zeros((n, self.n), np.float32), np.zeros((n, k), np.float32)

        def visit(b: int, rows: np.ndarray) -> None:
            own = self.words[b]
            at = place[own]
            both = np.flatnonzero(at < none)
            begin, size = self.begin[b][both], np.diff(self.begin[b])[both]
            entry = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            span = slice(b * BLOCK, min(self.n, (b + 1) * BLOCK))
            lists = np.zeros((len(both), span.stop - span.start), np.float32)
            lists[np.repeat(np.arange(len(both)), size), self.place[b][entry]] = self.weight[b][entry]
            mine = dense[at[both]]
            if 2 * len(rows) > n:
                cosine = (mine.T @ lists)[rows]
            else:
                cosine = mine[:, rows].T @ lists
            if skip is not None:
                cosine[self.order[None, span] == skip[rows, None]] = 0.0
            rough[rows, span] = cosine
            higher = rows[cosine.max(1) > top[rows].min(1)]
            if len(higher):
                top[higher] = np.partition(np.hstack([top[higher], rough[higher, span]]), -k, axis=1)[:, -k:]

        first = bound.argmax(1)
        for b in np.unique(first):
            visit(b, np.flatnonzero(first == b))
        for b in np.argsort(-bound.max(0), kind="stable"):
            rows = np.flatnonzero((bound[:, b] >= top.min(1) - ROUGH) & (first != b) & (bound[:, b] > 1e-9))
            if len(rows):
                visit(b, rows)
        row, at = np.nonzero((rough > 0) & (rough >= top.min(1)[:, None] - 2 * ROUGH))
        value = np.zeros(len(row))
        full = np.zeros((n, none + 1))
        full[queries.rows(), inverse] = queries.weight
        flat, v = full.ravel(), self.vectors
        for a in range(0, len(row), PAIRS):
            r, e = row[a : a + PAIRS], at[a : a + PAIRS]
            size = v.begin[e + 1] - v.begin[e]
            start = np.cumsum(size) - size
            entry = np.repeat(v.begin[e] - start, size) + np.arange(size.sum())
            hit = flat[np.repeat(r * (none + 1), size) + place[v.word[entry]]]
            value[a : a + PAIRS] = np.round(np.add.reduceat(hit * v.weight[entry], start), 12)
        who = self.order[at]
        order = np.lexsort((who, -value, row))
        row, value, who = row[order], value[order], who[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        fits = (rank < k) & (value > 0)
        best[row[fits], rank[fits]], near[row[fits], rank[fits]] = value[fits], who[fits]
        return best, near


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted hashes of the examples' words
    scale: np.ndarray
    vectors: Vectors
    label: np.ndarray
    ids: np.ndarray
    k: int
    slope: float
    shift: float
    index: BlockMaxIndex | None = None

    def indexed(self) -> ToxicityModel:
        """The index is made where it is used, as its lists are larger than the vectors."""
        if self.index is None:
            self.index = BlockMaxIndex(self.vectors, len(self.words))
        return self

    def votes(self, near: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each weighted by its nearness; 0 without neighbours."""
        weight = np.where(near >= 0, 1.0 / (1.05 - np.minimum(cosine, 1.0)), 0.0)
        return (weight * self.label[near]).sum(1) / np.maximum(weight.sum(1), 1e-12)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * votes + self.shift)))

    def scored(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, neighbours and cosines of texts."""
        if not len(self.words):
            return self.calibrated(np.zeros(len(column))), np.full((len(column), self.k), -1), np.zeros((len(column), self.k))
        near, cosine = self.index.nearest(Vectors.of(column, self.words, self.scale), self.k)
        return self.calibrated(self.votes(near, cosine)), near, cosine


def scales(seen: np.ndarray, ones: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Inverse document frequency of words times how unevenly the labels share them."""
    n, n1 = len(label), float(label.sum())
    idf = np.log((n + 1.0) / (seen + 1.0)) + 1.0
    uneven = np.abs(np.log((ones + PRIOR) / (n1 + 2 * PRIOR)) - np.log((seen - ones + PRIOR) / (n - n1 + 2 * PRIOR)))
    return idf * (EVEN + uneven)


def fit(texts: list[str], labels: list[int], ids: list[int], share: float | None = None, k: int = K) -> ToxicityModel:
    """A model of examples in the order of their ids; ``share`` is that of label 1 among all labelled rows, if it differs from theirs."""
    label = np.array(labels, float)
    own = float(label.mean()) if len(label) else 0.0
    share = own if share is None else share
    none = np.zeros(0)
    model = ToxicityModel(none.astype(np.uint64), none, Vectors.joined([]), label, np.array(ids, np.int64), k, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < label.sum() < len(label):
        return model
    parts = list(slices(pa.array(texts, pa.string())))
    terms = [counted(part) for _, part in parts]
    model.words, inverse = np.unique(np.concatenate([h for h, _, _ in terms]), return_inverse=True)
    doc = np.concatenate([at + d for (at, _), (_, d, _) in zip(parts, terms)])
    model.scale = scales(np.bincount(inverse, minlength=len(model.words)), np.bincount(inverse, label[doc], len(model.words)), label)
    model.vectors = Vectors.joined([Vectors.of(part, model.words, model.scale) for _, part in parts])
    near, cosine = model.indexed().index.nearest(model.vectors, k, np.arange(len(label)))
    model.slope, model.shift = logistic(model.votes(near, cosine), label, np.where(label == 1, share / own, (1 - share) / (1 - own)))
    model.index = None
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps with a light ridge."""
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ beta))
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> ToxicityModel:
    """Fits on the ``examples`` labelled training rows of each label whose ids hash lowest."""
    toxic = F.col("toxic").cast("int")
    own = labels.where(toxic.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), toxic.alias("toxic"))
    chosen, counts = lowest(own, "toxic", examples, 23)
    # At most 2 * examples ids: small enough to send to every task.
    few = F.broadcast(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    rows = texts.join(few, "doc_id").collect()
    once: dict[int, tuple] = {}
    for r in rows:
        once[r.doc_id] = max(once.get(r.doc_id, (-1, "")), (r.toxic, r.text))
    ids = sorted(once)
    total = sum(counts.values())
    return fit([once[i][1] for i in ids], [once[i][0] for i in ids], ids, counts.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score, decision, and the ids of the examples that voted for label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value.indexed()
        for batch in batches:
            for at, part in slices(batch.column(1), 1 << 20):
                s, near, _ = m.scored(part)
                toxic = (near >= 0) & (m.label[near] == 1) if len(m.label) else near >= 0
                ends = np.append(0, np.cumsum(toxic.sum(1)))
                evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(m.ids[near[toxic]] if len(m.ids) else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), evidence], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)


def op10_toxicity_neighbours(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
