"""Language identification with string kernels.

The kernel of two texts is a blended spectrum of byte n-grams (1 to 3 bytes, A-Z
lower-cased) by presence: the number of n-grams that both hold over the geometric
mean of the numbers that each holds.  A Nystroem map through a few landmark texts
turns the kernel into features, one-versus-rest kernel ridge regression is solved
on them, and texts are scored in batches by matrix products.

Learning uses a bounded sample of labelled rows: per language the
``per_language`` training texts of smallest hash, a documented parameter.  Every
text is scored whole.

Defined results: a null text or one without letters is ``und`` with score 0; other
texts, very long ones too, get a learned label; ties go to the label that sorts first; repeated rows are
answered each; an empty table gives no rows; without training rows all is ``und``;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .textcore import LOWER, slices, utf8

ORDERS = (1, 2, 3)
LANDMARKS = 96
PER_LANGUAGE = 300
RIDGE = 1e-3
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

#: First code of each order in one shared numbering of n-grams.
_BASE = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
_CODES = (1 << 8) + (1 << 16) + (1 << 24)


def gram_codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams that do not cross texts, and the text of each."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    code = data[:n].astype(np.int32)
    for k in range(1, order):
        code = (code << 8) | data[k : n + k]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = doc[:n] == doc[order - 1 :]
    return code[same] + np.int32(_BASE[order]), doc[:n][same]


def distinct_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and code of every distinct n-gram of each text, by text, and the number of texts."""
    raw, offsets = utf8(column)
    data = LOWER[raw]
    code, doc = (np.concatenate(x) for x in zip(*(gram_codes(data, offsets, o) for o in ORDERS)))
    key = np.sort((doc.astype(np.int64) << 32) | code)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    return key >> 32, key & 0xFFFFFFFF, len(offsets) - 1


#: Rows of the landmark matrix that are summed at once.
GATHER = 1 << 15


@dataclass
class LanguageModel:
    """Landmarks' n-grams and the ridge solution; small, as its size depends only on the sample."""

    labels: list[str]
    codes: np.ndarray  # the landmarks' n-grams, sorted
    landmark: np.ndarray  # presence of codes by landmark, scaled by 1/sqrt(distinct)
    weights: np.ndarray  # landmark kernels to one score a label, with a last row for the bias

    def table(self) -> np.ndarray:
        table = np.full(_CODES, len(self.codes), np.int32)
        table[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return table

    def kernel(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        doc, code, n = distinct_grams(column)
        distinct = np.bincount(doc, minlength=n)
        at = table[code]
        doc, at = doc[at < len(self.codes)], at[at < len(self.codes)]
        shared = np.zeros((n, self.landmark.shape[1]))
        for a in range(0, len(at), GATHER):  # a sparse product: rows of the landmark matrix summed by text
            d = doc[a : a + GATHER]
            start = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            shared[d[start]] += np.add.reduceat(self.landmark[at[a : a + GATHER]], start)
        return shared / np.sqrt(np.maximum(distinct, 1.0))[:, None]

    def scores(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        k = self.kernel(column, table)
        return k @ self.weights[:-1] + self.weights[-1]


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fits on texts that are already few; landmarks are spread evenly over the languages."""
    labels = sorted(set(langs))
    by_label = {x: [t for t, y in zip(texts, langs) if y == x] for x in labels}
    each = max(1, landmarks // max(1, len(labels)))
    chosen = [t for x in labels for t in by_label[x][:each]]
    column = pa.array(chosen, pa.string())
    raw, offsets = utf8(column)
    parts = [gram_codes(LOWER[raw], offsets, o) for o in ORDERS]
    code, doc = (np.concatenate(x) for x in zip(*parts))
    codes = np.unique(code)
    held = np.zeros((len(chosen), len(codes)), np.float32)
    held[doc, np.searchsorted(codes, code)] = 1.0
    landmark = np.ascontiguousarray((held / np.sqrt(np.maximum(held.sum(1, keepdims=True), 1.0))).T)
    model = LanguageModel(labels, codes, landmark, np.zeros((len(chosen) + 1, len(labels))))
    among = (landmark.T @ landmark).astype(np.float64)
    value, vector = np.linalg.eigh(among)
    solid = value > value.max() * 1e-9
    to_features = vector[:, solid] / np.sqrt(value[solid])  # Nystroem: K(x, L) K(L, L)^(-1/2)
    table = model.table()
    kernel = np.concatenate([model.kernel(c, table) for _, c in slices(pa.array(texts, pa.string()), rows=256)])
    features = kernel @ to_features
    mean = features.mean(0)
    target = np.where(np.array(langs)[:, None] == np.array(labels)[None, :], 1.0, 0.0)
    centred = features - mean
    gram = centred.T @ centred + ridge * len(texts) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, centred.T @ (target - target.mean(0)))
    model.weights = np.vstack([to_features @ solved, target.mean(0) - mean @ solved])
    return model


def held_out(doc_id, modulus: int = 5, rest: int = 0):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == F.lit(rest)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fits on the ``per_language`` training rows of each language whose ids hash lowest.

    Two passes: the first finds ids without touching texts, the second reads the
    few texts; both are bounded by the parameter.  Rows of the same id count as one, that of the
    greatest language and text.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen, _ = lowest(usable.select("lang", "doc_id"), "lang", per_language, 17)
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").collect()
    once: dict = {}
    for r in rows:
        once[r.doc_id] = max(once.get(r.doc_id, ("", "")), (r.lang, r.text))
    found = [once[i] for i in sorted(once) if any(x.isalpha() for x in once[i][1])]
    return fit([t for _, t in found], [x for x, _ in found]) if found else None


def lowest(rows: DataFrame, label: str, most: int, seed: int) -> tuple[DataFrame, dict]:
    """The ``most`` rows (label, doc_id) of each label whose ids hash lowest, and the rows of each label.

    A threshold on the hash leaves about four times as many; these few are ranked.  Only bounded
    numbers of rows are moved, so a label with nearly all rows costs no more than another.
    """
    hashed = rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)))
    counts = {r[0]: r[1] for r in hashed.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).collect()}
    parts = []
    for value, n in sorted(counts.items()):
        own = hashed.where(F.col(label) == F.lit(value))
        # The hash is uniform: the share below the threshold holds four times ``most`` rows, give or take a few in a hundred.
        if n > 4 * most:
            own = own.where(F.col("h") <= F.lit(int(-(2.0**63) + 2.0**64 * 4.0 * most / n)))
        parts.append(own.orderBy("h", "doc_id").limit(most).select(label, "doc_id"))
    found = parts[0] if parts else rows.select(label, "doc_id").limit(0)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found, counts


def classify(docs: DataFrame, model: LanguageModel | None, keep: list[str] | None = None) -> DataFrame:
    """Label and score of every whole text; with ``keep``, the text and these columns too.

    What is sent to the tasks is the model, whose size the sample bounds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = ["text", *keep] if keep is not None else []

    def run(batches):
        m = shared.value
        table = m.table() if m else None
        for batch in batches:
            for at, part in slices(batch.column(1), 1 << 18, 256):
                texts = part.fill_null("")
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                n = len(part)
                pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if m and letters.any():
                    s = m.scores(texts, table)
                    best = s.argmax(1)
                    share = np.clip(s, 0.0, None)
                    share = share[np.arange(n), best] / np.maximum(share.sum(1), 1e-12)
                    pred[letters] = np.array(m.labels, object)[best[letters]]
                    score[letters] = np.clip(share[letters], 0.0, 1.0)
                own = [part, *[batch.column(3 + k).slice(at, n) for k in range(len(carried) - 1)]] if carried else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(pred, pa.string()), pa.array(score), *own], ["doc_id", "held_out", "lang_pred", "score", *carried])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        *(keep or []),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([SCHEMA, *[f"`{c}` {kinds[c]}" for c in carried]]))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return classify(docs, train(docs))
