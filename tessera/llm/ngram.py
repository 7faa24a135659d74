"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a three-word model with Dirichlet-smoothed interpolation,

    P1(w)       = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    P2(w | h)   = (c(h w) + MU[0] * P1(w)) / (c(h) + MU[0])
    P3(w | g h) = (c(g h w) + MU[1] * P2(w | h)) / (c(g h) + MU[1])

where h is the word before w and g the one before that, or the start of the text, which is
followed once by each text.  The model is made in three passes and asked in one:

1. Words: their counts make level 0, the sorted word hashes as one Elias-Fano sequence in
   shares of the hash range.  A word's place in it is its id.
2. N-grams: every task counts those of its texts and sends, for every word, its
   contexts; they meet in shares dealt out by word.  Words with very many tokens are dealt out by
   h as well, and pairs with very many by g, so that no share grows with a word.
3. Trie: a share has its words (level 1), under each the h before it (level 2), under each
   pair the g (level 3).  Contexts ascend under their parent and are made monotone by adding the parent's
   place times the universe, so a level is one Elias-Fano sequence; pointers from level to level are
   sequences too.  Level 2 has log P2 and the log of c(h w) + MU[1], level 3 the log of P3's numerator, each quantised
   to 16 bits.  All shares of a level are put end to end in one file of the shared folder.
4. Scores: every task maps the files and looks up the n-grams of its texts, each once
   a chunk and in ascending order: a successor search for the context, relative to its parent's base and between its parent's
   pointers.  A trigram's denominator is in the pair that the word before it made, so texts are
   scored where they are, and nothing of them is shuffled.

The levels are memory-mapped, so ``spark.checkpoint.dir`` must be a mounted folder (``file:``).

Defined results: a null text is empty and has the end token alone; very long texts are scored
whole, in chunks of tokens that know the words before them; repeated rows are
scored each and train the model each; ties do not arise; an empty table gives no rows; without training
rows all counts are 0 and P1 is 1 for the end; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .langid import held_out
from .storage import kept, shared_folder
from .textcore import BLANK_WORDS, Words, mix64, slices

MU = (1000.0, 1.0)
#: Tokens that a share should hold, and words of a share of level 0.
SHARE = 1_000_000
VOCABULARY = 1 << 20
LEAST_SHARES = 12
#: Text that is counted, and that is looked up, at once, and the most tokens of either.
CHUNK_BYTES = 4 << 20
LOOKUP_BYTES = 4 << 20
CHUNK = 2_000_000
#: A pair is sought among those with one in so many tokens of a chunk; there are at most as many hot ones.
PAIRS = 20_000
END = np.uint64(0x1D8E4E27C47D124F)
STEPS = 65535
#: Pairs that a task remembers with their places; a newer pair replaces an older one of the same slot.
REMEMBERED = 1 << 19
#: Range of hits within which a search looks at elements at once, without narrowing it by their high bits.
NEAR = 4


class EliasFano:
    """Monotone sequences, one a share, end to end: n integers below ``top`` in about 2 + log2(top / n) bits each.

    Elements count through all shares: those of share s are begin[s] to begin[s + 1] - 1.
    ``low`` has the low bits, ``high`` the others in unary; ``ranks`` and ``zeros`` are the ones and
    zeros before each of its words.
    """

    def __init__(self, begin, low_bits, low_at, high_at, low, high, ranks, zeros):
        self.begin, self.low_bits, self.low_at, self.high_at = begin, low_bits, low_at, high_at
        self.low, self.high, self.ranks, self.zeros = low, high, ranks, zeros

    @property
    def n(self) -> int:
        return int(self.begin[-1])

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = _pack(values & np.uint64((1 << low_bits) - 1), low_bits)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(top >> low_bits) + n + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ranks = _ranks(high)
        one = np.zeros(1, np.int64)
        return cls(np.array([0, n]), np.array([low_bits]), one, one, low, high, ranks, 64 * np.arange(len(high)) - ranks)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ranks": self.ranks, "zeros": self.zeros}

    def select(self, i: np.ndarray) -> np.ndarray:
        """Bit position of the i-th one (from 0)."""
        word = np.searchsorted(self.ranks, i, "right") - 1
        return word * 64 + _select_in_word(self.high[word], i - self.ranks[word])

    def select_zero(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, i, "right") - 1
        return word * 64 + _select_in_word(~self.high[word], i - self.zeros[word])

    def get(self, i: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        i = np.asarray(i, np.int64)
        share = np.zeros(len(i), np.int64) if share is None else share
        own = i - self.begin[share]
        bits = self.low_bits[share]
        high = (self.select(i) - self.high_at[share] - own).astype(np.uint64)
        return (high << bits.astype(np.uint64)) | _unpack(self.low, self.low_at[share] + own * bits, bits)

    def get_two(self, i: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements i and i + 1 of the same share; the second one's bit is the next one that is set."""
        own, bits = i - self.begin[share], self.low_bits[share]
        wide = bits.astype(np.uint64)
        at = self.select(i)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        rest = (self.high[word] >> bit) >> np.uint64(1)  # what follows the bit in its word
        after = at + 1 + _lowest(rest)
        none = np.flatnonzero(rest == 0)
        word = word[none]
        while len(none):
            word = word + 1
            held = self.high[word]
            after[none] = word * 64 + _lowest(held)
            none, word = none[held == 0], word[held == 0]
        base, place = self.high_at[share] + own, self.low_at[share] + own * bits
        first = ((at - base).astype(np.uint64) << wide) | _unpack(self.low, place, bits)
        return first, ((after - base - 1).astype(np.uint64) << wide) | _unpack(self.low, place + bits, bits)

    def _narrowed(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Long ranges cut to the elements with the value's high bits, which lie between two zeros."""
        lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
        far = np.flatnonzero(hi - lo > NEAR)
        if len(far):
            s = share[far]
            k = (value[far] >> self.low_bits[s].astype(np.uint64)).astype(np.int64)
            zero = self.high_at[s] - self.begin[s] + k  # that ends the run of elements whose high part is k
            first = np.where(k > 0, self.select_zero(np.maximum(zero - 1, 0)) - (zero - 1), lo[far])
            last = self.select_zero(zero) - zero
            lo[far], hi[far] = np.clip(first, lo[far], hi[far]), np.clip(last, lo[far], hi[far])
        return lo, hi

    def successor(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        """Least index in [lo, hi) whose element is at least ``value``; hi if there is none.

        A long range is first narrowed by its high bits; then all queries descend together: a range halves in each round.
        """
        share = np.zeros(len(lo), np.int64) if share is None else share
        lo, hi = self._narrowed(value, lo, hi, share)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self.get(mid, share[active]) < value[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        return lo

    def find(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Index in [lo, hi) of the element that equals ``value``, -1 if there is none.

        Successors in ranges of a few elements are found one element at a time, as most lists are short.
        """
        out = np.full(len(lo), -1, np.int64)
        lo, hi = self._narrowed(value, lo, hi, share)
        long = np.flatnonzero(hi - lo > NEAR)
        if len(long):
            lo[long] = self.successor(value[long], lo[long], hi[long], share[long])
            hi[long] = np.minimum(hi[long], lo[long] + 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            at = lo[active]
            found = self.get(at, share[active])
            equal = found == value[active]
            out[active[equal]] = at[equal]
            active = active[found < value[active]]
            lo[active] += 1
            active = active[lo[active] < hi[active]]
        return out


def _lowest(word: np.ndarray) -> np.ndarray:
    """Position of the lowest bit that is set; 64 where none is."""
    return np.bitwise_count(~word & (word - np.uint64(1))).astype(np.int64)


def _ranks(high: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(high).astype(np.int64)
    out = np.zeros(len(high) + 1, np.int64)
    np.cumsum(ones, out=out[1:])
    return out[:-1] if len(high) else np.zeros(1, np.int64)


_ONES, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Position of the k-th one of every byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)
#: Words that a pass over them handles at once, so that they stay in the cache.
_PASS = 1 << 14


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one of each 64-bit word: its byte by sums side by side in one word, then a table."""
    out = np.empty(len(word), np.int64)
    u = np.uint64
    for at in range(0, len(word), _PASS):
        x, n = word[at : at + _PASS], k[at : at + _PASS].astype(u)
        sums = x - ((x >> u(1)) & u(0x5555555555555555))
        sums = (sums & u(0x3333333333333333)) + ((sums >> u(2)) & u(0x3333333333333333))
        sums = ((sums + (sums >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * _ONES  # ones up to the end of each byte
        shift = np.bitwise_count((((n * _ONES) | _HIGHS) - sums) & _HIGHS).astype(u) << u(3)
        left = n - (((sums << u(8)) >> shift) & u(255))
        out[at : at + _PASS] = _IN_BYTE[((x >> shift) & u(255)).astype(np.int64), left.astype(np.int64)] + shift.astype(np.int64)
    return out


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, one after another in 64-bit words."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits:
        place = np.arange(n, dtype=np.int64) * bits
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        _or_at(out, word, values << shift)
        over = (shift + np.uint64(bits)) > np.uint64(64)
        _or_at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _or_at(out: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
    """Ors values into places; indices ascend, so runs are reduced at once."""
    if len(index):
        first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        out[index[first]] |= np.bitwise_or.reduceat(value, first)


def _unpack(words: np.ndarray, place: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """As many bits as ``bits`` says (63 at most) from each bit position."""
    word, shift, bits = place >> 6, (place & 63).astype(np.uint64), bits.astype(np.uint64)
    value = words[word] >> shift
    over = np.flatnonzero(shift + bits > np.uint64(64))
    value[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return value & ((np.uint64(1) << bits) - np.uint64(1))


# Files ------------------------------------------------------------------------------------------


def level_folder(spark: SparkSession) -> str:
    """A new folder for levels in the shared one, as a path of the file system."""
    uri = shared_folder(spark)
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"levels are memory-mapped: spark.checkpoint.dir must be a mounted folder (file:), not {uri}")
    path = uri.removeprefix("file://").removeprefix("file:")
    path = os.path.join(path, f"levels-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _write(path: str, data: bytes) -> None:
    """All or nothing, so that a task that is run again or twice does no harm."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def write_share(folder: str, share: int, sequences: dict[str, EliasFano], more: dict[str, np.ndarray]) -> list[int]:
    """Writes a share's arrays to one file; returns elements and low bits of each sequence, then the bytes of each array."""
    arrays = {f"{k}.{n}": a for k, x in sequences.items() for n, a in x.arrays().items()} | more
    _write(f"{folder}/{share}.part", b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()))
    return [x for e in sequences.values() for x in (e.n, int(e.low_bits[0]))] + [a.nbytes for a in arrays.values()]


@dataclass
class Kind:
    """Names of a level's sequences and arrays, and the types of all arrays."""

    sequences: tuple[str, ...]
    more: dict[str, str]

    def arrays(self) -> dict[str, str]:
        return {f"{s}.{n}": t for s in self.sequences for n, t in (("low", "<u8"), ("high", "<u8"), ("ranks", "<i8"), ("zeros", "<i8"))} | self.more


WORDS = Kind(("word",), {"count": "<i8"})
GRAMS = Kind(("word", "pair", "triple", "to_pair", "to_triple"), {"p2": "<u2", "mass": "<u2", "p3": "<u2"})


def put_together(spark: SparkSession, folder: str, kind: Kind, shares: int, metas: dict[int, list[int]]) -> None:
    """Puts the shares' arrays end to end, one file an array, and writes the directory of shares.

    Each task copies whole shares to places that are known beforehand, so a copy that is made twice writes the same bytes.
    """
    names, n = list(kind.arrays()), len(kind.sequences)
    meta = np.zeros((shares, 2 * n + len(names)), np.int64)
    for share, row in metas.items():
        meta[share] = row
    at = np.vstack([np.zeros((1, len(names)), np.int64), np.cumsum(meta[:, 2 * n :], axis=0)])
    begin = np.vstack([np.zeros((1, n), np.int64), np.cumsum(meta[:, 0 : 2 * n : 2], axis=0)])
    for name, size in zip(names, at[-1]):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(max(int(size), 8))
    with open(f"{folder}/directory", "wb") as f:
        np.savez(f, begin=begin, low_bits=meta[:, 1 : 2 * n : 2], at=at)
    rows = [(s, at[s].tolist(), meta[s, 2 * n :].tolist(), begin[s].tolist()) for s in sorted(metas)]
    if not rows:
        return
    todo = spark.createDataFrame(rows, "share long, at array<long>, size array<long>, begin array<long>")

    def copy(batches):
        for batch in batches:
            for r in batch.to_pylist():
                part = f"{folder}/{r['share']}.part"
                if not os.path.exists(part):  # it goes once all of it is copied
                    continue
                with open(part, "rb") as f:
                    for name, start, size in zip(names, r["at"], r["size"]):
                        data = f.read(size)
                        sequence, _, what = name.rpartition(".")
                        if what in ("ranks", "zeros") and size:  # ones and zeros of the shares before
                            k = kind.sequences.index(sequence)
                            ones = r["begin"][k]
                            bits = 8 * r["at"][names.index(f"{sequence}.high")]
                            data = (np.frombuffer(data, "<i8") + (ones if what == "ranks" else bits - ones)).tobytes()
                        handle = os.open(f"{folder}/{name}", os.O_WRONLY)
                        try:
                            done = 0
                            while done < len(data):
                                done += os.pwrite(handle, data[done:], start + done)
                        finally:
                            os.close(handle)
                os.remove(part)
            yield batch.select(["share"])

    todo.repartition(min(len(rows), max(2, spark.sparkContext.defaultParallelism))).mapInArrow(copy, "share long").collect()


@lru_cache(maxsize=8)
def _mapped(folder: str, sequences: tuple, more: tuple) -> tuple[dict, dict]:
    kind = Kind(sequences, dict(more))
    held = np.load(f"{folder}/directory")
    begin, low_bits, at = held["begin"], held["low_bits"], held["at"]
    arrays = {}
    for k, (name, t) in enumerate(kind.arrays().items()):
        arrays[name] = np.asarray(np.memmap(f"{folder}/{name}", t, "r"))[: int(at[-1, k]) // np.dtype(t).itemsize]
    names = list(kind.arrays())
    found = {}
    for k, s in enumerate(sequences):
        low, high = (8 * at[:-1, names.index(f"{s}.{x}")] for x in ("low", "high"))
        found[s] = EliasFano(np.ascontiguousarray(begin[:, k]), np.ascontiguousarray(low_bits[:, k]), low, high, *[arrays[f"{s}.{x}"] for x in ("low", "high", "ranks", "zeros")])
    return found, {n: arrays[n] for n in kind.more}


class Vocabulary:
    """Level 0: ids of words by hash, and their counts."""

    def __init__(self, folder: str, bits: int):
        found, more = _mapped(folder, WORDS.sequences, tuple(WORDS.more.items()))
        self.words, self.counts, self.bits = found["word"], more["count"], bits

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each word, -1 for one that is not there."""
        share = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        value = (hashes << np.uint64(self.bits)) >> np.uint64(self.bits)
        return self.words.find(value, self.words.begin[share], self.words.begin[share + 1], share)


# The corpus -------------------------------------------------------------------------------------


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, text, place in it) of every token of a batch, ends included.

    Words are cut and hashed in small slices, as that takes many times the memory of their text.
    """
    parts = [(at, _tokens(part)) for at, part in slices(column)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([x[k] + at if k == 1 else x[k] for at, x in parts]) for k in range(3))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = Words(column, BLANK_WORDS)
    n = w.n
    total = len(w.hash) + n
    token, doc = np.empty(total, np.uint64), np.repeat(np.arange(n), w.counts + 1)
    begin = w.first[:-1] + np.arange(n)
    is_end = np.zeros(total, bool)
    is_end[w.first[1:] + np.arange(n)] = True
    token[is_end] = END
    token[~is_end] = w.hash
    return token, doc, np.arange(total) - begin[doc]


def pair_hash(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix64(word + np.uint64(0x9E3779B97F4A7C15) * mix64(before))


def word_counts(docs: DataFrame) -> DataFrame:
    """(pair, token, c): the counts of all tokens of the training rows, and of pairs that are frequent in a chunk."""

    def run(batches):
        for batch in batches:
            for _, part in slices(batch.column(0), CHUNK_BYTES):
                token, _, place = token_stream(part)
                word, count = np.unique(token, return_counts=True)
                inner = np.flatnonzero(place > 0)
                pair, times = np.unique(pair_hash(token[inner], token[inner - 1]), return_counts=True)
                often = times * PAIRS > len(token)
                keys, counts = np.concatenate([word, pair[often]]), np.concatenate([count, times[often]])
                kind = np.arange(len(keys)) >= len(word)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys.view(np.int64)), pa.array(counts)], ["pair", "token", "c"])

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "pair boolean, token long, c long").groupBy("pair", "token").agg(F.sum("c").alias("c"))


@dataclass
class Corpus:
    """What every task must know: totals, where the levels are, how tokens are dealt out, and the hot pairs (``PAIRS`` at most)."""

    tokens: int
    types: int
    texts: int
    folder: str
    bits: int
    shares: int
    limit: int
    hot: np.ndarray
    ways: np.ndarray
    mu: tuple[float, float]

    def p1(self, count):
        return (count + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    #: Ids after those of words: the start of a text, a word that is not known, and, for counts alone, every g of a pair.
    start = property(lambda self: self.types)
    unknown = property(lambda self: self.types + 1)
    every = property(lambda self: self.types + 2)
    universe = property(lambda self: self.types + 3)

    @property
    def width(self) -> int:
        """Bytes of an id."""
        return -(-int(self.universe).bit_length() // 8)

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(f"{self.folder}/words", self.bits)

    def scale(self) -> tuple[float, float]:
        """Least log and step of all quantised logs: the corpus's totals bound them."""
        least = float(np.log10(min(self.mu[1], 1.0)) + np.log10(min(self.mu[0], 1.0)) + np.log10(self.p1(0)) - np.log10(self.tokens + self.texts + self.mu[0])) - 0.01
        most = float(np.log10(self.tokens + self.texts + max(self.mu))) + 0.01
        return least, (most - least) / STEPS

    def share_of(self, word: np.ndarray, h: np.ndarray, g: np.ndarray, count: np.ndarray, ways: np.ndarray) -> np.ndarray:
        """The share of each trigram: by its word, for hot words by h too, and for hot pairs by g."""
        base = mix64(word.astype(np.uint64)) % np.uint64(self.shares)
        spread = (count // self.limit + 1).astype(np.uint64)
        hot = np.flatnonzero(spread > 1)
        base[hot] += mix64(h[hot].astype(np.uint64) + np.uint64(77)) % spread[hot]
        hot = np.flatnonzero(ways > 1)
        base[hot] += mix64(g[hot].astype(np.uint64) + np.uint64(99)) % ways[hot].astype(np.uint64)
        return (base % np.uint64(self.shares)).astype(np.int64)

    def ways_of(self, pair: np.ndarray) -> np.ndarray:
        """Shares that a pair's trigrams are dealt out to, by the pair's hash."""
        out = np.ones(len(pair), np.int64)
        if len(self.hot):
            at = np.searchsorted(self.hot, pair)
            at[at == len(self.hot)] = 0
            hit = self.hot[at] == pair
            out[hit] = self.ways[at[hit]]
        return out


def corpus_of(docs: DataFrame, share: int = SHARE, mu: tuple[float, float] = MU) -> Corpus:
    """Counts words, writes level 0, and decides how tokens are dealt out."""
    spark = docs.sparkSession
    table = kept(word_counts(docs), "words")
    words = table.where(~F.col("pair")).select("token", "c")
    total = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("token") == int(END.view(np.int64)), F.col("c"))).alias("texts")).first()
    n, types = total.n or 0, total.v
    bits = max(0, (-(-types // VOCABULARY) - 1).bit_length())
    folder = level_folder(spark)
    os.makedirs(f"{folder}/words")
    os.makedirs(f"{folder}/grams")

    def write(table: pa.Table) -> pa.Table:
        hashes = table.column("token").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        own = (hashes[order] << np.uint64(bits)) >> np.uint64(bits)
        number = table.column("share")[0].as_py()
        counts = table.column("c").to_numpy()[order].astype("<i8")
        return pa.table({"share": [number], "meta": [write_share(f"{folder}/words", number, {"word": EliasFano.build(own, 1 << (64 - bits))}, {"count": counts})]})

    part = F.shiftrightunsigned("token", 64 - bits) if bits else F.lit(0).cast("long")
    metas = words.withColumn("share", part).groupBy("share").applyInArrow(write, "share long, meta array<long>").collect()
    put_together(spark, f"{folder}/words", WORDS, 1 << bits, {r.share: r.meta for r in metas})
    shares = max(LEAST_SHARES, -(-n // share))
    limit = max(1, share // 8)
    least = max(2 * limit, n // PAIRS)
    hot = sorted((int(np.int64(r.token).view(np.uint64)), r.c // limit + 1) for r in table.where(F.col("pair") & (F.col("c") >= least)).collect())
    return Corpus(n, types, total.texts or 0, folder, bits, shares, limit, np.array([x for x, _ in hot], np.uint64), np.minimum(np.array([y for _, y in hot], np.int64), shares), mu)


@dataclass
class Chunk:
    """The distinct trigrams of a run of tokens, ascending, as ids, with their number and share, and each token's trigram."""

    word: np.ndarray
    h: np.ndarray
    g: np.ndarray
    times: np.ndarray
    ways: np.ndarray
    share: np.ndarray
    of: np.ndarray | None
    token_count: np.ndarray  # by distinct token, then 0 for the start and an unknown word
    token_of: np.ndarray  # distinct token of each token
    word_of: np.ndarray  # distinct tokens of each trigram's word and h
    h_of: np.ndarray


def chunk_of(corpus: Corpus, vocabulary: Vocabulary, token: np.ndarray, place: np.ndarray, a: int, b: int, back: bool) -> Chunk:
    lo = max(0, a - 2)
    known, inverse = np.unique(token[lo:b], return_inverse=True)
    own, size = inverse[a - lo :], np.int64(len(known) + 1)
    at = np.arange(a, b) - lo
    h = np.where(place[a:b] >= 1, inverse[np.maximum(at - 1, 0)], len(known))
    g = np.where(place[a:b] >= 2, inverse[np.maximum(at - 2, 0)], len(known))
    key = (own * size + h) * size + g
    if back:
        key, of, times = np.unique(key, return_inverse=True, return_counts=True)
    else:
        (key, times), of = np.unique(key, return_counts=True), None
    pair, g = key // size, key % size
    w, h = pair // size, pair % size
    ids = vocabulary.find(known)
    count = np.append(np.where(ids >= 0, vocabulary.counts[np.maximum(ids, 0)] if len(vocabulary.counts) else 0, 0), 0)
    ids = np.append(np.where(ids >= 0, ids, corpus.unknown), corpus.start)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    hashes = np.append(known, np.uint64(0))
    ways = np.repeat(np.where(h[first] < len(known), corpus.ways_of(pair_hash(hashes[w[first]], hashes[h[first]])), 1), np.diff(np.append(first, len(pair))))
    share = corpus.share_of(ids[w], ids[h], ids[g], count[w], ways)
    return Chunk(ids[w], ids[h], ids[g], times, ways, share, of, count, own, w, h)


def _records(h: np.ndarray, g: np.ndarray, times: np.ndarray, width: int) -> np.ndarray:
    """(rows, 2 * width + 1) bytes: h, g, and a number up to 255."""
    out = np.empty((len(h), 2 * width + 1), np.uint8)
    for k, x in enumerate((h, g)):
        out[:, k * width : (k + 1) * width] = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    out[:, -1] = times
    return out


def _unrecord(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = []
    for k in (0, 1):
        full = np.zeros((len(data), 8), np.uint8)
        full[:, :width] = data[:, k * width : (k + 1) * width]
        found.append(full.view("<u8")[:, 0].astype(np.int64))
    return found[0], found[1], data[:, -1].astype(np.int64)


def gram_counts(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(share, word, contexts): for every word of a chunk of training texts the contexts it has there, with counts."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def rows(c: Corpus, x: Chunk):
        share, word, h, g, times = x.share, x.word, x.h, x.g, x.times
        hot = np.flatnonzero(x.ways > 1)
        if len(hot):  # the whole count of a hot pair goes to each of its shares
            pair = np.flatnonzero(np.append(True, (word[hot][1:] != word[hot][:-1]) | (h[hot][1:] != h[hot][:-1])))
            whole, first = np.add.reduceat(times[hot], pair), hot[pair]
            ways = x.ways[first]
            each = np.repeat(np.arange(len(first)), ways)
            count = x.token_count[x.word_of[first]]
            base = c.share_of(word[first], h[first], g[first], count, np.ones(len(first), np.int64))
            number = np.arange(len(each)) - np.repeat(np.cumsum(ways) - ways, ways)
            share = np.concatenate([share, (base[each] + number) % c.shares])
            word, h, times = (np.concatenate([old, new[each]]) for old, new in ((word, word[first]), (h, h[first]), (times, whole)))
            g = np.concatenate([g, np.full(len(each), c.every)])
        more = np.flatnonzero(times > 255)
        if len(more):  # a count that is too large for a byte is several
            again = (times[more] - 1) // 255
            twice = np.repeat(more, again)
            times = np.concatenate([np.where(times > 255, times - 255 * ((times - 1) // 255), times), np.full(len(twice), 255)])
            share, word, h, g = (np.concatenate([v, v[twice]]) for v in (share, word, h, g))
        order = np.lexsort((word, share)) if len(more) or len(hot) else np.argsort(share.astype(np.uint16 if c.shares < 1 << 16 else np.int64), kind="stable")
        share, word = share[order], word[order]
        first = np.flatnonzero(np.append(True, (share[1:] != share[:-1]) | (word[1:] != word[:-1])))
        data = _records(h[order], g[order], times[order], c.width)
        ends = (np.append(first, len(share)) * data.shape[1]).astype(np.int32)
        bodies = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        for at in range(0, len(first), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(share[first[own]]), pa.array(word[first[own]].astype(np.int64)), bodies[own]], ["share", "word", "contexts"])

    def run(batches):
        c = shared.value
        vocabulary = c.vocabulary()
        for batch in batches:
            for _, part in slices(batch.column(0), CHUNK_BYTES):
                token, _, place = token_stream(part)
                for a in range(0, len(token), CHUNK):
                    yield from rows(c, chunk_of(c, vocabulary, token, place, a, min(len(token), a + CHUNK), False))

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "share long, word long, contexts binary")


# The trie ---------------------------------------------------------------------------------------


def _starts(*columns: np.ndarray) -> np.ndarray:
    """First rows of runs of equal values."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def quantised(logs: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return np.clip(np.round((logs - scale[0]) / scale[1]), 0, STEPS).astype("<u2")


def trie_of(corpus: Corpus, counts: np.ndarray, word: np.ndarray, h: np.ndarray, g: np.ndarray, times: np.ndarray) -> tuple[dict, dict]:
    """Sequences and quantised logs of a share from its counts, in any order and repeated; ``counts`` are those of all words by id."""
    words, rank = np.unique(word, return_inverse=True)
    u, size = int(corpus.universe), max(1, len(words))
    if size * u * u < 1 << 63:
        key = (rank * np.int64(u) + h) * np.int64(u) + g
        order = np.argsort(key, kind="stable")
        del key
    else:
        order = np.lexsort((g, h, rank))
    rank, h, g, times = rank[order], h[order], g[order], times[order]
    first = _starts(rank, h, g)
    rank, h, g, times = rank[first], h[first], g[first], np.add.reduceat(times, first) if len(first) else times
    pair = _starts(rank, h)
    all_ = g == corpus.every
    n2 = np.add.reduceat(np.where(all_, 0, times), pair) if len(pair) else times
    of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(rank))))
    n2[of_pair[all_]] = times[all_]
    of, g3, n3 = of_pair[~all_], g[~all_], times[~all_]
    # Logs of the smoothed probabilities.
    before = np.append(counts, [corpus.texts, 0, 0])  # of the start, and none
    mu, scale = corpus.mu, corpus.scale()
    p2 = (n2 + mu[0] * corpus.p1(counts[words])[rank[pair]]) / (before[h[pair]] + mu[0]) if len(pair) else np.zeros(0)
    logs = {"p2": np.log10(p2), "mass": np.log10(n2 + mu[1]), "p3": np.log10(n3 + mu[1] * p2[of])}
    build = EliasFano.build
    pair_key = rank[pair].astype(np.uint64) * np.uint64(u) + h[pair].astype(np.uint64)
    triple_key = of.astype(np.uint64) * np.uint64(u) + g3.astype(np.uint64)
    to_pair = np.searchsorted(rank[pair], np.arange(len(words) + 1))
    to_triple = np.searchsorted(of, np.arange(len(pair) + 1))
    sequences = {
        "word": build(words, u), "pair": build(pair_key, size * u), "triple": build(triple_key, max(1, len(pair)) * u),
        "to_pair": build(to_pair, len(pair) + 1), "to_triple": build(to_triple, len(of) + 1),
    }
    return sequences, {k: quantised(v, scale) for k, v in logs.items()}


def build_trie(docs: DataFrame, corpus: Corpus) -> None:
    """Writes levels 1 to 3."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(corpus)

    def write(table: pa.Table) -> pa.Table:
        c = shared.value
        number = table.column("share")[0].as_py()
        body = table.column("contexts").combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        _, ends, data = body.buffers()
        wide = np.int64 if pa.types.is_large_binary(body.type) else np.int32
        ends = np.frombuffer(ends, wide)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        size = 2 * c.width + 1
        h, g, times = _unrecord(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, size), c.width)
        word = np.repeat(table.column("word").to_numpy(), np.diff(ends) // size)
        meta = write_share(f"{c.folder}/grams", number, *trie_of(c, c.vocabulary().counts, word, h, g, times))
        return pa.table({"share": [number], "meta": [meta]})

    metas = gram_counts(docs, corpus).groupBy("share").applyInArrow(write, "share long, meta array<long>").collect()
    put_together(spark, f"{corpus.folder}/grams", GRAMS, corpus.shares, {r.share: r.meta for r in metas})


class Trie:
    """The mapped levels 1 to 3 of all shares."""

    def __init__(self, corpus: Corpus):
        found, logs = _mapped(f"{corpus.folder}/grams", GRAMS.sequences, tuple(GRAMS.more.items()))
        self.corpus, self.scale = corpus, corpus.scale()
        self.word, self.pair, self.triple, self.to_pair, self.to_triple = (found[k] for k in GRAMS.sequences)
        self.p2, self.mass, self.p3 = (logs[k] for k in GRAMS.more)
        self.keys = np.zeros(REMEMBERED, np.uint64)
        self.held = np.zeros((REMEMBERED, 3), np.int64)  # place and the ends of its triples

    def log(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.scale[0] + self.scale[1] * level[at]

    @staticmethod
    def _below(parent: EliasFano, pointers: EliasFano, child: EliasFano, at: np.ndarray, share: np.ndarray):
        """The places of the children of parents ``at``.  A share has one pointer more than parents."""
        own = at + share
        begin = child.begin[share]
        lo, hi = pointers.get_two(own, share)
        return begin + lo.astype(np.int64), begin + hi.astype(np.int64)

    def _pairs(self, share: np.ndarray, word: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Places of ascending pairs (-1 for one that is not there) and the ends of the ranges of their triples."""
        out = np.zeros((len(share), 3), np.int64)
        out[:, 0] = -1
        first = _starts(share, word)
        s = share[first]
        at = self.word.find(word[first].astype(np.uint64), self.word.begin[s], self.word.begin[s + 1], s)
        lo, hi = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        known = np.flatnonzero(at >= 0)
        if len(known):
            lo[known], hi[known] = self._below(self.word, self.to_pair, self.pair, at[known], s[known])
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(share))))
        known = np.flatnonzero(at[of] >= 0)
        if len(known):
            sk, ok = share[known], of[known]
            value = (at[ok] - self.word.begin[sk]).astype(np.uint64) * np.uint64(self.corpus.universe) + h[known].astype(np.uint64)
            out[known, 0] = self.pair.find(value, lo[ok], hi[ok], sk)
        seen = np.flatnonzero(out[:, 0] >= 0)
        if len(seen):
            out[seen, 1], out[seen, 2] = self._below(self.pair, self.to_triple, self.triple, out[seen, 0], share[seen])
        return out

    def look_up(self, x: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """By distinct trigram of a chunk: the log of P3's numerator, and the log of c(h w) + MU[1]."""
        c, u = self.corpus, np.uint64(self.corpus.universe)
        order = np.argsort(x.share.astype(np.uint16 if c.shares < 1 << 16 else np.int64), kind="stable")
        share, word, h, g = x.share[order], x.word[order], x.h[order], x.g[order]
        # Pairs that were asked before are remembered.
        pair = _starts(share, word, h)
        s, w = share[pair], word[pair]
        key = mix64(mix64(w.astype(np.uint64) + (s.astype(np.uint64) << np.uint64(40))) + h[pair].astype(np.uint64)) | np.uint64(1)
        slot = (key >> np.uint64(32)).astype(np.int64) & (REMEMBERED - 1)
        held = self.held[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            held[new] = self._pairs(s[new], w[new], h[pair[new]])
            self.keys[slot[new]] = key[new]
            self.held[slot[new]] = held[new]
        place, lo, hi = held.T
        seen = np.flatnonzero(place >= 0)
        count = x.token_count
        before = np.where(h[pair] == c.start, c.texts, count[x.h_of[order][pair]])
        p2 = np.log10(c.mu[0] * c.p1(count[x.word_of[order][pair]])) - np.log10(before + c.mu[0])
        mass = np.full(len(pair), np.log10(c.mu[1]))
        p2[seen], mass[seen] = self.log(self.p2, place[seen]), self.log(self.mass, place[seen])
        # Triples, under their pairs.
        of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(share))))
        number = np.log10(c.mu[1]) + p2[of]
        if len(seen):
            asked = np.flatnonzero(hi[of] > lo[of])
            o, sa = of[asked], share[asked]
            value = (place[o] - self.pair.begin[sa]).astype(np.uint64) * u + g[asked].astype(np.uint64)
            hit = self.triple.find(value, lo[o], hi[o], sa)
            found = np.flatnonzero(hit >= 0)
            number[asked[found]] = self.log(self.p3, hit[found])
        out = np.empty(len(order)), np.empty(len(order))
        out[0][order], out[1][order] = number, mass[of]
        return out


#: The trie that this worker process asked last, with the pairs that it remembers.
_TRIES: dict[str, Trie] = {}


def trie_at(corpus: Corpus) -> Trie:
    if corpus.folder not in _TRIES:
        _TRIES.clear()
        _TRIES[corpus.folder] = Trie(corpus)
    return _TRIES[corpus.folder]


def score(docs: DataFrame, mu: tuple[float, float] = MU, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text, held_out)."""
    corpus = corpus_of(docs, share, mu)
    build_trie(docs, corpus)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches):
        c = shared.value
        vocabulary, trie = c.vocabulary(), trie_at(c)
        first = float(np.log10(c.texts + c.mu[1]))
        for batch in batches:
            for at, part in slices(batch.column(1), LOOKUP_BYTES):
                n = len(part)
                token, doc, place = token_stream(part)
                sums, last = np.zeros((3, n)), first
                for a in range(0, len(token), CHUNK):
                    b = min(len(token), a + CHUNK)
                    x = chunk_of(c, vocabulary, token, place, a, b, True)
                    number, mass = trie.look_up(x)
                    x.word = x.h = x.g = x.times = x.ways = x.share = x.word_of = x.h_of = None
                    mass = mass[x.of]
                    under = np.append(last, mass[:-1])  # the pair that the word before made
                    under[place[a:b] == 0] = first
                    last = mass[-1]
                    count = x.token_count[x.token_of]
                    low, high = doc[a], doc[b - 1] + 1
                    for k, v in enumerate((number[x.of] - under, np.log10(c.p1(x.token_count))[x.token_of], count > 0)):
                        sums[k, low:high] += np.bincount(doc[a:b] - low, v, high - low)
                n_tokens = np.bincount(doc, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(n_tokens), pa.array(sums[2].astype(np.int64)), pa.array(np.full(n, c.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[0])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_ngram_trie_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all whole documents by a model of the training ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id"), 5, 1), F.lit(False))))
