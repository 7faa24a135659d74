"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared in three steps:

1. Seeds: places where ``width`` consecutive words (five unless told otherwise) of the document
   stand in the item too, found by hash in a table of all benchmark seeds.
2. Tiles: among the seeds, running Karp-Rabin matches are extended word by word;
   the longest match between unmarked words is marked in both texts, again and
   again, until no unmarked match of ``width`` words is left.
3. Coverage: marked words of the item over all its words.  Tiles may stand in any
   order, so reordered passages count as well as plain ones.

A document is contaminated if some item is covered to ``threshold`` or more.  Items
with fewer than ``width`` words are matched whole, as one tile.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text, so what
is broadcast has a bound however long the benchmark is (an item longer than that is a block of its
own); the benchmark is read once, each block is compared with
all documents and the best item of any block counts.

Defined results: null and empty documents are clean with coverage 0; a very long document
is one text like any other, tiled in memory that its seeds bound; null and empty
items match nothing; equal coverages go to the smaller item_id; repeated rows are
answered each; empty tables give no rows (documents) or clean ones (benchmark);
extra columns are ignored, or kept by ``remove_contaminated``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import kept, without
from .textcore import BLANK_WORDS, Words, shingle_hashes, slices

WIDTH = 5
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, coverage double, item_id long, n_tiles int, tiles array<struct<item_start:int,doc_start:int,words:int>>"


class SeedTable:
    """Hashes of all runs of ``width`` words of a block of items, with their places."""

    def __init__(self, ids: list[int], texts: list[str], width: int = WIDTH):
        self.ids, self.width = np.array(ids, np.int64), width
        w = Words(pa.array(texts, pa.string()), BLANK_WORDS)
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        h, item = shingle_hashes(w, width)
        first = np.searchsorted(item, np.arange(w.n))
        place = np.arange(len(item)) - first[item]
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.short = {i for i, x in enumerate(self.words) if 0 < len(x) < width}
        self.short_lengths = sorted({len(self.words[i]) for i in self.short})
        # A bit for the top 20 bits of each hash answers most lookups without a search.
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def seeds(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that some item has."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.hash, hashes[maybe])
        at[at == len(self.hash)] = 0
        return maybe[self.hash[at] == hashes[maybe]]

    def places(self, h) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        return self.item[lo:hi], self.place[lo:hi]


def tile(item: np.ndarray, doc: np.ndarray, seeds: dict[int, list[int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, document start, words) from seeds: document place -> item places.

    Matches are made maximal once per diagonal; the longest is marked first, ties go
    to the smaller places.  A match that lost words to a longer one is cut to its free
    parts and stays in the queue, so every round marks the longest match that is left.
    """
    diagonals: dict[int, list[int]] = defaultdict(list)
    for d, places in seeds.items():
        for i in places:
            diagonals[d - i].append(i)
    runs = []
    for diff, starts in diagonals.items():
        starts.sort()
        begin = last = starts[0]
        for i in [*starts[1:], None]:
            if i is not None and i == last + 1:
                last = i
                continue
            runs.append((last - begin + width, begin, begin + diff))
            begin = last = i
    marked_item, marked_doc = np.zeros(len(item), bool), set()
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, i, d in runs:
        by_length[n].append((i, d))
    tiles = []
    while by_length:
        n = max(by_length)
        for i, d in sorted(by_length.pop(n)):
            free = [not marked_item[i + k] and d + k not in marked_doc for k in range(n)]
            if all(free):
                marked_item[i : i + n] = True
                marked_doc.update(range(d, d + n))
                tiles.append((i, d, n))
                continue
            k = 0
            while k < n:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= width:
                    by_length[e - k].append((i + k, d + k))
                k = e + 1
    return sorted(tiles)


def best_item(table: SeedTable, words: np.ndarray, hashes: np.ndarray, hit: np.ndarray) -> tuple[float, int, list]:
    """Coverage, index and tiles of the item that the document covers most."""
    by_item: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for d in hit:
        for i, p in zip(*table.places(hashes[d])):
            if len(table.words[i]) >= table.width:
                by_item[int(i)][int(d)].append(int(p))
    best = (0.0, -1, [])
    for i in sorted(by_item, key=lambda i: table.ids[i]):
        tiles = tile(table.words[i], words, by_item[i], table.width)
        share = sum(n for _, _, n in tiles) / len(table.words[i])
        if share > best[0]:
            best = (share, i, tiles)
    return best


def _short_items(table: SeedTable, words: np.ndarray):
    """Items of fewer words than a seed that stand in the text whole."""
    for n in table.short_lengths:
        if len(words) >= n:
            grams = np.lib.stride_tricks.sliding_window_view(words, n)
            for i in sorted(table.short):
                if len(table.words[i]) == n:
                    at = np.flatnonzero((grams == table.words[i]).all(1))
                    if len(at):
                        yield i, int(at[0]), n


def _scan(docs: DataFrame, ids: list[int], texts: list[str], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches):
        table = SeedTable(*shared.value, width)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                w = Words(part)
                h, d = shingle_hashes(w, width)
                hit = table.seeds(h)
                begin = np.searchsorted(d, np.arange(w.n + 1))
                n = len(part)
                share, item, tiles = np.zeros(n), [None] * n, [[] for _ in range(n)]
                for i in np.unique(d[hit]):
                    own = hit[(hit >= begin[i]) & (hit < begin[i + 1])] - begin[i]
                    words = w.hash[w.first[i] : w.first[i + 1]]
                    if len(words) < width:
                        continue
                    share[i], k, found = best_item(table, words, h[begin[i] : begin[i + 1]], own)
                    if k >= 0:
                        item[i], tiles[i] = int(table.ids[k]), found
                if table.short:
                    for i in range(n):
                        for k, d0, words_in in _short_items(table, w.hash[w.first[i] : w.first[i + 1]]):
                            if share[i] < 1.0 or int(table.ids[k]) < item[i]:
                                share[i], item[i], tiles[i] = 1.0, int(table.ids[k]), [(0, d0, words_in)]
                kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))
                cells = [[dict(zip(("item_start", "doc_start", "words"), t)) for t in x] for x in tiles]
                columns = [batch.column(k).slice(at, n) for k in range(batch.num_columns) if k != 1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(share), pa.array(item, pa.int64()), pa.array([len(x) for x in tiles], pa.int32()), pa.array(cells, kind)], ["doc_id", "coverage", "item_id", "n_tiles", "tiles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """(ids, texts) of the benchmark, at most about ``block_bytes`` of text at a time."""
    ids, texts, held = [], [], 0
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    for r in rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if ids and held + len(r.text.encode()) > block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text.encode())
    if ids:
        yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: coverage, item_id, tiles and the decision ``contaminated``."""
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, second = next(blocks, ([], [])), next(blocks, None)
    if second is None:
        found = _scan(docs, *first, width)
    else:  # rows are told apart by a number that is the same in every block's scan; only rows with a tile are moved
        numbered = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()), "rows")
        together = None
        for ids, texts in (first, second, *blocks):
            scan = kept(_scan(numbered.select(F.col("row").alias("doc_id"), "text"), ids, texts, width).where(F.col("n_tiles") > 0), "tiles")
            together = scan if together is None else together.unionByName(scan)
        best = together.withColumn("key", F.struct("coverage", (-F.col("item_id")).alias("low"))).groupBy(F.col("doc_id").alias("row")).agg(F.max_by(F.struct("coverage", "item_id", "n_tiles", "tiles"), "key").alias("b"))
        none = F.array().cast("array<struct<item_start:int,doc_start:int,words:int>>")
        found = numbered.select("row", "doc_id").join(best, "row", "left").select(
            "doc_id", F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), "b.item_id", F.coalesce("b.n_tiles", F.lit(0)).alias("n_tiles"), F.coalesce("b.tiles", none).alias("tiles")
        )
    return found.withColumn("contaminated", F.col("coverage") >= threshold)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, with all their columns.

    The ids that go are few; they are anti-joined.  Rows without an id are
    decided by their text's hash as well, so the join has no null keys.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(key.alias("doc_id"), "text")
    bad = contamination(keyed, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("__key"))
    return without(docs.withColumn("__key", key), bad, "__key").drop("__key")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Coverage and decision for every whole document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contaminated", "coverage", "item_id", "n_tiles")
