"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct runs of five words.  Two small collections of
``size`` keys each are computed, a key being a hash of ``rows`` minimum hashes, and
every pair of a left and a right key makes one of ``size * size`` tables.  So 2 * size
* rows minimum hashes do the work of size * size * 2 * rows.

Steps, all on classes of equal sets (copies are collapsed first, so that they
cost one member):

1. Signatures in one pass over the texts.
2. Classes that share a left key with another class; only they can share a table's
   key, which keeps the other classes out of the tables altogether.
3. Buckets of the tables.  In every bucket one member, the hub, is compared with
   the members of other components; links merge components, and buckets whose
   members are all of one component are finished.  The hub is the member that shares
   buckets with most others, which finds nearly all links of a group of copies.
4. What is left after ``hub_rounds`` is compared across components inside tasks, so
   that no link between components stays untested; only pairs that an exact bound
   cannot rule out leave the task.

A pair is confirmed on its full sets: 100 * shared >= 75 * united.

Defined results: null or empty texts and texts without words have an empty set and
link with nothing; texts of fewer words than five have one run, all of them; very long texts
have all their runs, counted in 32 bits a range; ties of fame go to the class of lower number; repeated
rows share a class; rows with equal ids and different texts are compared each, and an id goes by
``keep_one`` if any of its rows does; an empty table gives no rows; extra columns are ignored, or kept by
``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .storage import kept, without
from .textcore import BLANK_WORDS, Words, mix64, shingle_hashes, slices

WIDTH = 5
PERCENT = 75
SIZE = 8
ROWS = 2
HUB_ROUNDS = 1
#: Members of a bucket that are compared with as many others at once.
BLOCK = 1024
#: Runs are counted in ranges of hashes, which the top eight bits tell.
RANGE_BITS = 8
SIGNATURE = "id long, n_shingles long, hi long, lo long, left array<long>, right array<long>"

_STEP = 0x9E3779B97F4A7C15


def distinct_sets(words: Words, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct run hashes of each text."""
    h, d = shingle_hashes(words, width)
    cuts = np.searchsorted(d, np.arange(words.n + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        s = np.sort(h[a:b])
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def signatures(sets: list[np.ndarray], size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right keys of each set that is not empty, as two arrays of shape (sets, size)."""
    flat, begin = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.zeros((2 * size, len(sets)), np.uint64)
    for k in range(2 * size):
        for r in range(rows):
            seed = np.uint64((_STEP * (k * rows + r + 1)) & ((1 << 64) - 1))
            least = np.minimum.reduceat(mix64(flat + seed), begin)
            keys[k] = mix64(keys[k] * np.uint64(_STEP) + least)
    return keys[:size].T, keys[size:].T


def checksums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which tell sets apart; 0 for empty ones."""
    hi, lo = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    full = np.flatnonzero([len(s) for s in sets])
    if len(full):
        own = [sets[i] for i in full]
        flat, begin = np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1]
        hi[full], lo[full] = np.add.reduceat(mix64(flat + np.uint64(11)), begin), np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), begin)
    return hi.view(np.int64), lo.view(np.int64)


def signature_table(docs: DataFrame, width: int = WIDTH, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """Signature of every row of ``docs`` (id, text); an empty set has n_shingles 0 and no keys."""

    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                sets = distinct_sets(Words(part, BLANK_WORDS), width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                hi, lo = checksums(sets)
                left = right = [[]] * len(sets)
                if len(full):
                    a, b = signatures([sets[i] for i in full], size, rows)
                    left, right = list(left), list(right)
                    for k, i in enumerate(full):
                        left[i], right[i] = a[k].view(np.int64), b[k].view(np.int64)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n), pa.array(hi), pa.array(lo), pa.array(left, kind), pa.array(right, kind)], ["id", "n_shingles", "hi", "lo", "left", "right"])

    return docs.select("id", "text").mapInArrow(run, SIGNATURE)


def set_table(docs: DataFrame, width: int = WIDTH, carried: tuple[str, ...] = ()) -> DataFrame:
    """(n_shingles, hi, lo, runs, parts): the sorted run hashes of each text as bytes, and how many fall in each range; with ``carried`` columns of longs too."""

    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                sets = distinct_sets(Words(part, BLANK_WORDS), width)
                parts = [np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS).astype(np.uint32).tobytes() for s in sets]
                hi, lo = checksums(sets)
                n = pa.array([len(s) for s in sets], pa.int64())
                more = [batch.column(k + 1).slice(at, len(part)) for k in range(1, 1 + len(carried))]
                yield pa.RecordBatch.from_arrays([n, pa.array(hi), pa.array(lo), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(parts, pa.binary()), *more], ["n_shingles", "hi", "lo", "runs", "parts", *carried])

    return docs.select("id", "text", *carried).mapInArrow(run, ", ".join(["n_shingles long, hi long, lo long, runs binary, parts binary", *[f"{c} long" for c in carried]]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ca, cb) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(batch.schema.get_field_index("ra")), batch.column(batch.schema.get_field_index("rb"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(good))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    return with_b.select("a", "b", "ca", "cb", "ra", "rb").mapInArrow(run, "a long, b long, ca long, cb long")


def _bucket_pairs(members: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of members of a bucket that are of different components and can be similar enough.

    members: (key, c, rep, n, component, left, right, parts), c the bucket's size.  Buckets are
    compared in blocks of about ``BLOCK`` members, inside tasks.  A pair comes out only

    * in the first table that it shares, which its keys tell, so that it comes out once;
    * if the shared part can be large enough: two sets share no more than the sum over ranges of
      hashes of the smaller count.  Both tests are exact: no pair is lost.
    """
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("long")
    dealt = members.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    keyed = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("nb", "other", "c")
    ordered = keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def groups(table: pa.Table, cuts):
        col = {n: table.column(n).combine_chunks() if table.column(n).num_chunks != 1 else table.column(n).chunk(0) for n in table.column_names}
        rep, n, comp, own, i, j = (col[x].to_numpy() for x in ("rep", "n", "component", "own", "i", "j"))
        sides = [col[k].flatten().to_numpy().reshape(-1, size) for k in ("left", "right")]
        parts = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in col["parts"]), np.uint32).reshape(-1, 1 << RANGE_BITS)
        place = col["place"].to_numpy()
        out = []
        edges = [0, *cuts, table.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            p, q = np.nonzero(np.triu(comp[a:b, None] != comp[None, a:b], 1))
            if i[a] != j[a]:
                split = own[a:b][p] != own[a:b][q]
                p, q = p[split], q[split]
            p, q = p + a, q + a
            few, many = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
            fits = 100 * few >= percent * many
            p, q = p[fits], q[fits]
            for at in range(0, len(p), 1 << 15):
                x, y = p[at : at + (1 << 15)], q[at : at + (1 << 15)]
                first = [(s[x] == s[y]).argmax(1) for s in sides]
                mine = first[0] * size + first[1] == place[a]
                x, y = x[mine], y[mine]
                most = np.minimum(parts[x], parts[y]).sum(1, dtype=np.int64)
                able = 100 * most >= percent * (n[x] + n[y] - most)
                x, y = x[able], y[able]
                swap = rep[x] > rep[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                out.append((rep[x], rep[y], comp[x], comp[y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "ca", "cb"])

    def compare(batches):
        left: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*left, batch])
            marks = np.stack([table.column(x).to_numpy() for x in ("key", "i", "j")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            if done:
                yield from groups(table.slice(0, done), cuts[:-1])
            left = table.slice(done).to_batches()
        if left:
            yield from groups(pa.Table.from_batches(left), np.zeros(0, int))

    names = ["key", "i", "j", "own", "place", "rep", "n", "component", "left", "right", "parts"]
    return ordered.select(names).mapInArrow(compare, "a long, b long, ca long, cb long")


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, size: int = SIZE, rows: int = ROWS, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """(id, n_shingles, component) for every row of ``docs`` (id, text); component is its smallest id."""
    sigs = kept(signature_table(docs, width, size, rows), "signatures")
    same = ["n_shingles", "hi", "lo"]
    # Classes have numbers of their own, as rows with equal ids may have different texts.
    grouped = sigs.where(F.col("n_shingles") > 0).groupBy(*same).agg(F.min("id").alias("least"), F.first("left").alias("left"), F.first("right").alias("right"))
    classes = kept(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # A class that shares no left key can share no table's key.
    lefts = classes.select("rep", F.posexplode("left").alias("i", "k"))
    shared = lefts.groupBy("i", "k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    alive = lefts.join(shared, ["i", "k"]).select("rep").distinct()
    some = classes.join(alive, "rep", "left_semi")
    keys = F.flatten(F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(x, y, i * F.lit(size) + j))))
    tables = kept(some.select("rep", F.col("n_shingles").alias("n"), F.posexplode(keys).alias("place", "key")), "tables")
    full = tables.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    buckets = kept(tables.join(full, "key"), "buckets")
    # A member that shares buckets with many is likely near the middle of its group: the best of hubs.
    wanted = kept(buckets.groupBy("rep").agg(F.sum("c").alias("fame")), "wanted")
    compared = classes.join(wanted, "rep", "left_semi").select(F.col("least").alias("id"), "rep", *[F.col(c).alias(f"own_{c}") for c in same])
    # A class's set is that of a text with its checksums, whatever other texts have the same id.
    found = set_table(docs.select("id", "text").join(compared, "id"), width, ("rep", *[f"own_{c}" for c in same]))
    mine = (F.col("n_shingles") == F.col("own_n_shingles")) & (F.col("hi") == F.col("own_hi")) & (F.col("lo") == F.col("own_lo"))
    sets = kept(found.where(mine).select(F.col("rep").alias("id"), "runs", "parts").dropDuplicates(["id"]), "sets")
    labels = wanted.select("rep", F.col("rep").alias("component"))
    for turn in range(hub_rounds + 1):
        state = buckets.join(labels, "rep")
        spread = (F.min("component").alias("lo"), F.max("component").alias("hi"))
        if turn < hub_rounds:
            order = F.struct("fame", (-F.col("rep")).alias("rank"), F.col("component").alias("oc"), F.col("n").alias("on"))
            hubs = state.join(wanted, "rep").groupBy("key").agg(*spread, F.max(order).alias("hub")).where(F.col("lo") != F.col("hi"))
            hub = hubs.select("key", (-F.col("hub.rank")).alias("o"), F.col("hub.oc").alias("oc"), F.col("hub.on").alias("on"))
            fits = F.lit(100) * F.least("n", "on") >= F.lit(percent) * F.greatest("n", "on")
            met = state.join(hub, "key").where((F.col("component") != F.col("oc")) & fits)
            low = F.col("rep") < F.col("o")
            pairs = met.select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b"), F.when(low, F.col("component")).otherwise(F.col("oc")).alias("ca"), F.when(low, F.col("oc")).otherwise(F.col("component")).alias("cb")).distinct()
        else:
            open_ = state.groupBy("key").agg(*spread).where(F.col("lo") != F.col("hi")).select("key")
            marks = classes.select("rep", "left", "right").join(sets.select(F.col("id").alias("rep"), "parts"), "rep")
            pairs = _bucket_pairs(state.join(open_, "key").join(marks, "rep"), percent, size)
        links = _confirmed(kept(pairs, "pairs"), sets, percent)
        merged = components(links.select("ca", "cb"), "ca", "cb")
        merged = merged.select(F.col("id").alias("component"), F.col("component").alias("to"))
        labels = kept(labels.join(merged, "component", "left").select("rep", F.coalesce("to", "component").alias("component")), "labels")
    placed = classes.select(*same, "rep", "least").join(labels, "rep", "left").select(*same, "least", F.coalesce("component", "rep").alias("c"))
    named = placed.groupBy("c").agg(F.min("least").alias("component"))
    classed = placed.join(named, "c").select(*same, "component")
    return sigs.select("id", *same).join(classed, same, "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; all columns stay.

    Documents without an id are kept, as they cannot be told apart.
    """
    found = near_components(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text"), **options)
    gone = found.where(F.col("id") != F.col("component")).select(F.col("id").alias("doc_id"))
    return without(docs, gone, "doc_id").select(docs.columns)


def op5_minhash_tensored(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    found = near_components(docs)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
