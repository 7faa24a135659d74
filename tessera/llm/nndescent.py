"""Near-duplicate vectors with NN-descent.

Vectors are scaled to length one and exact copies collapsed to classes.  Vectors of each length are compared
among themselves:

1. Seeds: several times the vectors are ordered by the signs of random projections
   and compared with those that stand next to them; each keeps its ``k`` best.
2. Descent: round by round every vector's neighbours, forward and reverse, are
   compared with each other, as a neighbour's neighbour is likely a neighbour; lists
   keep the best ``k``.  Rounds end when few lists change.
3. A list all of whose entries reach the threshold is saturated: it may lack links.  Saturated lists, and
   only these, are doubled, and their neighbourhoods compared again, until they end below the threshold or
   hold ``DENSE`` entries.
4. Threshold edges of the lists are confirmed in double precision; they make components.
5. Vectors whose lists are saturated at ``DENSE`` stand in dense groups.  Their links are found exactly:
   they go out in bounded chunks and are compared with all vectors, block by block; a block that its centre and radius
   show to be linked with a vector as a whole, or not at all, is counted without a look at its members.  Links
   between components join them; no other pair leaves a task.
6. Audit: a bounded number of vectors with a neighbour near the threshold, and of the others, is drawn by
   hash and compared with all vectors.  If the share of linked vectors that have all their links falls short of ``RECALL``,
   ``k`` is doubled, fresh seeds are made, and the descent goes on.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do vectors of different lengths; very long vectors are like any other; ties of cosine in a list go to the greater
class number and change no link; repeated rows are copies that link with each other, also under one id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import components
from .storage import kept

THRESHOLD = 0.95
K = 6
SEEDS = 6
WINDOW = 24
#: Entries that a saturated list grows to before its vector's links are found exactly.
DENSE = 24
#: Vectors of dense groups that are sent to all tasks at a time, and those of a block that shares a centre.
CHUNK = 8192
CELL = 64
#: Rows of a batch that are compared with a chunk at once.
STEP = 2048
#: Members of a comparison group; larger neighbourhoods are split by a hash.
GROUP = 48
#: Vectors of each of the audit's two draws, and how far below the threshold a neighbour of the first one's is.
AUDIT = 1024
NEAR = 0.1
RECALL = 0.98
ROUNDS = 5


def unit_table(vectors: DataFrame) -> DataFrame:
    """(id, unit): the scaled vector as bytes of doubles, null for one that links with nothing."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = pc.fill_null(pc.list_flatten(column), np.nan).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(size)
            good = np.zeros(len(size), bool)
            if len(some):
                size_, begin = size[some], (np.cumsum(size) - size)[some]
                big = np.maximum.reduceat(np.abs(x), begin)
                fine = np.isfinite(big) & (big > 0)
                scale = np.where(fine, big, 1.0)  # keeps squares of huge or tiny components in range
                x = np.where(np.repeat(fine, size_), x, 0.0) / np.repeat(scale, size_)
                norm = np.sqrt(np.add.reduceat(x * x, begin))
                x = x / np.repeat(np.where(fine, norm, 1.0), size_)
                good[some] = fine
            ends = np.append(0, np.cumsum(8 * size)).astype(np.int32)
            valid = pa.py_buffer(np.packbits(good, bitorder="little"))
            units = pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, np.float64))])
            yield pa.RecordBatch.from_arrays([batch.column(0), units], ["id", "unit"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "id long, unit binary")


def _project(vectors: DataFrame, dims: int, table: int) -> DataFrame:
    """(table, code, along, m, x) in the order of random signs, for ``_windows``."""
    planes = np.random.default_rng(1000 + table).normal(size=(17, dims)).astype(np.float32)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            p = x @ planes.T
            code = ((p[:, :16] > 0) @ (1 << np.arange(16))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), table, np.int32)), pa.array(code), pa.array(p[:, 16].astype(np.float64)), batch.column(0), batch.column(1)], ["t", "code", "along", "m", "x"])

    return vectors.select("m", "x").mapInArrow(run, "t int, code long, along double, m long, x binary")


def _matrix(column: pa.Array, dims: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in column), kind).reshape(-1, dims)


def _best(ids: np.ndarray, sims: np.ndarray, floor: np.ndarray, k: int, out: list) -> None:
    """Adds (p, q, sim) of each row's ``k`` best columns above the row's floor."""
    np.fill_diagonal(sims, -2.0)
    sims[ids[:, None] == ids[None, :]] = -2.0
    n = len(ids)
    take = min(k, n - 1)
    if take < 1:
        return
    top = np.argpartition(-sims, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (n, 1))
    value = np.take_along_axis(sims, top, 1)
    good = value > floor[:, None]
    rows = np.nonzero(good)[0]
    out.append((ids[rows], ids[top[good]], value[good]))


def _edge_batches(out: list):
    if out:
        p, q, s = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(s.astype(np.float32))], ["p", "q", "sim"])


EDGE = "p long, q long, sim float"


def _seed_edges(vectors: DataFrame, dims: int, table: int, k: int) -> DataFrame:
    def windows(batches):
        left_ids, left_x = np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
        for batch in batches:
            ids = np.concatenate([left_ids, batch.column(0).to_numpy()])
            x = np.concatenate([left_x, _matrix(batch.column(1), dims)])
            out: list = []
            for a in range(0, len(ids), WINDOW // 2):
                own = slice(a, a + WINDOW)
                _best(ids[own], x[own] @ x[own].T, np.full(len(ids[own]), -2.0), k, out)
            left_ids, left_x = ids[-WINDOW // 2 :], x[-WINDOW // 2 :]
            yield from _edge_batches(out)

    ordered = _project(vectors, dims, table).repartitionByRange("code", "along", "m").sortWithinPartitions("code", "along", "m")
    return ordered.select("m", "x").mapInArrow(windows, EDGE)


def _lists(edges: DataFrame, wants: DataFrame | None, k: int) -> DataFrame:
    """(p, near, want, floor, gained): each vector's ``want`` best distinct neighbours (``k`` where ``wants`` has none), the least of their cosines if there are so many, and how many are new."""
    once = edges.groupBy("p", "q").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    lists = once.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("sim", "q", "new")), asc=False).alias("near"))
    lists = lists.withColumn("want", F.lit(k)) if wants is None else lists.join(wants, "p", "left").withColumn("want", F.coalesce("want", F.lit(k)))
    lists = lists.withColumn("near", F.expr("slice(near, 1, want)"))
    floor = F.when(F.size("near") >= F.col("want"), F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float")
    return lists.select("p", "near", "want", floor.alias("floor"), F.aggregate("near", F.lit(0), lambda n, e: n + e["new"]).alias("gained"))


def _entries(lists: DataFrame) -> DataFrame:
    return lists.select("p", F.explode("near").alias("e")).select("p", F.col("e.q").alias("q"), F.col("e.sim").alias("sim"), F.lit(0).alias("new"))


def _descend(lists: DataFrame, vectors: DataFrame, dims: int, only: DataFrame | None = None) -> DataFrame:
    """Edges that improve a list, from comparing every vector's neighbours with each other and with it.

    ``only`` (g): the vectors whose neighbourhoods are compared.
    """
    edges = lists.select("p", F.explode("near").alias("e")).select("p", F.col("e.q").alias("q"))
    members = edges.select(F.col("p").alias("g"), F.col("q").alias("m")).unionByName(edges.select(F.col("q").alias("g"), F.col("p").alias("m"))).distinct()
    if only is not None:
        members = members.join(only, "g", "left_semi")
    # A vector that many have as a neighbour makes several groups rather than a large one.
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    large = sizes.where(F.col("c") > GROUP)
    members = members.join(large, "g", "left").withColumn("s", F.when(F.col("c").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("m", "g"), F.ceil(F.col("c") / F.lit(GROUP)).cast("long")))).drop("c")
    # A list that is shorter than wanted, as after an enlargement, takes any neighbour.
    carried = vectors.join(lists.select(F.col("p").alias("m"), "floor", "want"), "m", "left").select("m", "x", F.coalesce("floor", F.lit(-2.0)).cast("float").alias("floor"), F.coalesce("want", F.lit(K)).alias("want"))
    rows = members.join(carried, "m").repartition("g", "s").sortWithinPartitions("g", "s")

    def compare(batches):
        left: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*left, batch]).combine_chunks()
            g, s = table.column("g").to_numpy(), table.column("s").to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (s[1:] != s[:-1])) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            yield from groups(table.slice(0, done), cuts[:-1])
            left = table.slice(done).to_batches()
        if left:
            yield from groups(pa.Table.from_batches(left), np.zeros(0, int))

    def groups(table: pa.Table, cuts):
        if not table.num_rows:
            return
        out: list = []
        ids, floor, want = (table.column(c).to_numpy() for c in ("m", "floor", "want"))
        x = _matrix(table.column("x").combine_chunks(), dims)
        edges = [0, *cuts, table.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                _best(ids[a:b], x[a:b] @ x[a:b].T, floor[a:b], int(want[a:b].max()), out)
        yield from _edge_batches(out)

    return rows.select("g", "s", "m", "x", "floor", "want").mapInArrow(compare, EDGE)


def _threshold_edges(lists: DataFrame, units: DataFrame, dims: int, threshold: float) -> DataFrame:
    """List edges confirmed in double precision."""
    near = lists.select("p", F.explode("near").alias("e")).where(F.col("e.sim") >= threshold - 1e-4)
    pairs = near.select(F.least("p", "e.q").alias("u"), F.greatest("p", "e.q").alias("v")).distinct()
    both = pairs.join(units.select(F.col("m").alias("u"), F.col("unit").alias("ux")), "u").join(units.select(F.col("m").alias("v"), F.col("unit").alias("vx")), "v")

    def confirm(batches):
        for batch in batches:
            a, b = _matrix(batch.column(2), dims, np.float64), _matrix(batch.column(3), dims, np.float64)
            yield batch.select(["u", "v"]).filter(pa.array((a * b).sum(1) >= threshold))

    return both.select("u", "v", "ux", "vx").mapInArrow(confirm, "u long, v long")


def _saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """Lists all of whose entries reach the threshold, give or take single precision."""
    return lists.where((F.size("near") >= F.col("want")) & (F.col("floor") >= threshold - 1e-4))


def _cells(ids: np.ndarray, own: np.ndarray, copies: np.ndarray, x: np.ndarray, threshold: float) -> dict:
    """Blocks of at most ``CELL`` rows of one component: first rows, components, copies, centres, and the
    least cosines to the centre of a vector that may link and of one that links with all of the block."""
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    cuts = np.concatenate([np.arange(a, b, CELL) for a, b in zip(start, np.append(start[1:], len(own)))])
    centres = np.add.reduceat(x, cuts, axis=0)
    norm = np.sqrt((centres * centres).sum(1, keepdims=True))
    centres = np.where(norm > 1e-9, centres / np.maximum(norm, 1e-9), x[cuts])
    sizes = np.diff(np.append(cuts, len(own)))
    radius = np.arccos(np.clip(np.minimum.reduceat((x * np.repeat(centres, sizes, axis=0)).sum(1), cuts), -1, 1))
    # By the triangle inequality of angles.
    reach = np.arccos(min(max(threshold, -1.0), 1.0))
    far, near = reach + radius + 1e-6, reach - radius - 1e-6
    return {
        "ids": ids, "x": x, "copies": copies, "cuts": np.append(cuts, len(own)), "of": own[cuts], "many": np.add.reduceat(copies, cuts), "centres": centres,
        "least": np.where(far >= np.pi, -2.0, np.cos(np.minimum(far, np.pi))), "whole": np.where(near <= 0, 2.0, np.cos(np.maximum(near, 0.0))),
    }


def _along(x: np.ndarray) -> np.ndarray:
    """An order of rows in which neighbours are alike: by their widest direction."""
    y = x - x.mean(0)
    v = y[np.argmax((y * y).sum(1))]
    for _ in range(5):
        v = y.T @ (y @ v)
        v = v / max(np.sqrt(v @ v), 1e-300)
    return y @ v


def _dense_links(placed: DataFrame, dense: DataFrame, dims: int, threshold: float) -> DataFrame | None:
    """(kind, u, v, n): all links of dense vectors.

    placed: (m, c, copies, unit) of all vectors, c the component.  kind 0: the dense vector u has n links to the
    rows of some task, copies counted, itself included; kind 1: vector u has n links to dense vectors of a chunk; kind 2: u and v are linked
    and of different components.
    """
    n = dense.count()
    if not n:
        return None
    spark = placed.sparkSession
    asked = placed.join(dense, "m").repartitionByRange(-(-n // CHUNK), "c", "m").sortWithinPartitions("c", "m").select("m", "c", "copies", "unit")

    def links(rows: list) -> DataFrame:
        ids, own, copies = (np.array([r[k] for r in rows]) for k in range(3))
        x = np.frombuffer(b"".join(bytes(r.unit) for r in rows), np.float64).reshape(-1, dims)
        order = np.lexsort((_along(x), own))
        shared = spark.sparkContext.broadcast(_cells(ids[order], own[order], copies[order], x[order], threshold))

        def run(batches):
            cell = shared.value
            cuts, of = cell["cuts"], cell["of"]
            each = np.diff(cuts)
            counts = np.zeros(len(cell["ids"]), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, STEP):
                    part = batch.slice(at, STEP)
                    m, c, many = (part.column(k).to_numpy() for k in range(3))
                    y = _matrix(part.column(3), dims, np.float64)
                    near = y @ cell["centres"].T
                    whole = near >= cell["whole"]
                    may = (near >= cell["least"]) & ~whole
                    counts += np.repeat(many @ whole, each)
                    own = whole @ cell["many"]
                    other = whole & (c[:, None] != of)
                    row, block = np.nonzero(other)
                    u, v = [m[row]], [cell["ids"][cuts[block]]]
                    for b in np.flatnonzero(may.any(0)):
                        rows = np.flatnonzero(may[:, b])
                        members = slice(cuts[b], cuts[b + 1])
                        linked = y[rows] @ cell["x"][members].T >= threshold
                        counts[members] += many[rows] @ linked
                        own[rows] += linked @ cell["copies"][members]
                        hit = linked.any(1) & (c[rows] != of[b])
                        u.append(m[rows[hit]])
                        v.append(cell["ids"][cuts[b] + linked[hit].argmax(1)])
                    some = own > 0
                    u, v = np.concatenate(u), np.concatenate(v)
                    kinds = np.repeat([1, 2], [some.sum(), len(u)])
                    yield _counted(kinds, np.concatenate([m[some], u]), np.concatenate([m[some], v]), np.concatenate([own[some], np.zeros(len(u), np.int64)]))
            some = counts > 0
            yield _counted(np.zeros(some.sum(), int), cell["ids"][some], cell["ids"][some], counts[some])

        found = kept(placed.select("m", "c", "copies", "unit").mapInArrow(run, "kind int, u long, v long, n long"), "dense")
        shared.unpersist()
        return found

    found, rows = None, []
    for row in asked.toLocalIterator():
        rows.append(row)
        if len(rows) == CHUNK:
            more, rows = links(rows), []
            found = more if found is None else found.unionByName(more)
    if rows:
        more = links(rows)
        found = more if found is None else found.unionByName(more)
    return found


def _counted(kind: np.ndarray, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(u), pa.array(v), pa.array(n.astype(np.int64))], ["kind", "u", "v", "n"])


def audit(classes: DataFrame, dims: int, threshold: float, most: int = AUDIT) -> float:
    """Estimated share of vectors with true links that have all of them.

    classes: (m, copies, unit, links, near, dense): ``links`` found, copies counted and the vector itself left out, ``near``: has a neighbour near
    the threshold.  ``most`` of the near ones and of the others, dense ones left out, are drawn by hash and compared with all vectors, so the
    cost is that of one pass; each draw counts for all that it was drawn from.  An exact answer is as good as its sample: of
    others without a sampled loss, up to about 3 in ``most`` may have lost links.
    """
    spark = classes.sparkSession
    pool = classes.where(~F.col("dense")).withColumn("h", F.xxhash64("m", F.lit(5)))
    sizes = {r.near: r.n for r in pool.groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [r for near in sizes for r in pool.where(F.col("near") == F.lit(near)).orderBy("h", "m").limit(most).collect()]
    if not drawn:
        return 1.0
    x = np.frombuffer(b"".join(bytes(r.unit) for r in drawn), np.float64).reshape(-1, dims)
    shared = spark.sparkContext.broadcast((np.array([r.m for r in drawn]), x))

    def run(batches):
        ids, x = shared.value
        links = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                near = x @ _matrix(part.column(2), dims, np.float64).T >= threshold
                near &= ids[:, None] != part.column(0).to_numpy()[None, :]
                links += near @ part.column(1).to_numpy()
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some])], ["m", "n"])

    true = {r.m: r.n for r in classes.select("m", "copies", "unit").mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).collect()}
    shared.unpersist()
    linked = whole = 0.0
    for near, n in sizes.items():
        own = [r for r in drawn if r.near == near]
        for r in own:
            # Copies of the vector itself are no matter of the search.
            if true.get(r.m, 0) > 0:
                linked += n / len(own)
                whole += n / len(own) * (r.links - (r.copies - 1) >= true[r.m])
    return whole / linked if linked else 1.0


def _groups(solid: DataFrame, dims: int, threshold: float, k: int, recall: float, rounds: int, most: int) -> DataFrame:
    """(unit, n_links, component) of the classes of vectors of one length."""
    grouped = solid.groupBy("unit").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    units = kept(grouped.withColumn("m", F.monotonically_increasing_id()), "classes")

    def single(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims, np.float64).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["m", "x"])

    n = units.count()
    if n == 1:
        return units.select("unit", (F.col("copies") - 1).alias("n_links"), F.col("least").alias("component"))
    vectors = kept(units.select("m", "unit").mapInArrow(single, "m long, x binary"), "singles")
    lists, wants, table = None, None, 0
    while True:
        # Fresh seeds at every size of the lists: descent alone cannot leave a part of the graph.
        edges = None if lists is None else _entries(lists)
        for table in range(table + 1, table + 1 + SEEDS):
            seeds = _seed_edges(vectors, dims, table, k).withColumn("new", F.lit(1))
            edges = seeds if edges is None else edges.unionByName(seeds)
        lists = kept(_lists(edges, wants, k), "lists")
        for _ in range(rounds):
            lists = kept(_lists(_entries(lists).unionByName(_descend(lists, vectors, dims).withColumn("new", F.lit(1))), wants, k), "lists")
            if (lists.agg(F.sum("gained")).first()[0] or 0) <= 0.02 * n * k:
                break
        while True:  # saturated lists, and only these, take twice as many
            full = kept(_saturated(lists, threshold).where(F.col("want") < DENSE).select("p", (F.col("want") * 2).alias("want")), "full")
            if not full.count():
                break
            rest = lists.where(F.col("want") > k).select("p", "want")
            wants = kept(full.unionByName(rest.join(full, "p", "left_anti")), "wants")
            wider = lists.drop("want", "floor").join(wants, "p", "left").withColumn("want", F.coalesce("want", F.lit(k)))
            wider = wider.withColumn("floor", F.when(F.size("near") >= F.col("want"), F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float"))
            better = _descend(wider, vectors, dims, full.select(F.col("p").alias("g")))
            lists = kept(_lists(_entries(lists).unionByName(better.withColumn("new", F.lit(1))), wants, k), "lists")
        strong = kept(_threshold_edges(lists, units, dims, threshold), "strong")
        labels = kept(components(strong).select(F.col("id").alias("m"), F.col("component").alias("c")), "labels")
        dense = kept(_saturated(lists, threshold).select(F.col("p").alias("m")), "saturated")
        placed = kept(units.join(labels, "m", "left").select("m", F.coalesce("c", "m").alias("c"), "copies", "unit"), "placed")
        found = _dense_links(placed, dense, dims, threshold)
        copies = units.select(F.col("m").alias("v"), "copies")
        both = strong.unionByName(strong.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(copies, "v")
        if found is None:
            counts = both.groupBy(F.col("u").alias("m")).agg(F.sum("copies").alias("links"))
        else:
            labels = kept(components(strong.unionByName(found.where("kind = 2").select("u", "v"))).select(F.col("id").alias("m"), F.col("component").alias("c")), "labels")
            # A dense vector's links are those that were counted; another's are those to dense ones and its list's to others.
            of_dense = found.where("kind = 0").groupBy(F.col("u").alias("m")).agg(F.sum("n").alias("links"))
            listed = both.join(dense.select(F.col("m").alias("v")), "v", "left_anti").select(F.col("u").alias("m"), F.col("copies").alias("links"))
            to_dense = found.where("kind = 1").select(F.col("u").alias("m"), F.col("n").alias("links"))
            of_others = listed.unionByName(to_dense).join(dense, "m", "left_anti").groupBy("m").agg(F.sum("links").alias("links"))
            own = units.select("m", "copies")  # a dense vector's own copies were counted with it
            counts = of_dense.join(own, "m").select("m", (F.col("links") - F.col("copies")).alias("links")).unionByName(of_others)
        near = lists.where(F.element_at("near", 1)["sim"] >= threshold - NEAR).select(F.col("p").alias("m"), F.lit(True).alias("near"))
        classes = units.join(counts, "m", "left").join(near, "m", "left").join(dense.withColumn("dense", F.lit(True)), "m", "left")
        classes = classes.select("m", "least", "copies", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("dense", F.lit(False)).alias("dense"))
        classes = kept(classes, "linked")
        if k >= n or audit(classes, dims, threshold, most) >= recall:
            break
        k *= 2
    named = classes.join(labels, "m", "left").select("unit", "least", "links", F.coalesce("c", "m").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component"))
    return named.join(least, "c").select("unit", F.col("links").alias("n_links"), "component")


def vector_groups(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, recall: float = RECALL, rounds: int = ROUNDS, most: int = AUDIT) -> DataFrame:
    """(id, n_links, component) of every row of ``vectors`` (id, vector)."""
    every = kept(unit_table(vectors.select("id", "vector")), "units")
    widths = sorted(r.w for r in every.where(F.col("unit").isNotNull()).select(F.octet_length("unit").alias("w")).distinct().collect())
    classed = None
    for w in widths:
        part = _groups(every.where(F.octet_length("unit") == w), w // 8, threshold, k, recall, rounds, most)
        classed = part if classed is None else classed.unionByName(part)
    if classed is None:
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = every.join(classed, "unit", "left")
    return found.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op1_nn_descent(spark, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    found = vector_groups(vectors)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
