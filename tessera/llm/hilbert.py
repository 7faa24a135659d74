"""Sharding along a Hilbert curve through several metadata dimensions.

Every dimension is quantised to ``bits`` bits, the cell's place on the Hilbert
curve is computed, documents are ordered by it and the order is cut into runs of
equal row counts.  Documents of a shard then lie close together in all dimensions,
so file statistics prune scans on any of them.

Only DataFrame operations are used.  The order's ranks come without a global sort:
counts per cell (a bounded number) are prefix-summed along the curve, a cell with
many rows is split by a hash into parts of about ``part_rows``, and rows are
numbered inside a part.  The texts themselves are never shuffled.

Defined results: a null text has size 1 and checksum 0; a very long text is a row like any other; null dimensions come first;
repeated rows take slots of their own; an empty table gives no rows; extra columns
are ignored.  Law ``rows``: shard counts differ by one at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

SHARDS = 8
BITS = 3
PART_ROWS = 4096


def _order_code(text: Column) -> Column:
    """The first four bytes of a string as a number that keeps byte order; shorter ones are padded with 0."""
    return F.conv(F.rpad(F.substring(F.hex(text.cast("binary")), 1, 8), 8, "0"), 16, 10).cast("long")


def quantised(df: DataFrame, dims: dict[str, Column], bits: int) -> DataFrame:
    """Adds ``q_<name>``: 0 to 2**bits - 1 by equal steps between the least and the greatest value, 0 for null.

    Strings count by the four bytes after what all values have in common, so
    that 'src0' and 'src9' differ; one aggregation finds all ranges.
    """
    strings = {c for c, x in dims.items() if dict(df.select(x.alias(c)).dtypes)[c] == "string"}
    ends = df.agg(*[f(dims[c]).alias(f"{k}_{c}") for c in dims for k, f in (("lo", F.min), ("hi", F.max))]).first()
    names = []
    for c, x in dims.items():
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if lo is None or lo == hi:
            code = F.lit(0)
        else:
            if c in strings:
                common = 0
                while common < min(len(lo), len(hi)) and lo[common] == hi[common]:
                    common += 1
                x = _order_code(F.substring(x, common + 1, 4))
                lo, hi = (int.from_bytes(v[common : common + 4].encode()[:4].ljust(4, b"\0"), "big") for v in (lo, hi))
            share = (x.cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo) or 1.0)
            code = F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(share * F.lit(float(1 << bits))))), F.lit(0))
        df = df.withColumn(f"q_{c}", code.cast("int"))
        names.append(f"q_{c}")
    return df


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve, by Skilling's transform written as folds over an array of coordinates."""
    n = len(coords)
    steps = [(q, i) for q in (1 << b for b in range(bits - 1, 0, -1)) for i in range(n)]
    start = F.array(*[c.cast("int") for c in coords])

    def undo(acc: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - F.lit(1)
        first, own = F.get(acc, F.lit(0)), F.get(acc, i)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        is_set = own.bitwiseAND(q) != 0
        return F.transform(
            acc,
            lambda x, j: F.when(is_set, F.when(j == 0, x.bitwiseXOR(low)).otherwise(x))
            .when((i != 0) & ((j == 0) | (j == i)), x.bitwiseXOR(swap))
            .otherwise(x),
        )

    if steps:
        plan = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])
        start = F.aggregate(plan, start, undo)
    # Gray code: every coordinate takes the exclusive or of those before it.
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>"),
        start,
        lambda acc, i: F.transform(acc, lambda x, j: F.when(j == i, x.bitwiseXOR(F.get(acc, i - 1))).otherwise(x)),
    )
    powers = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    flip = lambda xs: F.aggregate(powers, F.lit(0), lambda t, q: F.when(F.get(xs, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    turned = F.transform(F.array(gray), lambda xs: F.struct(xs.alias("xs"), flip(xs).alias("t")))
    place = F.transform(
        turned,
        lambda s: F.aggregate(
            F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)),
            F.lit(0).cast("long"),
            lambda acc, b: F.aggregate(
                s["xs"],
                acc,
                lambda a, x: a * F.lit(2).cast("long") + F.getbit(x.bitwiseXOR(s["t"]), b).cast("long"),
            ),
        ),
    )
    return F.get(place, F.lit(0))


def hilbert_shards(df: DataFrame, dims: dict[str, Column], order: list[str], shards: int, bits: int = BITS, part_rows: int = PART_ROWS, spread: Column | None = None) -> DataFrame:
    """Adds curve (long), shard (int) and slot (long); rows are ordered by curve, part of their cell and ``order``.

    ``spread``: a number that deals a cell's rows out to its parts, by default a hash of ``order``.
    ``df`` should hold only what the result needs.  Ties beyond ``order`` are rows
    that are equal in it, so that any of their orders gives the same table.
    """
    coords = [f"q_{c}" for c in dims]
    cells = quantised(df, dims, bits)
    counts = cells.groupBy(*coords).agg(F.count(F.lit(1)).alias("cell_rows")).withColumn("curve", hilbert_index([F.col(c) for c in coords], bits))
    # At most 2**(bits * dimensions) rows stand in this one window.
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(along), F.lit(0))).withColumn("total", F.sum("cell_rows").over(Window.partitionBy()))
    match = reduce(lambda a, b: a & b, [F.col(f"d.{c}") == F.col(f"t.{c}") for c in coords])
    parts = F.ceil(F.col("cell_rows") / F.lit(part_rows)).cast("long")
    rows = cells.alias("d").join(F.broadcast(table.alias("t")), match).select("d.*", "t.curve", "t.cell_start", "t.total", F.pmod(F.xxhash64(*order) if spread is None else spread, parts).alias("part")).drop(*coords)
    sizes = rows.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("part_rows"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("curve", "part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("curve", "part").orderBy(*order)
    numbered = rows.withColumn("in_part", F.row_number().over(inside)).join(starts, ["curve", "part"])
    rank = F.col("cell_start") + F.col("part_start") + F.col("in_part") - 1
    placed = numbered.withColumn("rank", rank).withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
    begin = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("rank") - begin).drop("part", "cell_start", "total", "part_start", "in_part", "rank")


def op3_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight runs along a curve through language, source, size and id."""
    text = F.col("text").cast("string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("bytes"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        "lang",
        "source",
    ).withColumn("size", F.col("bytes") + 1)
    dims = {"lang": F.col("lang"), "source": F.col("source"), "size": F.log2(F.col("size").cast("double")), "doc_id": F.col("doc_id")}
    # Ids and checksums together spread copies and repeated ids alike.
    placed = hilbert_shards(docs, dims, ["doc_id", "size", "text_crc32"], SHARDS, spread=F.coalesce("doc_id", F.lit(0)) + F.col("text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _curve_sql(bits: int, names: list[str]) -> str:
    """Skilling's transform of a table ``cells`` with coordinates x0, x1, ...: one nested query a step."""
    n = len(names)
    xs = [f"x{i}" for i in range(n)]
    query = "SELECT " + ", ".join(f"{c} AS {x}, {c}" for c, x in zip(names, xs)) + " FROM cells"
    keep = ", ".join(names)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            new = []
            for j, x in enumerate(xs):
                swap = f"xor({x}, xor(x0, x{i}) & {q - 1})" if i and j in (0, i) else x
                new.append(f"CASE WHEN x{i} & {q} <> 0 THEN {f'xor({x}, {q - 1})' if j == 0 else x} ELSE {swap} END AS {x}")
            query = f"SELECT {', '.join(new)}, {keep} FROM ({query})"
    for i in range(1, n):
        query = f"SELECT {', '.join(f'xor(x{i}, x{i - 1}) AS x{i}' if j == i else x for j, x in enumerate(xs))}, {keep} FROM ({query})"
    turn = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = f"xor({turn}, CASE WHEN x{n - 1} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    place = " + ".join(f"((xor(x{i}, t) >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))
    return f"SELECT {keep}, CAST({place} AS BIGINT) AS curve FROM (SELECT *, {turn} AS t FROM ({query}))"


def _oracle_sql() -> str:
    side = 1 << BITS
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    code = lambda v, skip: f"CAST('0x' || rpad(substr(hex(encode(substr({v}, {skip} + 1, 4))), 1, 8), 8, '0') AS BIGINT)"
    common = lambda c: f"(SELECT count(*) FROM (SELECT unnest(range(1, 1 + least(length(lo_{c}), length(hi_{c})))) AS k) WHERE substr(lo_{c}, 1, k) = substr(hi_{c}, 1, k))"
    cell = lambda v, lo, hi: f"coalesce(CAST(greatest(0, least({side - 1}, floor(({v} - {lo}) / ({hi} - {lo}) * {side}.0))) AS INTEGER), 0)"
    coords = []
    for c in ("lang", "source"):
        lo, hi = code(f"lo_{c}", f"skip_{c}"), code(f"hi_{c}", f"skip_{c}")
        coords.append(f"CASE WHEN lo_{c} = hi_{c} OR lo_{c} IS NULL THEN 0 ELSE {cell(code(c, f'skip_{c}') + '::DOUBLE', lo + '::DOUBLE', f'(CASE WHEN {hi} = {lo} THEN {lo} + 1 ELSE {hi} END)::DOUBLE')} END AS q_{c}")
    for c, v in (("size", "log2(size::DOUBLE)"), ("doc_id", "doc_id::DOUBLE")):
        coords.append(f"CASE WHEN lo_{c} = hi_{c} OR lo_{c} IS NULL THEN 0 ELSE {cell(v, f'lo_{c}', f'hi_{c}')} END AS q_{c}")
    names = ["q_lang", "q_source", "q_size", "q_doc_id"]
    same = " AND ".join(f"d.{n} = c.{n}" for n in names)
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents)
), ends AS (
  SELECT min(lang) AS lo_lang, max(lang) AS hi_lang, min(source) AS lo_source, max(source) AS hi_source,
    min(log2(size::DOUBLE)) AS lo_size, max(log2(size::DOUBLE)) AS hi_size, min(doc_id)::DOUBLE AS lo_doc_id, max(doc_id)::DOUBLE AS hi_doc_id FROM d
), cut AS (
  SELECT *, {common('lang')} AS skip_lang, {common('source')} AS skip_source FROM ends
), q AS (
  SELECT doc_id, size, text_crc32, {', '.join(coords)} FROM d, cut
), cells AS (
  SELECT {', '.join(names)}, count(*) AS cell_rows FROM q GROUP BY ALL
), curves AS (
  {_curve_sql(BITS, names)}
), parted AS (
  SELECT q.doc_id, size, text_crc32, curve, (((coalesce(q.doc_id, 0) + text_crc32) % ceil(d.cell_rows / {PART_ROWS}.0)::BIGINT) + ceil(d.cell_rows / {PART_ROWS}.0)::BIGINT) % ceil(d.cell_rows / {PART_ROWS}.0)::BIGINT AS part
  FROM q JOIN cells d USING ({', '.join(names)}) JOIN curves c ON {same}
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY curve, part, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, count(*) OVER () AS total FROM parted
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * {SHARDS} // total AS INTEGER) AS shard,
  CAST(rank - (rank * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve
FROM ranked"""


#: The same places by one sort; checksums byte by byte.
ORACLE_SQL = _oracle_sql()
