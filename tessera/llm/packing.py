"""Best-fit packing of tokenised documents into fixed-length sequences.

Three steps, none of which gathers more than a bounded number of pieces:

1. ``token_pieces`` tokenises whole texts and cuts those longer than a
   sequence.  A document of T tokens gives T // capacity full pieces, preceded by
   one piece of the remainder; only the remainders need packing.
2. Pieces are dealt by a hash into groups of about ``group_size`` and each group
   is packed: best fit on descending lengths, then a swap-based local search that
   moves a document, or exchanges one for one or two for one, between underfull
   bins whenever this raises the sum of squared fills, until bins empty.
3. Bins that stay underfull give their pieces back; these few are dealt into
   groups of their own and packed again, so the waste of a group's last bins
   is not paid once per group.

Defined results: a null or empty text is the end token alone; a very long text is
tokenised whole and makes as many full pieces as it fills; a text that spells an added token gets
that token's id, as the library has it; repeated rows are
packed as rows of their own; ties of length are broken by (doc_id, piece); an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
GROUP_SIZE = 6000
#: Underfull bins that are searched together.
SCAN = 400
#: Entries that a worker's cache of encoded words holds before it starts anew.
CACHE_ENTRIES = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: A space before a character that is not white space starts a new pre-token of
#: byte-level BPE whatever stands around it, so a text may be cut there.
_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r"(?= \S)")


#: The pattern that byte-level BPE with its usual settings cuts texts by.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def own_encoder(path: str):
    """The library's function from text to ids, and the file's content."""
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, spec


def fast_encoder(path: str):
    """A function from text to ids, the same as the tokenizer file's.

    For a byte-level BPE whose merges make tokens in the order of their ids, merging by
    the lowest id is the same as merging by rank, and a faster engine does that.  Any other
    file goes through its own library, and so does every text that holds an added token.
    """
    plain, spec = own_encoder(path)
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        return plain
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])) or (made and made[0] < 0):
        return plain
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordEncoder(dict):
    """Little-endian 32-bit ids of a text, by way of a cache of its words.

    A byte-level BPE never merges across pre-tokens, so ids of a text are those
    of its parts put together.  The cache only saves time: it is cleared when full.
    Added tokens may stand anywhere, inside a word too; a text that holds one goes to the library whole.
    """

    def __init__(self, path: str, most: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.most = fast_encoder(path), most
        self.plain, spec = own_encoder(path)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) < 64:
            if len(self) >= self.most:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            ids = self.plain(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        if _ODD_SPACE.search(text):
            parts = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + x for x in rest]]
        return b"".join(map(self.__getitem__, parts))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of every document: its place, its length, and the CRC-32 of its ids."""

    def cut(batches):
        enc, end = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.ids(text.as_py() or "") + end
                total = len(ids) // 4
                at, piece, take = 0, 0, total % capacity or capacity
                while at < total:
                    rows.append((doc_id, piece, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)])))
                    at, piece, take = at + take, piece + 1, capacity
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths, capacity: int) -> list[list[int]]:
    """Best fit on descending lengths: bins as lists of indices into ``lengths``."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # distinct rooms that have a bin, ascending
    for i in order:
        size = lengths[i]
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def swap_search(bins: list[list[int]], lengths, capacity: int) -> list[list[int]]:
    """Local search over underfull bins; every step raises the sum of squared fills.

    For two bins with the fuller one first, any change that moves a net amount into
    the fuller bin without overfilling it raises that sum.  Tried in this order:
    move a document over, exchange one for one, two for one.  Bins that come out
    empty are dropped.  Stops at a round without a change, which comes, as the sum rises with
    every change and is bounded.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: -fill[b])
        changed = False
        for low in reversed(under):  # try to empty the least filled bin into fuller ones
            if not bins[low]:
                continue
            for high in under:
                if high == low or not bins[low] or fill[high] < fill[low] or fill[high] >= capacity:
                    continue
                change = _better(bins[high], bins[low], lengths, capacity - fill[high])
                if change:
                    out, into = change
                    gain = sum(lengths[i] for i in into) - sum(lengths[i] for i in out)
                    bins[high] = [i for i in bins[high] if i not in out] + list(into)
                    bins[low] = [i for i in bins[low] if i not in into] + list(out)
                    fill[high], fill[low], changed = fill[high] + gain, fill[low] - gain, True
    return [b for b in bins if b]


def _better(high: list[int], low: list[int], lengths, room: int):
    """(leave the fuller bin, enter it) with the greatest net gain of 1 to ``room``; None if there is none."""
    best, found = 0, None
    for i in low:
        if best < lengths[i] <= room:
            best, found = lengths[i], ((), (i,))
    if best == room:
        return found
    sizes = sorted((lengths[i], i) for i in low)
    keys = [s for s, _ in sizes]
    for j in high:
        out = lengths[j]
        at = bisect.bisect_right(keys, out + room) - 1
        if at >= 0 and best < keys[at] - out <= room:
            best, found = keys[at] - out, ((j,), (sizes[at][1],))
            if best == room:
                return found
        lo, hi = 0, len(sizes) - 1  # two of the low bin for one of the high one
        while lo < hi:
            gain = keys[lo] + keys[hi] - out
            if gain > room:
                hi -= 1
            else:
                if gain > best:
                    best, found = gain, ((j,), (sizes[lo][1], sizes[hi][1]))
                lo += 1
        if best == room:
            return found
    return found


def pack_group(lengths, capacity: int, scan: int = SCAN) -> list[list[int]]:
    """Best fit, then the local search over underfull bins (full ones have nothing to gain).

    Underfull bins are searched in sets of ``scan``, the least filled first, and sets are made
    anew while they lose bins.  The search ends early only where there can be no fewer bins.
    """
    bins = best_fit(lengths, capacity)
    least = -(-sum(lengths) // capacity)
    while len(bins) > least:
        fills = [sum(lengths[i] for i in b) for b in bins]
        under = sorted((b for b in range(len(bins)) if fills[b] < capacity), key=lambda b: fills[b])
        found = [bins[b] for b in range(len(bins)) if fills[b] == capacity]
        for at in range(0, len(under), scan):
            part = [bins[b] for b in under[at : at + scan]]
            enough = len(found) + len(under) - at <= least
            found += part if enough else swap_search(part, lengths, capacity)
        if len(found) == len(bins):
            return found
        bins = found
    return bins


def _pack_level(pieces: DataFrame, groups: int, level: int, capacity: int, last: bool) -> DataFrame:
    """Packs each group; ``done`` marks rows whose bin is final."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        group = table.column("grp")[0].as_py()
        lengths = table.column("length").to_pylist()
        n = len(lengths)
        bin_of, offset, done = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for b, members in enumerate(pack_group(lengths, capacity)):
            at = 0
            for i in members:
                bin_of[i], offset[i], at = b, at, at + lengths[i]
            done[members] = last or at == capacity
        number = (np.int64(level) << np.int64(60)) + (np.int64(group) << np.int64(24)) + bin_of
        return pa.table({**{c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": number, "offset": offset, "done": done})

    schema = PACKED + ", done boolean"
    # The row's place in the written table is hashed too, so that many equal rows do not make one group.
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(pack, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``token_pieces``.

    Bins of the first level that are exactly full are final; all others give back
    their pieces, which are packed again in groups of the same size.  The
    number of groups follows the number of pieces, so no task grows with the input.
    """
    from .storage import kept

    pieces = kept(pieces, "pieces")
    short = pieces.where(F.col("length") < capacity)
    n = short.count()
    whole = pieces.where(F.col("length") == capacity)
    first = kept(_pack_level(short, max(1, -(-n // group_size)), 0, capacity, False), "packed")
    rest = first.where(~F.col("done")).drop("done", "sequence_id", "offset")
    left = rest.count()
    second = _pack_level(rest, max(1, -(-left // group_size)), 1, capacity, True)
    full = whole.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 61)).withColumn("offset", F.lit(0).cast("long"))
    names = [c.split()[0] for c in PACKED.split(", ")]
    return first.where("done").select(names).unionByName(second.select(names)).unionByName(full.select(names))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
