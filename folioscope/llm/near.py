"""Pairs of files with nearly the same text: vantage-point trees over Hamming fingerprints, then an exact test.

A text is the set of its sequences of three consecutive words.  Texts with the same set are one
class.  The fingerprint of a set has a bit for each hash value and flips one bit for each member, so the
Hamming distance of two fingerprints is never more than the number of members that only one set has.
Two sets of n and m members with at least TIMES / OF of all members in common differ in at most
(n + m) * (OF - TIMES) / (OF + TIMES) members: within this radius no pair is lost.

One tree over everything would prune nothing, as all texts are about equally far from each other;
so the collection is cut into overlapping shards first.  Each set's members are ordered with the
frequent ones last (counted over all texts in a sketch of fixed size); two similar sets share one of
their first (1 - TIMES / OF) * n + 1 members, at places that leave room enough for the rest.  A member
is a shard, and a text lies in the shard of each of its first members that it shares with a
text it could be similar to.  In a shard the texts form a vantage-point tree: by the distance to a
vantage point the rest is split at the median, and a query with radius r visits a branch only if
the triangle inequality allows a hit; all texts of a block are looked up together.  In a leaf only
those pairs are measured whose places leave room enough, as the first common member of similar texts
does: a shard grows with the collection, so its pairs must cost next to nothing.  A shard with more
than SHARD texts is cut into blocks, and every pair of blocks is searched by a task of its own.  Pairs
within the radius are compared in full.

Defined cases: null, empty and short texts (under LEAST_WORDS words) are in no pair; rows repeated
under one id count once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.graph import cut

#: Least words of a text; least share of common sequences, as a fraction.
LEAST_WORDS, TIMES, OF = 40, 3, 5
#: Buckets of the sketch of counts, whatever the size of the collection, and its pieces; steps of a rank, which is a count's logarithm, to a doubling.
BUCKETS, PIECES, STEPS = 1 << 24, 64, 8
#: Texts of a leaf of a tree; texts of a shard that one task searches; ids that are sent to every executor at most.
LEAF, SHARD, SENT = 48, 4096, 1_000_000
#: A member counted more often than HOT and four times the sketch's mean is split over all parts and its texts go to its shard unfiltered.
HOT, _SPLIT = 50_000, 1 << 31
_WORD = re.compile(r"[^\W_]+")
#: Places of the words in _table, given out in the order in which they come.
_index: defaultdict[str, int] = defaultdict(count().__next__)
_table = np.empty(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(words: list[str]) -> np.ndarray:
    """64-bit codes of words, the same in every process."""
    global _index, _table
    if len(_index) > 1_000_000:
        _index, _table = defaultdict(count().__next__), np.empty(0, np.uint64)
    at = np.fromiter(map(_index.__getitem__, words), np.int64, len(words))
    if len(_index) > len(_table):
        new = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in islice(_index, len(_table), None))
        _table = np.concatenate([_table, np.frombuffer(new, "<u8")])
    return _table[at]


def sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of the distinct sequences of three words of each text with at least LEAST_WORDS words, sorted."""
    found = [w if len(w := _WORD.findall((t or "").lower())) >= LEAST_WORDS else [] for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = list(chain.from_iterable(found))
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w = _codes(flat)
    doc = np.repeat(np.arange(len(n)), n)
    code = _mixed(_mixed(_mixed(w[:-2]) + w[1:-1]) + w[2:]).view(np.int64)
    same = doc[:-2] == doc[2:]
    doc, code = doc[:-2][same], code[same]
    # one key for text and the larger part of the code sorts faster than both; where that part is not enough, by both
    key = (doc << 44) | ((code >> 20) & ((1 << 44) - 1))
    order = np.argsort(key)
    key, doc, code = key[order], doc[order], code[order]
    if len(n) >= 1 << 19 or ((key[1:] == key[:-1]) & (code[1:] != code[:-1])).any():
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]
    return doc[first], code[first]


def _sizes(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, where each begins, members of each) of sorted rows."""
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    return doc[at], at, np.diff(np.r_[at, len(doc)])


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the fingerprint of a set of n members: two to four for each."""
    return np.maximum(128, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def fingerprints(doc: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each text, as 64-bit words."""
    _, at, n = _sizes(doc)
    w = width(n)
    base = np.r_[0, np.cumsum(w)]
    bit = np.repeat(base[:-1], n) + (_mixed(code.view(np.uint64)).view(np.int64) & (np.repeat(w, n) - 1))
    flipped = (np.bincount(bit, minlength=int(base[-1])) & 1).astype(np.uint8)
    packed = np.packbits(flipped, bitorder="little").view(np.uint64)
    return [packed[base[k] // 64 : base[k + 1] // 64] for k in range(len(n))]


def radius(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (n + m) * (OF - TIMES) // (OF + TIMES)


def _folded(fp: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint, or rows of them, at a smaller width: halves on each other, bits flipped as if it had been made so."""
    while fp.shape[-1] > words:
        half = fp.shape[-1] // 2
        fp = fp[..., :half] ^ fp[..., half:]
    return fp


class Tree:
    """A vantage-point tree over fingerprints of one width."""

    def __init__(self, prints: np.ndarray, rows: np.ndarray) -> None:
        self.prints, self.rows = prints, rows
        self.inner: Tree | None = None
        if len(rows) <= LEAF:
            return
        # the vantage point that splits best among a few
        tries = rows[:: max(1, len(rows) // 5)][:5]
        d = [np.bitwise_count(prints[rows] ^ prints[v]).sum(1).astype(np.int64) for v in tries]
        best = int(np.argmax([x.std() for x in d]))
        d, self.vantage = d[best], tries[best]
        self.mu = int(np.median(d))
        near = d <= self.mu
        if near.all() or not near.any():
            return
        # the distances at the ends of both branches bound what a query can find there
        self.near_most, self.far_least = int(d[near].max()), int(d[~near].min())
        self.near_least, self.far_most = int(d[near].min()), int(d[~near].max())
        self.inner, self.outer = Tree(prints, rows[near]), Tree(prints, rows[~near])

    def query(self, fps: np.ndarray, r: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of a leaf, those of the fingerprints ``at`` that may have rows there within their distances r), leaf by leaf."""
        if self.inner is None:
            yield self.rows, at
            return
        d, far = np.bitwise_count(self.prints[self.vantage] ^ fps[at]).sum(1).astype(np.int64), r[at]
        for branch, least, most in ((self.inner, self.near_least, self.near_most), (self.outer, self.far_least, self.far_most)):
            if (some := at[(least - far <= d) & (d <= most + far)]).size:
                yield from branch.query(fps, r, some)


def _partner(n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Members at most of a set that is similar to one of n members whose first common member leaves it ``rest`` of them."""
    return (TIMES + OF) * rest // TIMES - n


def shard_pairs(ids: np.ndarray, n: np.ndarray, prints: list[np.ndarray], a: np.ndarray, b: np.ndarray, rest: np.ndarray | None = None) -> set[tuple[int, int]]:
    """Pairs (least id first) within the radius of one shard: the texts of block b are looked up among those of block a.

    a, b: places of the texts of two blocks, the same places for a block with itself.  rest: members of
    each text from the shard's member on; without it only the sizes tell which pairs are measured.
    """
    out: set[tuple[int, int]] = set()
    words = np.array([len(p) for p in prints])
    size, most = n.astype(np.int32), _partner(n, n if rest is None else rest).astype(np.int32)
    for w in np.unique(words[a]).tolist():
        own = a[words[a] == w]
        matrix = np.stack([prints[k] for k in own])
        tree = Tree(matrix, np.arange(len(own)))
        # the widths of similar texts differ by at most one step; the wider one is folded
        for width_of in (w, 2 * w):
            asked = b[words[b] == width_of]
            if not len(asked):
                continue
            fps = _folded(np.stack([prints[k] for k in asked]), w)
            for rows, at in tree.query(fps, radius(n[asked], n[own].max()), np.arange(len(asked))):
                x, y = own[rows], asked[at]
                own_size, room = size[x], most[x]
                some = (most[y] >= own_size.min()) & (size[y] <= room.max())
                at, y = at[some], y[some]
                i, j = np.nonzero((own_size[:, None] <= most[y]) & (size[y] <= room[:, None]))
                d = np.bitwise_count(matrix[rows[i]] ^ fps[at[j]]).sum(1)
                good = (d <= radius(n[x[i]], n[y[j]])) & (ids[x[i]] != ids[y[j]])
                p, q = ids[x[i[good]]], ids[y[j[good]]]
                out.update(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist()))
    return out


def leaf_pairs(cell: np.ndarray, ids: np.ndarray, n: np.ndarray, prints: list[bytes], rest: np.ndarray | None = None) -> set[tuple[int, int]]:
    """Pairs within the radius of many shards that are no larger than a leaf, at once; rest as in :func:`shard_pairs`."""
    o = np.lexsort((n, cell))
    most = _partner(n, n if rest is None else rest)[o]
    cell, ids, n = cell[o], ids[o], n[o]
    words = np.array([len(prints[k]) // 8 for k in o.tolist()], np.int64)
    slot = np.zeros(len(o), np.int64)
    rows: dict[int, np.ndarray] = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        slot[at] = np.arange(len(at))
        rows[w] = np.frombuffer(b"".join(prints[o[k]] for k in at.tolist()), np.uint64).reshape(len(at), w)
    narrow = {w: _folded(x, w // 2) for w, x in rows.items() if w // 2 in rows}
    out: set[tuple[int, int]] = set()
    left, k = np.arange(len(o)), 1
    while len(left):
        left = left[left + k < len(o)]
        left = left[(cell[left] == cell[left + k]) & (most[left] >= n[left + k])]
        fit = left[most[left + k] >= n[left]]
        for w in rows:
            for other, table in ((w, rows[w]), (2 * w, narrow.get(2 * w))):
                x = fit[(words[fit] == w) & (words[fit + k] == other)]
                if len(x):
                    d = np.bitwise_count(rows[w][slot[x]] ^ table[slot[x + k]]).sum(1)
                    x = x[d <= radius(n[x], n[x + k])]
                    out.update((min(i, j), max(i, j)) for i, j in zip(ids[x].tolist(), ids[x + k].tolist()) if i != j)
        k += 1
    return out


def _least(n: np.ndarray, times: int, of: int) -> np.ndarray:
    """times / of of n, rounded up."""
    return -(-n * times // of)


def _most(v: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest of v[begin:end] for each stretch, -1 for an empty one."""
    out = np.full(len(begin), -1, np.int64)
    length = end - begin
    level = np.where(length > 0, np.frexp(length.astype(np.float64))[1] - 1, -1)
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(v[begin[at]], v[end[at] - (1 << k)])
        v = np.maximum(v[: -(1 << k)], v[1 << k :])
    return out


def partnered(code: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which texts of each shard have a partner there by both sizes and both places; rows sorted by code and n, a text once in a shard."""
    out = np.zeros(len(code), bool)
    new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.empty(0, bool)
    at = np.flatnonzero(~(new & np.r_[new[1:], True])) if len(code) else np.empty(0, np.int64)
    shard, n, rest = np.cumsum(new)[at] << 32, n[at], rest[at]
    key, most, own = shard + n, _partner(n, rest), np.arange(len(at))
    # the larger ones that it leaves room for, of which one must leave room for it; then the smaller ones
    larger = _most(most, own + 1, np.searchsorted(key, shard + np.maximum(most, 0), "right"))
    least = np.searchsorted(key, shard + _least(n, TIMES, OF), "left")
    smaller = _most(most, least, np.minimum(own, np.searchsorted(key, shard + np.maximum(most, 0), "right")))
    out[at] = (larger >= n) | (smaller >= n)
    return out


def _counted(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, counts): the buckets that occur, as steps, and how often."""
    bucket = np.sort(np.concatenate(codes))
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    bucket, times = bucket[at].astype(np.int64), np.diff(np.r_[at, len(bucket)])
    ends = np.searchsorted(bucket, np.arange(PIECES + 1) * (BUCKETS // PIECES))
    parts = [_packed(np.diff(bucket[s:e], prepend=k * (BUCKETS // PIECES)), times[s:e]) for k, (s, e) in enumerate(zip(ends[:-1], ends[1:]))]
    yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, pa.int64()), pa.array(parts, pa.binary()), pa.array(range(PIECES), pa.int32())], names=["id", "key", "piece"])


def _scan_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, key) for the texts, and rows (piece, counts) for the sketch."""
    held: list[np.ndarray] = []
    kind = pa.int64()
    for b in batches:
        doc, code = sets(b.column(1).to_pylist())
        held.append((code & (BUCKETS - 1)).astype(np.int32))
        docs, at, n = _sizes(doc)
        ids = b.column(0).to_numpy(zero_copy_only=False)[docs] if len(docs) else np.empty(0, np.int64)
        keys = [hashlib.blake2b(code[s : s + k].tobytes(), digest_size=16).digest() for s, k in zip(at.tolist(), n.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(keys, pa.binary()), pa.nulls(len(ids), pa.int32())], names=["id", "key", "piece"])
        if sum(map(len, held)) > 4_000_000:
            yield from _counted(held)
            held = []
    if sum(map(len, held)):
        yield from _counted(held)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, ranks) of the whole collection."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            steps, times = _unpacked(x, 2)
            v = sums.setdefault(k, np.zeros(BUCKETS // PIECES, np.int64))
            v[np.cumsum(steps)] += times
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(_rank(v).tobytes(), 1) for v in sums.values()], pa.binary())], names=["piece", "key"])


def _rank(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(STEPS * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, so that what varies little lies together."""
    return zstandard.ZstdCompressor(level=1).compress(np.stack([c.astype(np.int64) for c in columns]).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes())


def _unpacked(x: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.int64).reshape(columns, -1)


def near_pairs(docs: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """Distinct (file_id_a, file_id_b), a < b, of the rows (id, text); repeated rows are allowed."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.col(id_col).isNotNull() & (F.length(text_col) >= 2 * LEAST_WORDS - 1))
    first = cut(src.mapInArrow(_scan_sets, "id bigint, key binary, piece int"))
    sketch = first.filter("piece is not null").select("piece", "key").repartition("piece").mapInArrow(_summed, "piece int, key binary").collect()
    order = {r["piece"]: np.frombuffer(zlib.decompress(r["key"]), np.uint8) for r in sketch}
    ranks = spark.sparkContext.broadcast(np.concatenate([order.get(k, np.zeros(BUCKETS // PIECES, np.uint8)) for k in range(PIECES)]))

    members = first.filter("piece is null").groupBy("key", "id").agg(F.lit(1)).select("key", "id")
    least = members.groupBy("key").agg(F.min("id").alias("class"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only classes of several texts: (id, class)
    copies = cut(members.join(least, "key").select("id", "class"))
    others = copies.filter("id != class").select("id")
    some = [r["id"] for r in others.limit(SENT + 1).collect()]
    if len(some) <= SENT:
        skip = spark.sparkContext.broadcast(np.array(sorted(some), np.int64))
        chosen = src
    else:
        skip = spark.sparkContext.broadcast(np.empty(0, np.int64))
        chosen = src.join(others, "id", "left_anti")
    mean = float(np.bincount(ranks.value, minlength=256) @ (2 ** (np.arange(256) / STEPS))) / BUCKETS
    most = STEPS * np.log2(max(HOT, 4 * mean))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, rows, id, n, print): the first members of the texts, packed by part, and the fingerprints, to part 0 of their ids."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, ids, n, place = (np.concatenate([h[k] for h in held]) for k in range(4))
            hot = ranks.value[code & (BUCKETS - 1)] > most
            part = (_mixed(code.view(np.uint64) + np.where(hot, _mixed(ids.astype(np.uint64)), np.uint64(0))) % np.uint64(parts)).astype(np.int64)
            place = place + np.where(hot, _SPLIT, 0)
            o = np.argsort(part, kind="stable")
            part, code, ids, n, place = part[o], code[o], ids[o], n[o], place[o]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            packs = [_packed(code[s:e], ids[s:e], (n[s:e] << 32) + place[s:e]) for s, e in zip(at, np.r_[at[1:], len(part)])]
            yield _rows(part[at], packs, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), [None] * len(at))

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            doc, code = sets(b.column(1).to_pylist())
            if len(skip.value) and len(doc):
                at = np.minimum(np.searchsorted(skip.value, ids[doc]), len(skip.value) - 1)
                keep = skip.value[at] != ids[doc]
                doc, code = doc[keep], code[keep]
            if not len(doc):
                continue
            each, at, n = _sizes(doc)
            yield _rows((_mixed(ids[each].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), [None] * len(each), pa.array(ids[each]), pa.array(n), [x.tobytes() for x in fingerprints(doc, code)])
            rare = np.argsort((doc << 8) | ranks.value[code & (BUCKETS - 1)], kind="stable")
            code = code[rare]
            place = np.arange(len(doc)) - np.repeat(at, n)
            size_of = np.repeat(n, n)
            keep = place < size_of - _least(size_of, TIMES, OF) + 1
            held.append((code[keep], ids[doc[keep]], size_of[keep], place[keep]))
            size += int(keep.sum())
            if size > 3_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, cell, n, print): a text's shards (cell) with its members from the shard's on (n) and, passed through, its fingerprint."""
        rows = [np.empty((3, 0), np.int64)]
        for b in batches:
            keep = b.column(2).is_valid()
            own = b.filter(keep)
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(2), pa.nulls(own.num_rows, pa.int64()), own.column(3), own.column(4)], names=["id", "cell", "n", "print"])
            rows += [_unpacked(x, 3) for x in b.column(1).to_pylist() if x is not None]
        code, ids, packed = np.concatenate(rows, 1)
        n, place = packed >> 32, packed & 0xFFFFFFFF
        hot = place >= _SPLIT
        place = place - np.where(hot, _SPLIT, 0)
        o = np.lexsort((place, ids, n, code))
        code, ids, n, place, hot = code[o], ids[o], n[o], place[o], hot[o]
        once = np.r_[True, (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])] if len(code) else np.empty(0, bool)
        code, ids, rest, n, hot = code[once], ids[once], (n - place)[once], n[once], hot[once]
        if hot.any():
            yield _placed(ids[hot], code[hot], rest[hot])
            code, ids, rest, n = code[~hot], ids[~hot], rest[~hot], n[~hot]
        kept = partnered(code, n, rest)
        if kept.any():
            yield _placed(ids[kept], code[kept], rest[kept])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b): the pairs within the radius of each shard, or of two blocks of one."""
        small: list[tuple[np.ndarray, ...]] = []
        held = 0

        def leaves() -> pa.RecordBatch:
            cell, ids, n, rest = (np.concatenate([r[k] for r in small]) for k in range(4))
            return _pairs(leaf_pairs(cell, ids, n, [p for r in small for p in r[4]], rest))

        for key, (ids, n, rest, block, prints) in _grouped(batches):
            ids, first = np.unique(ids, return_index=True)
            n, rest, block, prints = n[first], rest[first], block[first], [prints[k] for k in first.tolist()]
            if len(ids) < 2:
                continue
            if len(ids) <= LEAF and key[1] == key[2]:
                small.append((np.full(len(ids), held), ids, n, rest, prints))
                held += len(ids)
                if held > 40_000:
                    yield leaves()
                    small, held = [], 0
                continue
            rows = [np.frombuffer(x, np.uint64) for x in prints]
            if key[1] == key[2]:
                yield _pairs(shard_pairs(ids, n, rows, np.arange(len(ids)), np.arange(len(ids)), rest))
            else:
                a, b = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
                yield _pairs(shard_pairs(ids, n, rows, a, b, rest) | shard_pairs(ids, n, rows, b, a, rest))
        if small:
            yield leaves()

    wide = "part int, packed binary, id bigint, n bigint, print binary"
    spread = chosen.mapInArrow(prefixes, wide).repartition(parts, "part")
    told = cut(spread.mapInArrow(candidates, "id bigint, cell bigint, n bigint, print binary"))
    prints = told.filter("print is not null").select("id", "n", "print").dropDuplicates(["id"])
    shards = told.filter("print is null").select("id", "cell", F.col("n").alias("rest"))  # each once, as all rows of a text and member come to one task
    # a large shard is cut into blocks; each text goes to the task of each pair of blocks that has its own
    large = shards.groupBy("cell").count().filter(F.col("count") > SHARD).select("cell", F.ceil(F.col("count") / SHARD).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = shards.join(large, "cell", "left").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    tasks = placed.select("id", "cell", "rest", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block")
    rows = tasks.join(prints, "id").select("cell", "x", "y", "block", "id", "n", "rest", "print").repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y")
    near = cut(rows.mapInArrow(search, "a bigint, b bigint").distinct())
    return _all_pairs(_compared(near, src), copies)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], tuple]]:
    """((cell, x, y), (ids, n, rest, block, prints)) of rows sorted by their key, whole groups across batches."""
    held: list[tuple] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        cell, x, y, block, ids, n, rest = (b.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        prints = b.column(7).to_pylist()
        cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)]):
            key = (int(cell[s]), int(x[s]), int(y[s]))
            if key != now:
                if held:
                    yield now, (*(np.concatenate([h[k] for h in held]) for k in range(4)), [p for h in held for p in h[4]])
                held, now = [], key
            held.append((ids[s:e], n[s:e], rest[s:e], block[s:e], prints[s:e]))
    if held:
        yield now, (*(np.concatenate([h[k] for h in held]) for k in range(4)), [p for h in held for p in h[4]])


def _placed(ids: np.ndarray, cell: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell), pa.array(rest), pa.nulls(len(ids), pa.binary())], names=["id", "cell", "n", "print"])


def _rows(part: np.ndarray, packed: list, ids: pa.Array, n: pa.Array, prints: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(packed, pa.binary()), ids, n, pa.array(prints, pa.binary())], names=["part", "packed", "id", "n", "print"])


def _pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _compared(near: DataFrame, src: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked, by the sets themselves."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, code = sets(b.column(1).to_pylist())
            each, at, n = _sizes(doc)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each)), pa.array([code[s : s + k].tobytes() for s, k in zip(at.tolist(), n.tolist())], pa.binary())], names=["id", "members"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = set()
            for a, c, x, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and OF * both >= TIMES * (len(x) + len(y) - both):
                    good.add((a, c))
            yield _pairs(good)

    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    ids = F.broadcast(ids) if ids.count() <= SENT else ids
    full = cut(src.join(ids, "id", "left_semi").mapInArrow(of, "id bigint, members binary").dropDuplicates(["id"]))
    both = near.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(test, "a bigint, b bigint").distinct()


def _all_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of their texts, and the pairs inside the classes."""
    names = ("file_id_a", "file_id_b")
    one = copies.toDF("a_id", "a")
    two = copies.toDF("b_id", "b")
    across = pairs.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("a_id", "a").alias("x"), F.coalesce("b_id", "b").alias("y"))
    inside = copies.toDF("x", "class").join(copies.toDF("y", "class"), "class").filter("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias(names[0]), F.greatest("x", "y").alias(names[1])).distinct()
