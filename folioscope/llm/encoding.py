"""Texts, or stretches of them, whose bytes were read in the wrong encoding: find and restore them.

1. All adjacent characters of all documents are counted.  The mutual information of a pair, shrunk
   by a share of the corpus that every character is presumed to have been seen besides, is low where
   a character has little evidence: log2 (n(ab) N / ((n(a) + K) (n(b) + K))), K = N * PRIOR.
2. In each document the maximum-scoring segments of (FLOOR - information) are the improbable runs.
3. Only inside these runs the inverse mappings are tried: bytes of UTF-8 read in another encoding
   (also twice), and one-byte encodings read as another one.  A mapping of the second kind must raise
   the information of the run and its neighbours by at least GAIN bits, must not make a lower-case
   letter of a word's first capital, and must not turn a letter that the corpus uses often (COMMON)
   into another letter: those can't be told from rightly read ones.

A replacement character is damage that can't be undone.  A damaged run that touches no letter or
digit is only cited (``the two characters Ã¼ were``) and stays, unless words of the same text are damaged.

The table of pairs keeps those with at least 2**-20 of all pairs, so it has at most 2**20 rows at
any size; rarer ones count as unseen.

Defined cases: null, empty and pure ASCII texts are undamaged; repeated rows come out once; extra
columns are kept by :func:`repaired` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.graph import cut

#: Share of the corpus presumed for every character; bits below which a pair is improbable; bits that a one-byte mapping must gain.
PRIOR, FLOOR, GAIN, COMMON = 0.01, 0.0, 7.0, 1e-4
#: Pairs on each side of an improbable one in which a segment is looked for.
REACH = 32
#: Encodings in which bytes of UTF-8 may have been read.
CODECS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859_2", "iso8859_15", "koi8_r", "gb18030", "shift_jis", "big5")
#: (written in, read in) of one-byte encodings.
ONE_BYTE = tuple((a, b) for a in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r") for b in ("mac_roman", "cp1252", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "iso8859_5") if a != b)
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Characters of ordinary texts in alphabets and of their punctuation, besides symbols and emoji.
_USUAL = re.compile("[\x00-\x7f\xa0-ſͰ-ϿЀ-џ -⁤₠-₿℀-⅏←-⇿∀-⋿☀-➿️‍\U0001f300-\U0001faff]+")
_LOST = "�"
#: Characters from here on share the code of their class.
_CLASS = 0x2E80


def codes(text: str) -> np.ndarray:
    """Code points; those of large scripts stand for their script."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(c >= _CLASS, _CLASS + (c >> 12), c)


def pairs(text: str) -> np.ndarray:
    c = codes(text)
    return (c[:-1] << 20) | c[1:]


def pair_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n): how often two characters stand side by side, over all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(pairs(t))
                size += len(held[-1])
                if size > 4_000_000:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return docs.select(text_col).filter(F.length(text_col) > 1).mapInArrow(scan, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


class Information:
    """The shrunk mutual information of adjacent characters."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, total: int) -> None:
        order = np.argsort(pair)
        pair, n = pair[order], n[order].astype(float)
        self.total = max(total, 1)
        self.k = self.total * PRIOR
        self.first, where = np.unique(pair >> 20, return_inverse=True)
        self.first_n = np.bincount(where, n, len(self.first)) if len(pair) else np.empty(0)
        self.second, where = np.unique(pair & 0xFFFFF, return_inverse=True)
        self.second_n = np.bincount(where, n, len(self.second)) if len(pair) else np.empty(0)
        self.pair, self.n = pair, n
        self.common = {chr(c) for c in self.first[self.first_n >= COMMON * self.total].tolist() if c < _CLASS}
        self.known_bits = self._bits(pair, n)
        self._known: dict[str, float] = {}
        self.tried: dict[str, str | None] = {}

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(x), least)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, values[at], least)

    def _bits(self, p: np.ndarray, joint: np.ndarray | float) -> np.ndarray:
        a = self._look(self.first, self.first_n, p >> 20, 0.5)
        b = self._look(self.second, self.second_n, p & 0xFFFFF, 0.5)
        return np.log2(joint * self.total / ((a + self.k) * (b + self.k)))

    def of(self, text: str) -> np.ndarray:
        """Bits of each adjacent pair of the text."""
        p = pairs(text)
        if not len(self.pair):
            return self._bits(p, 0.5)
        at = np.minimum(np.searchsorted(self.pair, p), len(self.pair) - 1)
        out, new = self.known_bits[at], self.pair[at] != p
        if new.any():
            out[new] = self._bits(p[new], 0.5)
        return out

    def bits(self, text: str) -> float:
        """Sum over a short text."""
        total = 0.0
        for k in range(len(text) - 1):
            p = text[k : k + 2]
            x = self._known.get(p)
            if x is None:
                if len(self._known) > 200_000:
                    self._known.clear()
                x = self._known[p] = float(self.of(p)[0])
            total += x
        return total


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal-scoring segments [start, end) of a sequence of scores, from left to right."""
    if not len(score):
        return []
    # neighbours of one sign belong together in every maximal segment
    change = np.flatnonzero(np.r_[True, (score[1:] > 0) != (score[:-1] > 0)])
    sums = np.add.reduceat(score, change)
    ends = np.r_[change[1:], len(score)]
    found: list[list[float]] = []  # start, end, sum before, sum up to
    total = 0.0
    for x, s, e in zip(sums.tolist(), change.tolist(), ends.tolist()):
        if x <= 0:
            total += x
            continue
        new = [s, e, total, total + x]
        total += x
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(s), int(e)) for s, e, _, _ in found]


def _bytes(run: str, codec: str) -> bytes | None:
    out = bytearray()
    for c in run:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if codec[:3] != "cp1" or not "\x80" <= c <= "\x9f":  # bytes that these encodings leave open
                return None
            out.append(ord(c))
    return bytes(out)


@lru_cache(maxsize=200_000)
def from_utf8(run: str) -> str | None:
    """What the run was if it is UTF-8 read in one of CODECS, once or twice; else None."""
    for codec in CODECS:
        b = _bytes(run, codec)
        if b:
            try:
                text = b.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if text != run and _USUAL.fullmatch(text):
                return from_utf8(text) or text
    return None


def _table(written: str, read: str) -> dict[int, str]:
    out = {}
    for k in range(128, 256):
        try:
            a, b = bytes([k]).decode(written), bytes([k]).decode(read)
        except UnicodeDecodeError:
            continue
        if a != b and _USUAL.fullmatch(a):
            out[ord(b)] = a
    return out


_TABLES = [_table(w, r) for w, r in ONE_BYTE]
_SOURCES = frozenset(chr(c) for t in _TABLES for c in t) - {"\xa0"}


def one_byte(before: str, run: str, after: str, info: Information) -> str | None:
    """What a run was if it was written in one one-byte encoding and read in another; None if it isn't damaged."""
    if not _SOURCES.issuperset(run):
        return None
    key = before + run + after if before and after else ""
    if key and len(run) == 1 and key in info.tried:
        return info.tried[key]
    now, best, gain = info.bits(before + run + after), None, GAIN
    for new in {run.translate(t) for t in _TABLES if all(ord(c) in t for c in run)}:
        for k, (c, d) in enumerate(zip(run, new)):
            left, right = (run[k - 1] if k else before), (run[k + 1] if k + 1 < len(run) else after)
            if c != d and d.isalpha() and ((c.isalpha() and c.islower() and c in info.common) or (c.isupper() and d.islower() and not left.isalpha() and right.islower())):
                break
        else:
            if (x := info.bits(before + new + after) - now) >= gain:
                best, gain = new, x
    if key and len(run) == 1:
        if len(info.tried) > 200_000:
            info.tried.clear()
        info.tried[key] = best
    return best


def _improbable(text: str, score: np.ndarray) -> Iterator[tuple[int, int]]:
    """The maximum-scoring segments of the windows of REACH pairs around each character above ASCII that stands in an improbable pair.

    Every improbable pair lies in a segment; a character whose pairs are all probable is no damage, so the rest of the text is left out.
    """
    high = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0x7F)
    up = score > 0
    hit = high[up[np.maximum(high - 1, 0)] | up[np.minimum(high, len(score) - 1)]] if len(score) else high[:0]
    at = 0
    while at < len(hit):
        last = at
        while last + 1 < len(hit) and hit[last + 1] - hit[last] <= 2 * REACH:
            last += 1
        lo, hi = max(0, int(hit[at]) - REACH), min(len(score), int(hit[last]) + REACH)
        for s, e in segments(score[lo:hi]):
            yield s + lo, e + lo
        at = last + 1


def damaged(text: str | None, info: Information) -> list[tuple[int, int, str | None]]:
    """(start, end, original) of the damaged runs of a text; the original is None where it can't be restored."""
    if not text or text.isascii():
        return []
    score = FLOOR - info.of(text)
    out: list[tuple[int, int, str | None]] = []
    alone: list[tuple[int, int, str | None]] = []
    seen: set[int] = set()
    for s, e in _improbable(text, score):
        for m in _RUN.finditer(text, s, e + 1):
            # the whole run, if the segment begins or ends inside it
            a, b = m.span()
            while a > 0 and text[a - 1] > "\x7f":
                a -= 1
            while b < len(text) and text[b] > "\x7f":
                b += 1
            if a in seen:
                continue
            seen.add(a)
            run = text[a:b]
            was = from_utf8(run)
            if not ((a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())):
                if was is not None:
                    alone.append((a, b, was))
            elif was is not None:
                out.append((a, b, was))
            elif _LOST in run:
                out.append((a, b, None))
            elif (new := one_byte(text[a - 1 : a] if a else "", run, text[b : b + 1], info)) is not None:
                out.append((a, b, new))
    # runs that stand alone are damage only where other words of the text are damaged
    return sorted(out + alone) if out else []


def information(docs: DataFrame, text_col: str = "text") -> Information:
    """Counted over all documents; only pairs of at least 2**-20 of the total come to the driver."""
    counts = cut(pair_counts(docs, text_col))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.filter(F.col("n") >= total / (1 << 20)).toPandas()
    return Information(kept["pair"].to_numpy(np.int64), kept["n"].to_numpy(np.int64), total)


def damaged_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct ids of the documents that are damaged, recoverable or not."""
    info = docs.sparkSession.sparkContext.broadcast(information(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if damaged(t, info.value)], b.schema.field(0).type)], names=["id"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    return src.mapInArrow(scan, f"id {kind}").distinct().withColumnRenamed("id", id_col)


def repaired(docs: DataFrame, text_col: str = "text", out_col: str = "repaired_text", state_col: str = "damage") -> DataFrame:
    """All rows and columns of docs plus the text with its damaged runs restored and what was done: none, restored or lost (in part)."""
    info = docs.sparkSession.sparkContext.broadcast(information(docs, text_col))

    def one(t: str | None) -> tuple[str | None, str]:
        runs = damaged(t, info.value)
        out, at = [], 0
        for s, e, was in runs:
            out += [t[at:s], t[s:e] if was is None else was]
            at = e
        return ("".join([*out, t[at:]]) if runs else t), "lost" if any(r[2] is None for r in runs) else "restored" if runs else "none"

    @F.pandas_udf("struct<t string, s string>")
    def both(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([one(t) for t in texts], columns=["t", "s"])

    both.func.__annotations__.clear()
    return docs.withColumn("_repair", both(F.col(text_col))).withColumns({out_col: F.col("_repair.t"), state_col: F.col("_repair.s")}).drop("_repair")
