"""Held-out items that stand, whole or in part, in documents: q-gram counts in diagonal bands, then banded alignment.

Texts are compared as their words (runs of letters and digits, lower case) joined by one blank, so
layout and punctuation play no part.  A stretch of RUN words of an item has at least L characters;
if it stands in a document with at most ``edits`` edits, then by the q-gram lemma document and
item share at least L - q + 1 - q * edits q-grams whose diagonals (place in the document minus place
in the item) differ by at most ``edits``.  All q-grams of a document are looked up; bands of
diagonals overlap by ``edits``, so the hits of a stretch lie in one band.  A band with enough hits
close enough together is aligned word by word (without edits) or character by character.

Defined cases: null, empty and short texts hold nothing; repeated rows come out once; an item with
fewer than RUN words can't be found; extra columns are ignored; without items there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
_WORD = re.compile(r"[^\W_]+")
_BITS = 22


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall((text or "").lower())


def _starts(w: list[str]) -> np.ndarray:
    """Place of each word in the joined text, and one past the end."""
    return np.cumsum([0, *(len(x) + 1 for x in w)])


def grams(joined: str, q: int) -> np.ndarray:
    """64-bit codes of all runs of q characters."""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < q:
        return np.empty(0, np.uint64)
    out = np.zeros(len(c) - q + 1, np.uint64)
    for k in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def within(pattern: str, text: str, edits: int, near: int) -> bool:
    """Whether a substring of text is at most so many edits from the pattern; banded around the diagonal ``near`` (place in text minus place in pattern).

    A match may begin at any diagonal from near - edits to near + edits and shifts by at most edits more.
    """
    wide = 2 * edits
    before = {j: 0 for j in range(near - wide, near + wide + 1) if 0 <= j <= len(text)}
    for i, p in enumerate(pattern, 1):
        now = {}
        for j in range(max(0, i + near - wide), min(len(text), i + near + wide) + 1):
            best = before.get(j, edits + 1) + 1
            if j:
                best = min(best, before.get(j - 1, edits + 1) + (text[j - 1] != p), now.get(j - 1, edits + 1) + 1)
            if best <= edits:
                now[j] = best
        if not now:
            return False
        before = now
    return True


class Items:
    """The q-gram index of the items' texts."""

    def __init__(self, items: Iterable[tuple[int, str | None]], edits: int = 0) -> None:
        self.edits = edits
        kept = [(i, w) for i, t in items if len(w := words(t)) >= RUN]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.starts = [_starts(w) for w in self.words]
        windows = [s[RUN:] - s[:-RUN] - 1 for s in self.starts]
        self.least = [int(x.min()) for x in windows]
        self.most = [int(x.max()) for x in windows]
        # the largest q up to 12 that leaves each stretch a shared q-gram more than none
        self.q = max(1, min(12, (min(self.least, default=12) + 1) // (edits + 2)))
        self.need = np.array([max(1, n - self.q + 1 - self.q * edits) for n in self.least], np.int64)
        self.wide = max(1, 4 * edits)
        code, item, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n, w in enumerate(self.words):
            g = grams(" ".join(w), self.q)
            code.append(g), item.append(np.full(len(g), n)), place.append(np.arange(len(g)))
        code, item, place = (np.concatenate(x) for x in (code, item, place))
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.code, self.first, self.n = np.unique(code[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.code >> np.uint64(64 - _BITS)] = True

    def bands(self, joined: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places in the document, places in the item) of the hits of each band that meets the bound."""
        g = grams(joined, self.q)
        at = np.flatnonzero(self.seen[g >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.code):
            return
        k = np.minimum(np.searchsorted(self.code, g[at]), len(self.code) - 1)
        good = self.code[k] == g[at]
        at, k = at[good], k[good]
        if not len(at):
            return
        n = self.n[k]
        doc = np.repeat(at, n)
        row = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        item, place = self.item[row], self.place[row]
        diagonal = doc - place + (1 << 31)
        band = diagonal // self.wide
        if self.edits:
            # a hit in the last ``edits`` diagonals of a band also belongs to the next
            twin = diagonal % self.wide >= self.wide - self.edits
            doc, item, place, band = (np.concatenate([x, x[twin] + y]) for x, y in ((doc, 0), (item, 0), (place, 0), (band, 1)))
        order = np.lexsort((doc, band, item))
        doc, item, place, band = doc[order], item[order], place[order], band[order]
        cut = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        for s, e in zip(cut, np.r_[cut[1:], len(doc)]):
            i = int(item[s])
            need = int(self.need[i])
            if e - s >= need:
                d = doc[s:e]
                if (d[need - 1 :] - d[: e - s - need + 1] <= self.most[i] - self.q + self.edits).any():
                    yield i, d, place[s:e]

    def held_in(self, text: str | None) -> set[int]:
        """Items of which a stretch of RUN words stands in the text."""
        w = words(text)
        if len(w) < RUN and not (self.edits and w):
            return set()
        joined, out = " ".join(w), set()
        starts = _starts(w)
        for i, doc, place in self.bands(joined):
            if i not in out and (self._edited(i, joined, doc, place) if self.edits else self._aligned(i, w, starts, doc, place)):
                out.add(i)
        return {self.ids[i] for i in out}

    def _aligned(self, i: int, w: list[str], starts: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bool:
        """Whether RUN words in a row are equal on a diagonal of words that the hits lie on."""
        own = self.words[i]
        a = np.searchsorted(starts, doc, "right") - 1
        b = np.searchsorted(self.starts[i], place, "right") - 1
        for shift in set((a - b).tolist()):
            lo = max(0, int(b[a - b == shift].min()) - RUN, -shift)
            run = 0
            for k in range(lo, min(len(own), len(w) - shift)):
                run = run + 1 if own[k] == w[k + shift] else 0
                if run >= RUN:
                    return True
        return False

    def _edited(self, i: int, joined: str, doc: np.ndarray, place: np.ndarray) -> bool:
        s, item = self.starts[i], " ".join(self.words[i])
        lo, hi = int((doc - place).min()), int((doc - place).max())
        for k in range(len(self.words[i]) - RUN + 1):
            a, e = int(s[k]), int(s[k + RUN]) - 1
            if ((place >= a) & (place <= e - self.q)).any():
                begin = max(0, a + lo - self.edits)
                part = joined[begin : e + hi + self.edits]
                if any(within(item[a:e], part, self.edits, near) for near in range(a + lo - begin, a + hi - begin + 1)):
                    return True
        return False


def leaks(docs: DataFrame, items: DataFrame, edits: int = 0, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id).  items: the held-out table, which does not grow with the documents; its index goes to each task."""
    rows = [(r[0], r[1]) for r in items.select(item_col, text_col).filter(F.col(item_col).isNotNull()).collect()]
    index = docs.sparkSession.sparkContext.broadcast(rows)
    kind, item_kind = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Items(index.value, edits)
        for b in batches:
            found = [(d, i) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in sorted(held.held_in(t))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], b.schema.field(0).type), pa.array([i for _, i in found])] if found else [pa.array([], b.schema.field(0).type), pa.array([], pa.int64())], names=["doc", "item"])

    out = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).filter(F.length("text") > 0).mapInArrow(scan, f"doc {kind}, item {item_kind}")
    return out.distinct().toDF(doc_col, item_col)
