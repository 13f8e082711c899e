"""A training mix in which each source has its target share of all tokens.

Documents with the same text are one document that may belong to several sources; the set of sources
it belongs to is its *membership pattern*.  Documents are aggregated by pattern: number of
documents and of tokens.  A min-cost flow on the driver routes token capacity from patterns to sources:

* an arc from a pattern to each of its sources, as often as all of them allow a document to be used in
  all; the first use costs nothing, each further use of the same tokens costs more than the one
  before (convex), so repetition is spread evenly and only used where it must be;
* a source takes at most its quota, target share times the size of the mix.

The size of the mix is the largest at which every source that has documents reaches its quota if
``size`` is None and ``fill`` is "all"; else the tokens of all documents.  Where a source has no or too
few documents even at its highest repetition, the shortfall stays open and is reported; nothing else is
put in its place.

The flow says how many tokens of each pattern go to each source at each use.  Documents are then
drawn in an order that a seed determines: a document is taken at a use if the tokens of its pattern
before it, in this order, are below the flow.  So no document is used more often than ``max_repeats``
of any of its sources, and shares differ from the flow by less than one document per pattern, source and use.

The running sums are made per bucket of hash values first and inside each bucket then, so that a
source with any part of all rows is summed by many tasks.

Tokens are those of a tokenizer file of the session's choice (``encoder``); its path is a parameter.

Defined cases: a null text or source has no part in the mix; an empty text has no tokens and is not
used; a source without a target gets nothing; a target without documents stays open; rows repeated
under one id count once; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.graph import cut

#: Folder of public tokenizer files; the environment may name another.
TOKENIZERS = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
#: How texts are cut before byte pairs are merged, as usual for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the hash values that make a bucket of the seeded order.
BUCKET_BITS = 16


def encoder(path: str):  # noqa: ANN201
    """A function text -> number of tokens for a rank file of byte pairs (.tiktoken) or a tokenizer description (.json)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def with_tokens(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, source, key, tokens): key stands for the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(count(b.column(3).to_pylist()), pa.int64())], names=["id", "source", "key", "tokens"])

    src = docs.filter(F.col(text_col).isNotNull() & F.col("source").isNotNull() & F.col(id_col).isNotNull())
    src = src.select(F.col(id_col).cast("bigint").alias("id"), "source", F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    return src.mapInArrow(scan, "id bigint, source string, key string, tokens bigint")


class Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, n: int) -> None:
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        k = len(self.to)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return k

    def run(self, s: int, t: int) -> int:
        """Sends all that can be sent at least cost; the amount sent."""
        n, sent = len(self.arcs), 0
        potential = [0] * n
        while True:
            dist: list[float] = [float("inf")] * n
            via = [-1] * n
            dist[s] = 0
            heap: list[tuple[float, int]] = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.arcs[u]:
                    if self.room[k] > 0 and (x := d + self.cost[k] + potential[u] - potential[self.to[k]]) < dist[self.to[k]]:
                        dist[self.to[k]], via[self.to[k]] = x, k
                        heapq.heappush(heap, (x, self.to[k]))
            if via[t] < 0:
                return sent
            for u in range(n):
                if dist[u] < float("inf"):
                    potential[u] += int(dist[u])
            push, v = None, t
            while v != s:
                k = via[v]
                push = self.room[k] if push is None else min(push, self.room[k])
                v = self.to[k ^ 1]
            v = t
            while v != s:
                k = via[v]
                self.room[k] -= push
                self.room[k ^ 1] += push
                v = self.to[k ^ 1]
            sent += push


def route(patterns: dict[str, int], targets: dict[str, tuple[float, int]], size: int) -> dict[tuple[str, str, int], int]:
    """(pattern, source, use) -> tokens.  patterns: tokens by pattern (a JSON list of sources); targets: share and most uses by source.

    The uses of a pattern's tokens are counted over all its sources: the k-th use of a document may be
    for any of them, but none beyond what each of them allows.
    """
    sources = sorted(targets)
    names = sorted(p for p in patterns if patterns[p] > 0)
    depth = {p: min([targets[s][1] for s in json.loads(p) if s in targets], default=0) for p in names}
    uses = [(p, k) for p in names for k in range(1, depth[p] + 1)]
    first, last = 0, 1 + len(uses) + len(sources)
    flow = Flow(last + 1)
    at = {x: 1 + k for k, x in enumerate(uses)}
    own = {s: 1 + len(uses) + k for k, s in enumerate(sources)}
    arcs = {}
    for p, k in uses:
        # convex: the k-th use of a pattern's tokens costs more than the one before
        flow.arc(first, at[p, k], patterns[p], (k - 1) * (k - 1))
        for s in json.loads(p):
            if s in targets:
                arcs[p, s, k] = flow.arc(at[p, k], own[s], patterns[p], 0)
    for s in sources:
        flow.arc(own[s], last, int(targets[s][0] * size), 0)
    flow.run(first, last)
    return {x: flow.room[k ^ 1] for x, k in arcs.items() if flow.room[k ^ 1] > 0}


def largest_size(patterns: dict[str, int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest mix in which every source with documents reaches its quota: each set of sources must find enough capacity."""
    alive = {s for p, n in patterns.items() if n > 0 for s in json.loads(p) if s in targets and targets[s][1] > 0 and targets[s][0] > 0}
    if not alive:
        return 0
    kept = {s: targets[s] for s in alive}
    lo, hi = 0, sum(n for n in patterns.values()) * max(t[1] for t in kept.values())
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if sum(route(patterns, kept, mid).values()) >= sum(int(t[0] * mid) for t in kept.values()):
            lo = mid
        else:
            hi = mid - 1
    return lo


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, size: int | None = None, fill: str = "shares", seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, times, tokens): how often each document is used for each source; documents that are not used are left out.

    size: tokens of the mix; None: those of all documents (fill "shares"), or the largest mix in which
    every source that has documents reaches its share (fill "all").
    """
    path = tokenizer or os.path.join(TOKENIZERS, "byte_bpe_multi_50k.tiktoken")
    rows = cut(with_tokens(docs, id_col, text_col, path).filter("tokens > 0"))
    # a text's least id stands for it; its sources are those of all rows with this text
    one = cut(rows.groupBy("key").agg(F.min("id").alias("id"), F.max("tokens").alias("tokens"), F.to_json(F.sort_array(F.collect_set("source"))).alias("pattern")))
    patterns = {r["pattern"]: int(r["tokens"]) for r in one.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}  # bounded by the sets of sources that occur
    wanted = {r["source"]: (float(r["target_share"] or 0.0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").filter("source is not null").collect()}
    if size is None:
        size = largest_size(patterns, wanted) if fill == "all" else sum(patterns.values())
    routed = route(patterns, wanted, size)
    # each use of a pattern is one line of tokens; the sources take consecutive stretches of it
    plan, line = [], {}
    for (p, s, k), n in sorted(routed.items()):
        start = line.get((p, k), 0)
        plan.append((p, s, k, start, start + n))
        line[p, k] = start + n
    spark = docs.sparkSession
    plan_df = spark.createDataFrame(plan, "pattern string, source string, use int, lo bigint, hi bigint")
    # the seeded order: by hash; running sums of tokens before each document, by buckets and inside them
    order = F.xxhash64(F.lit(seed), "key")
    drawn = one.withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 64 - BUCKET_BITS).cast("int"))
    sums = drawn.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("pattern", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.withColumn("inside", inside).join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    # a document belongs to the stretch in which its middle lies, so that over many documents the stretches get their tokens
    middle = F.col("at") + F.floor(F.col("tokens") / 2)
    used = placed.join(F.broadcast(plan_df), "pattern").filter((middle >= F.col("lo")) & (middle < F.col("hi")))
    return used.groupBy("id", "source").agg(F.count("*").cast("int").alias("times"), F.max("tokens").alias("tokens")).withColumnRenamed("id", id_col)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, uses, most_uses, tokens, share): what the mix reached; share is of the mix's tokens."""
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("times").alias("uses"), F.max("times").alias("most_uses"), F.sum(F.col("times") * F.col("tokens")).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row for each source
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").na.fill(0, ["documents", "uses", "most_uses", "tokens"])
    return out.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
