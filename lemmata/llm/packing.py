"""Problem 6: documents laid into containers of fixed capacity with little room left over.

Method: best-fit decreasing. A segment tree over the remaining capacities counts the open bins of each,
and finds the tightest bin that a document fits in logarithmic time, whatever the capacity. Only (id, size) pairs travel; a hash
of the id deals them into blocks of about ``BLOCK_ROWS`` documents, each packed by one task, so that a
task's memory has a bound and the only room lost to the blocks is in the last bins of each.

A document larger than the capacity is the only one split: into full containers, and a rest that is
packed like any other document.

Defined results
* a null or empty text has size 0 and goes to the tightest bin open when all others are placed, or to a new one;
* one that fits exactly is not split; ties in size are placed by id, a null id first;
* repeated rows are documents of their own; an empty table gives an empty result;
* other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.plans.runtime import partitions_of

#: Documents to a block, on average.
BLOCK_ROWS = 50_000


def byte_tokens(text: Column) -> Column:
    """Tokens of the byte-level tokenizer of ByT5 without end mark: one per UTF-8 byte."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


class TightestBin:
    """Open bins by remaining capacity, in a segment tree of counts.

    Up to LEAVES a leaf stands for one remaining capacity; beyond, for a range of them, whose bins are kept in order,
    so that the tree does not grow with the capacity.
    """

    LEAVES = 1 << 16

    def __init__(self, capacity: int):
        self.shift = max(0, capacity.bit_length() - (self.LEAVES.bit_length() - 1))
        self.leaves = 1 << max(1, (capacity >> self.shift).bit_length())
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, left: int, bin_no: int) -> None:
        held = self.bins.setdefault(left >> self.shift, [])
        # of bins with the same room the latest is taken first
        held.insert(bisect_left(held, left, key=itemgetter(0)), (left, bin_no)) if self.shift else held.append((left, bin_no))
        i = (left >> self.shift) + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (remaining, bin) of the bin with the least remaining capacity >= size."""
        count, i = self.count, (size >> self.shift) + self.leaves
        if i >= 2 * self.leaves:
            return None
        at = -1
        if self.shift and count[i]:  # bins of the same range may still be too small
            held = self.bins[i - self.leaves]
            at = bisect_left(held, size, key=itemgetter(0))
        if not count[i] or self.shift and at == len(held):
            at = 0 if self.shift else -1
            while i > 1 and (i & 1 or not count[i + 1]):  # climb until a right sibling has bins
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i <<= 1
                if not count[i]:
                    i += 1
        left, bin_no = self.bins[i - self.leaves].pop(at)
        while i:
            count[i] -= 1
            i >>= 1
        return left, bin_no


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of every size (all at most capacity), placed in the order given by falling size; and the bins used."""
    order = np.argsort(-sizes, kind="stable")
    tree, placed, used = TightestBin(capacity), np.empty(len(sizes), np.int64), 0
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        found = tree.take(size)
        if found is None:
            found, used = (capacity, used), used + 1
        left, bin_no = found
        placed[k] = bin_no
        tree.add(left - size, bin_no)
    return placed, used


OUT = "container string, capacity_tokens bigint, block int, bin_no bigint, doc_id {id}, piece int, start bigint, tokens bigint, is_split boolean"


def pack(df: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", size: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece: its container kind, bin (block, bin_no), and the range of tokens it holds.

    limits: (container, capacity_tokens), a handful of rows; null or non-positive capacities are ignored.
    size: the size in tokens, by default the bytes of text.
    """
    kinds = [(r[0], int(r[1])) for r in limits.select("container", "capacity_tokens").filter("capacity_tokens > 0").distinct().orderBy("container", "capacity_tokens").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    sized = df.select(F.col(key).alias("doc_id"), (byte_tokens(F.col(text)) if size is None else F.coalesce(size, F.lit(0)).cast("bigint")).alias("n"))
    kind_of_id = dict(sized.dtypes)["doc_id"]
    blocks = max(1, -(-df.count() // block_rows))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "n"), F.lit(blocks)).cast("int"))
    sized = sized.repartition(min(blocks, max(blocks, partitions_of(df.sparkSession))), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # (id, size, block) of this task's blocks only
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        t = t.sort_by([("block", "ascending"), ("doc_id", "ascending")])
        block, n, ids = t["block"].to_numpy(), t["n"].to_numpy(), t["doc_id"].combine_chunks()
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.array([], int)
        for lo, hi in zip(starts, np.r_[starts[1:], len(block)]):
            for name, capacity in kinds:
                yield from one(name, capacity, int(block[lo]), ids.slice(lo, hi - lo), n[lo:hi])

    def one(name: str, capacity: int, block: int, ids: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        large = n > capacity
        full = np.where(large, n // capacity, 0)
        rest = n - full * capacity
        packed = np.flatnonzero(~large | (rest > 0))
        where, used = best_fit_decreasing(rest[packed], capacity)
        rows = np.r_[packed, np.repeat(np.arange(len(n)), full)]
        chunk = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
        piece = np.r_[full[packed], chunk]
        tokens = np.r_[rest[packed], np.full(len(chunk), capacity, np.int64)]
        bins = np.r_[where, used + np.arange(len(chunk))]
        for a in range(0, len(rows), 20_000):
            s = slice(a, a + 20_000)
            m = len(rows[s])
            yield pa.RecordBatch.from_pydict(
                {
                    "container": pa.array([name] * m, pa.string()),
                    "capacity_tokens": pa.array(np.full(m, capacity, np.int64)),
                    "block": pa.array(np.full(m, block, np.int32)),
                    "bin_no": pa.array(bins[s].astype(np.int64)),
                    "doc_id": ids.take(pa.array(rows[s])),
                    "piece": pa.array(piece[s].astype(np.int32)),
                    "start": pa.array((piece[s] * capacity).astype(np.int64)),
                    "tokens": pa.array(tokens[s].astype(np.int64)),
                    "is_split": pa.array(large[rows[s]]),
                }
            )

    return sized.mapInArrow(run, OUT.format(id=kind_of_id))
