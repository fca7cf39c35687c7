"""Problem 3: records that are versions of each other, grouped without comparing all pairs.

Method: a Gray-order hierarchical index over fingerprints. A record is the set of its distinct words, read
without markup and character residue. Its lanes are the minima of weighted hashes of its words; bits of every
lane make its fingerprint. A mask shows the bits of three lanes: records that agree in the masked pattern hang
under one upper node, and every record is under ``BANDS`` of them, one for each mask. Rows of (masked pattern,
rest of the fingerprint) are sorted by Gray rank over the whole cluster, so that a node is one run of
neighbours that share most bits, and a node may go on from one task to the next. Below a node every ``FANOUT``
neighbours get a parent that holds the bits they share, level by level. A search goes from the node down,
adds up at each level the differences in the bits newly shared there, and drops a whole group once they
exceed the limit. What is left is checked exactly: shared words over all words of both, at least ``threshold``.

Sketches. Unrelated records that share common words pass the limit in a number that grows with the square of the
collection, and word sets must not travel once for each of them. So a row also carries the number of its words and
an odd sketch: for each of ``ODD`` classes of words whether their number is odd. A word that only one of two records
has changes one bit, so that the bits that differ are never more than such words; a pair with more of them than
``threshold`` allows is dropped in the node where it was met. No pair that the exact check would keep is dropped.
Patterns are sorted in ``PASSES``, one after the other, so that only a part of the rows is on disk at a time.

Weights. A rare word weighs 1, one in all records 0.02, so that a lane agrees about as often as two records
share what is particular to them. But versions share at least seven words in ten, so no record may hang on the
fewest of its words: weights are cut at the one that a ``TRUSTED`` share of the record's words does not exceed.
In a group that makes up much of the collection, where all shared words are common, the words of a single
version then weigh no more than the shared ones.

Equal word sets are one class from the start and travel once. A node that is cut by the end of a task, or has
more than ``BLOCK`` records, is handed on in blocks; every two blocks of a node meet, unless the bits that each
of them shares already differ too much, and are searched through the same hierarchy. So no node, however large,
is held by one task, and none loses a pair. Classes are closed by alternating star contraction, every round
written to the shared folder; its joins are plain inner joins, whose hot keys AQE splits.

Defined results
* a record with a null or blank statement is in no group; a null slogan counts as empty;
* a record without any word is in no group; equal word sets are versions, also of repeated rows;
* records with a null id take part in classes but in no pair; an empty table gives an empty result;
* other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm import glyphs
from lemmata.plans.runtime import materialize, partitions_of

THRESHOLD = 0.7
LANES, BANDS, ROWS = 64, 14, 3
#: Bits that each lane adds to a masked pattern; three lanes tell 2 ** 36 patterns apart.
MASKED = 12
#: Differing bits of the other 128 (two of each lane) up to which two records are compared exactly: about 20 are
#: expected at the threshold, and over 60 of unrelated records.
LIMIT = 40
#: Words in fewer than this share of the records weigh the same; so at most (words a record) / COMMON words have a weight of their own.
COMMON = 0.002
TRUSTED = 0.7
FANOUT, BLOCK = 4, 16_000
#: Bits of an odd sketch; 16 more of its two words are the number of words, which TOO_MANY or more are not told apart.
ODD, TOO_MANY = 112, (1 << 16) - 1
#: Parts in which the masked patterns are sorted and searched.
PASSES = 2
#: Pairs of a record and a group that a search holds at a time.
HELD = 1 << 20
#: Copies of one word set that meet the others in one task when pairs are listed.
COPIES = 1000

_ENTITY = r"&(?:\#\w+|[A-Za-z]\w{1,15});"
_NOISE = re.compile(
    rf"""<!--.*?-->|</?[A-Za-z][^<>]*>|{_ENTITY}
    |\[\[(?:[Cc]ategory|[Ff]ile|[Ii]mage|[Dd]ef(?:inition)?):[^\[\]|]*\|?
    |\{{\{{[^{{}}]*\}}\}}|\]\([^()\s]*\)|```\w*
    |\\(?:label|cite\w*|(?:eq|c|C|auto|page|name)?ref|color|textcolor|colorbox|begin|end|bibitem)\*?(?:\[[^\]\n]*\])?\{{[^{{}}]*\}}(?:\[[^\]\n]*\])?
    |\\(?:text[a-z]{{2}}|emph|underline|footnote|item|noindent|newpage|hfill|medskip|smallskip|bigskip|clearpage|(?:sub)*section|chapter|paragraph)(?![a-zA-Z])\*?""",
    re.S | re.X,
)
_MARKED = re.compile(r"[<&`]|\[\[|\{\{|\]\(|\\(?:label|cite|ref|eqref|cref|Cref|autoref|pageref|nameref|color|text|begin|end|emph|underline|footnote|item|noindent|newpage|hfill|medskip|(?:sub)*section|paragraph)")
_LOOKS = "".join(glyphs.LOOKS_LIKE)
_DISGUISED = re.compile(f"[A-Za-z][{_LOOKS}]|[{_LOOKS}][A-Za-z]|[Ѐ-ӿԁօ]{{2}}")
_WORD = re.compile(r"[^\W_]+")
_ANY = glyphs.Anything()


def words(slogan: str | None, statement: str) -> set[str]:
    """The distinct words of a record as a reader sees them."""
    text = f"{slogan or ''}\n{statement}"
    if _MARKED.search(text):
        text = _NOISE.sub(" ", text)
    if not text.isascii():
        text = glyphs.by_rule(text)
        if _DISGUISED.search(text):
            text = glyphs.repair(text, _ANY)
    return set(_WORD.findall(text.lower()))


def word_sets(df: DataFrame, key: str, slogan: str, statement: str) -> DataFrame:
    """(id, doc_id, h, w): a number for each row, the hash of its word set, and the hashes of its words; written once."""
    base = df.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("doc_id"), F.col(slogan).cast("string").alias("s"), F.col(statement).cast("string").alias("t"))
    kind = dict(base.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        for b in batches:
            keep, sizes, flat = [], [], []
            for i, (s, t) in enumerate(zip(b["s"].to_pylist(), b["t"].to_pylist())):
                if not t or t.isspace() or not (found := words(s, t)):
                    continue
                for w in found:
                    c = codes.get(w)
                    if c is None:
                        if len(codes) > 1_000_000:
                            codes.clear()
                        c = codes[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little", signed=True)
                    flat.append(c)
                keep.append(i)
                sizes.append(len(found))
            w = np.array(flat, np.int64)
            starts = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            w = w[np.lexsort((w, np.repeat(np.arange(len(sizes)), sizes)))] if len(w) else w
            # two sums of mixed hashes name a set whatever the order
            mixed = _mix(w.view(np.uint64))
            h = np.add.reduceat(mixed, starts[:-1]).view(np.int64) if len(sizes) else w
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(at), b["doc_id"].take(at), pa.array(h, pa.int64()), pa.ListArray.from_arrays(pa.array(starts), pa.array(w))],
                names=["id", "doc_id", "h", "w"],
            )

    return materialize(base.mapInArrow(run, f"id bigint, doc_id {kind}, h bigint, w array<bigint>"), "dup-words")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def common_words(sets: DataFrame, rows: int) -> dict[int, float]:
    """Weights of the words in at least COMMON of all records; there are at most (words a record) / COMMON."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = np.unique(b["w"].flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["w", "n"])

    floor = max(2.0, COMMON * rows)
    counts = sets.select("w").mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
    top = math.log(1 / COMMON)
    return {r[0]: max(0.02, min(1.0, math.log(rows / r[1]) / top)) for r in counts.collect()}


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of a 64-bit pattern in the order of the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits ^ (bits >> np.uint64(s))
    return bits


def to_gray(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Gray rank of 128-bit patterns given as two words, high first."""
    ra, rb = gray_rank(a), gray_rank(b)
    return ra, np.where(ra & np.uint64(1), ~rb, rb)


def from_gray(ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.uint64(1)
    return ra ^ (ra >> one), rb ^ (rb >> one) ^ ((ra & one) << np.uint64(63))


def trusted(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weights of the words of records laid end to end, cut at what a TRUSTED share of a record's words does not exceed."""
    sizes = np.diff(np.r_[starts, len(v)])
    most = np.ceil(TRUSTED * sizes).astype(np.int64) - 1
    # only where too few words have the full weight is there anything to cut
    cut = np.add.reduceat(v >= 1, starts) < sizes - most
    if not cut.any():
        return v
    at = np.flatnonzero(np.repeat(cut, sizes))
    sub, n = v[at], sizes[cut]
    first = np.cumsum(n) - n
    order = np.lexsort((sub, np.repeat(np.arange(len(n)), n)))
    out = v.copy()
    out[at] = np.minimum(sub, np.repeat(sub[order[first + most[cut]]], n))
    return out


def fingerprints(w: np.ndarray, starts: np.ndarray, weight_words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Gray rank in two words of the bits that all rows carry, Gray rank of each masked pattern) of word sets laid end to end."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, BANDS), np.int64)
    vocabulary, at = np.unique(w, return_inverse=True)
    v = np.ones(len(vocabulary), np.float32)
    if len(weight_words):
        k = np.minimum(np.searchsorted(weight_words, vocabulary), len(weight_words) - 1)
        v = np.where(weight_words[k] == vocabulary, weights[k], 1.0).astype(np.float32)
    slower = 1 / trusted(v[at], starts)
    lanes = np.empty((len(starts), LANES), np.uint32)
    seeds = _mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = vocabulary.view(np.uint64)
    for j in range(LANES):
        u = ((_mix(base ^ seeds[j]) >> np.uint64(40)).astype(np.float32) + 0.5) / np.float32(1 << 24)
        # which word has the least, and not its value, makes the lane: weights differ a little between versions
        e = (-np.log(u))[at] * slower
        least = np.repeat(np.minimum.reduceat(e, starts), np.diff(np.r_[starts, len(e)]))
        on = np.flatnonzero(e == least)
        owner = np.searchsorted(starts, on, side="right") - 1
        lanes[owner, j] = (base[at[on]] >> np.uint64(32)).astype(np.uint32)
    mixed = _mix(lanes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seeds)
    high, low = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for j in range(LANES):
        high |= (mixed[:, j] & np.uint64(1)) << np.uint64(j)
        low |= (mixed[:, j] >> np.uint64(1) & np.uint64(1)) << np.uint64(j)
    masked = np.empty((len(starts), BANDS), np.int64)
    part = mixed >> np.uint64(2) & np.uint64((1 << MASKED) - 1)
    for b in range(BANDS):
        k = np.zeros(len(starts), np.uint64)
        for r in range(ROWS):
            k = k << np.uint64(MASKED) | part[:, b * ROWS + r]
        masked[:, b] = (gray_rank(k) | np.uint64(b << MASKED * ROWS)).view(np.int64)
    return *to_gray(high, low), masked


def odd_sketches(w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each of the word sets laid end to end: 64 bits of its odd sketch; the other 48 and, below them, the number of its words."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place = w.view(np.uint64) % np.uint64(ODD)
    bit = np.uint64(1) << (place & np.uint64(63))
    first = place < 64
    high = np.bitwise_xor.reduceat(np.where(first, bit, np.uint64(0)), starts)
    low = np.bitwise_xor.reduceat(np.where(first, np.uint64(0), bit), starts)
    sizes = np.minimum(np.diff(np.r_[starts, len(w)]), TOO_MANY).astype(np.uint64)
    return high, low << np.uint64(16) | sizes


def may_be_versions(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Whether the sketches of two records allow them to be threshold alike; never false where they are."""
    size = np.uint64(TOO_MANY)
    m, n = a[1] & size, b[1] & size
    apart = np.bitwise_count(a[0] ^ b[0]).astype(np.int64) + np.bitwise_count((a[1] ^ b[1]) >> np.uint64(16))
    # words of one of the two, and so the difference of their numbers too, are at most (1 - t) / (1 + t) of the words of both
    apart = np.maximum(apart, np.abs(m.astype(np.int64) - n.astype(np.int64)))
    return (apart * (1 + threshold) <= (m + n).astype(np.float64) * (1 - threshold) + 1e-6) | (m == size) | (n == size)


ROW = np.dtype([("g", "<u8"), ("f", "<u8"), ("u", "<u8"), ("v", "<u8"), ("keys", "<i8", (BANDS,))])


def index_rows(sets: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(h, rep, g, f, u, v, keys) of each distinct word set; u and v hold its odd sketch."""
    words_ = np.array(sorted(weights), np.int64)
    values = np.array([weights[k] for k in words_.tolist()], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b["w"]
            w, starts = col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.offsets)[:-1] - col.offsets[0].as_py()
            g, f, masked = fingerprints(w, starts, words_, values)
            rows = np.empty(len(g), ROW)
            rows["g"], rows["f"], rows["keys"] = g, f, masked
            rows["u"], rows["v"] = odd_sketches(w, starts)
            packed = pa.Array.from_buffers(pa.binary(ROW.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([b["h"], b["id"], packed.cast(pa.binary())], names=["h", "id", "x"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b["x"].to_pylist()), ROW)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32)), pa.array(np.ascontiguousarray(rows["keys"]).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b["h"], b["rep"], *(pa.array(rows[c].view(np.int64)) for c in "gfuv"), keys], names=["h", "rep", *"gfuv", "keys"])

    rows = sets.select("id", "h", "w").mapInArrow(run, "h bigint, id bigint, x binary")
    # equal sets have equal rows: one of each stays
    rows = rows.groupBy("h").agg(F.min("id").alias("rep"), F.first("x").alias("x"))
    return materialize(rows.mapInArrow(unpack, "h bigint, rep bigint, g bigint, f bigint, u bigint, v bigint, keys array<bigint>"), "dup-index")


class Hierarchy:
    """Nodes, each a run of fingerprints in Gray order, with the bits shared by every FANOUT neighbours, level by level.

    counts: how many (record, group) pairs were met at each depth, and how many of them were dropped there.
    """

    def __init__(self, bits: tuple[np.ndarray, np.ndarray], runs: np.ndarray):
        n = len(bits[0])
        self.bits, self.runs, self.sizes = bits, runs, np.diff(np.r_[runs, n])
        place = np.arange(n) - np.repeat(runs, self.sizes)
        first, on, any_ = np.arange(n), bits, bits
        full = np.full(n, ~np.uint64(0))
        # from the leaves up: bits that are shared, which they are, where the group ends, and where its children begin
        self.levels = [(on, (full, full), first + 1, None)]
        width = 1
        while len(first) > len(runs):
            width *= FANOUT
            here = np.flatnonzero(place % width == 0)
            kids = np.searchsorted(first, here)
            on = tuple(np.bitwise_and.reduceat(x, kids) for x in on)
            any_ = tuple(np.bitwise_or.reduceat(x, kids) for x in any_)
            first = here
            self.levels.append((on, tuple(~(x ^ y) for x, y in zip(on, any_)), np.r_[here[1:], n], np.r_[kids, len(self.levels[-1][2])]))
        self.counts: dict[int, list[int]] = {}

    def near(self, limit: int, asked: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within a node (i < j) that differ in at most limit bits, some at a time; or, if others are asked for, their pairs (place in asked, place here) with the only node."""
        own = asked is None
        x = self.bits if own else asked
        node = np.repeat(np.arange(len(self.runs)), self.sizes) if own else np.zeros(len(x[0]), np.int64)
        cost = np.cumsum(self.sizes[node]) if len(node) else node
        lo = 0
        while lo < len(node):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + HELD, side="right")))
            at, group = np.arange(lo, hi), node[lo:hi]
            lo = hi
            on, shared, _, _ = self.levels[-1]
            differ = sum(np.bitwise_count((y[at] ^ o[group]) & m[group]) for y, o, m in zip(x, on, shared)).astype(np.int16)
            if len(self.levels) == 1:  # a node of one record: it is no pair of its own
                ok = np.flatnonzero((differ <= limit) & (not own))
                at, differ, group = at[ok], differ[ok], group[ok]
            for level in range(len(self.levels) - 2, -1, -1):
                above, kids = self.levels[level + 1][1], self.levels[level + 1][3]
                on, shared, end, _ = self.levels[level]
                n = kids[group + 1] - kids[group]
                at, differ, parent = np.repeat(at, n), np.repeat(differ, n), np.repeat(group, n)
                group = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + kids[parent]
                if own:  # a record is only paired with later ones: groups that end before it are left out
                    later = np.flatnonzero(end[group] > at + 1)
                    at, differ, parent, group = at[later], differ[later], parent[later], group[later]
                differ = differ + sum(np.bitwise_count((y[at] ^ o[group]) & (m[group] & ~a[parent])) for y, o, m, a in zip(x, on, shared, above))
                ok = np.flatnonzero(differ <= limit)
                met = self.counts.setdefault(level, [0, 0])
                met[0] += len(at)
                met[1] += len(at) - len(ok)
                at, differ, group = at[ok], differ[ok], group[ok]
            yield at, group


def within(bits: tuple[np.ndarray, np.ndarray], runs: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of all nodes; nodes of like size are searched together, those of one record have none."""
    sizes = np.diff(np.r_[runs, len(bits[0])])
    low = 1
    while (sizes > low).any():
        mine = (sizes > low) & (sizes <= low * FANOUT)
        if mine.any():
            at = np.flatnonzero(np.repeat(mine, sizes))
            n = sizes[mine]
            for i, j in Hierarchy(tuple(x[at] for x in bits), np.cumsum(n) - n).near(limit):
                yield at[i], at[j]
        low *= FANOUT


MEMBER = np.dtype([("g", "<u8"), ("f", "<u8"), ("u", "<u8"), ("v", "<u8"), ("rep", "<i8")])
FOUND = "a bigint, b bigint, key bigint, block bigint, on_g bigint, on_f bigint, off_g bigint, off_f bigint, x binary"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _pairs(rep_a: np.ndarray, rep_b: np.ndarray) -> pa.RecordBatch:
    n = len(rep_a)
    both = [pa.array(np.minimum(rep_a, rep_b)), pa.array(np.maximum(rep_a, rep_b))]
    return pa.RecordBatch.from_arrays(both + [pa.nulls(n, pa.int64())] * 6 + [pa.nulls(n, pa.binary())], names=_NAMES)


def _search(limit: int, size: int, threshold: float, begin: int):
    """Rows in Gray order to pairs of representatives, and to blocks, numbered from begin on, of the nodes that are not whole in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = begin + (TaskContext.get().partitionId() << 32)
        none = np.zeros(0, np.int64)
        held, opened = (none, *[none.view(np.uint64)] * 4, none), True

        def block(key, g, f, u, v, rep) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for a in range(0, len(key), size):
                rows = np.empty(len(key[a : a + size]), MEMBER)
                for c, x in zip(MEMBER.names, (g, f, u, v, rep)):
                    rows[c] = x[a : a + size]
                bits = from_gray(rows["g"], rows["f"])
                shared = [np.bitwise_and.reduce(x) for x in bits] + [~np.bitwise_or.reduce(x) for x in bits]
                numbers = [pa.array(np.array([x], np.int64)) for x in (key[a], number)] + [pa.array(np.array([x], np.uint64).view(np.int64)) for x in shared]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2 + numbers + [pa.array([rows.tobytes()], pa.binary())], names=_NAMES)
                number += 1

        def solve(key, g, f, u, v, rep) -> Iterator[pa.RecordBatch]:
            runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[runs, len(key)])
            apart = sizes > size
            apart[0] |= opened
            for s, n in zip(runs[apart], sizes[apart]):
                yield from block(*(x[s : s + n] for x in (key, g, f, u, v, rep)))
            at = np.flatnonzero(np.repeat((sizes > 1) & ~apart, sizes))
            n = sizes[(sizes > 1) & ~apart]
            u, v, rep = u[at], v[at], rep[at]
            for i, j in within(from_gray(g[at], f[at]), np.cumsum(n) - n, limit):
                ok = np.flatnonzero(may_be_versions((u[i], v[i]), (u[j], v[j]), threshold))
                if len(ok):
                    yield _pairs(rep[i[ok]], rep[j[ok]])

        for batch in batches:
            more = batch["key"].to_numpy(), *(batch[c].to_numpy().view(np.uint64) for c in "gfuv"), batch["rep"].to_numpy()
            held = tuple(np.concatenate(x) for x in zip(held, more))
            if len(held[0]) < 100_000:
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))  # all nodes but the last are whole, or began in another task
            if last:
                yield from solve(*(x[:last] for x in held))
                held, opened = tuple(x[last:] for x in held), False
            whole = len(held[0]) // size * size
            if whole:
                yield from block(*(x[:whole] for x in held))
                held, opened = tuple(x[whole:] for x in held), True
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from solve(*(x[:last] for x in held))
            yield from block(*(x[last:] for x in held))  # it may go on in the next task

    return run


def _meet(limit: int, threshold: float):
    """Two blocks a row, or one with itself, to pairs of representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(batch[c][k].as_py(), MEMBER) for c in ("x", "y"))
                own = batch["i"][k].as_py() == batch["j"][k].as_py()
                index = Hierarchy(from_gray(q["g"], q["f"]), np.zeros(1, np.int64))
                for s, t in index.near(limit, None if own else from_gray(p["g"], p["f"])):
                    ok = may_be_versions((p["u"][s], p["v"][s]), (q["u"][t], q["v"][t]), threshold)
                    s, t = s[ok], t[ok]
                    if len(s):
                        yield _pairs(p["rep"][s], q["rep"][t]).select(["a", "b"])

    return run


def candidates(rows: DataFrame, limit: int = LIMIT, size: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of representatives under a common node whose fingerprints differ in at most limit bits and whose sketches allow threshold; repeated if they meet in several nodes."""
    n, size = partitions_of(rows.sparkSession), BLOCK if size is None else size
    # Gray ranks are unsigned: with the first bit turned they sort as signed numbers do
    order = ["key"] + [F.col(c).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")) for c in ("g", "f")] + [F.col("rep")]
    found = None
    for k in range(PASSES):
        bands = range(BANDS * k // PASSES, BANDS * (k + 1) // PASSES)
        nodes = rows.select(F.explode(F.slice("keys", bands[0] + 1, len(bands))).alias("key"), "g", "f", "u", "v", "rep")
        nodes = nodes.repartitionByRange(n, *order).sortWithinPartitions(*order)
        part = materialize(nodes.mapInArrow(_search(limit, size, threshold, k << 56), FOUND), "dup-found")
        found = part if found is None else found.unionByName(part)
    blocks = found.filter("block IS NOT NULL")
    p, q = (blocks.select("key", F.col("block").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("on_g", "on_f", "off_g", "off_f"))) for k in "ij")
    apart = [F.bit_count(F.col(f"i_{x}_{c}").bitwiseAND(F.col(f"j_{y}_{c}"))) for c in "gf" for x, y in (("on", "off"), ("off", "on"))]
    both = p.join(q, "key").filter("i <= j").filter(apart[0] + apart[1] + apart[2] + apart[3] <= limit).select("i", "j")
    both = both.join(blocks.select(F.col("block").alias("i"), "x"), "i").repartition(n, "j")
    both = both.join(blocks.select(F.col("block").alias("j"), F.col("x").alias("y")), "j")
    met = both.select("i", "j", "x", "y").mapInArrow(_meet(limit, threshold), "a bigint, b bigint")
    return found.filter("block IS NULL").select("a", "b").unionByName(met)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity), once each, whose word sets are at least threshold alike."""
    # one exchange serves the removal of repeats and the first join
    pairs = materialize(pairs.repartition(partitions_of(pairs.sparkSession), "a").distinct(), "dup-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    w = materialize(sets.select("id", "w").join(asked, "id", "left_semi"), "dup-asked")
    x = pairs.join(w.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(w.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    x = x.select("a", "b", both.alias("i"), (F.size("wa") + F.size("wb") - both).alias("u"))
    return x.filter(F.col("i") >= F.lit(threshold) * F.col("u") - 1e-9).select("a", "b", (F.col("i") / F.col("u")).alias("similarity"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every end of a link: the least id that it hangs together with, by alternating stars."""
    e = materialize(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct(), "dup-edges")
    before = None
    for _ in range(rounds):
        # large star: every neighbour above goes to the least neighbour
        both = e.select("x", "y").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        e = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: every neighbour below, and the node itself, goes to the least of them
        least = e.groupBy("x").agg(F.min("y").alias("m"))
        e = e.join(least, "x").select(F.explode(F.array("x", "y")).alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        e = materialize(e, "dup-star")
        now = tuple(e.agg(F.count("*"), F.sum("y"), F.sum(F.hash("x", "y"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the classes are not closed after {rounds} rounds")
    return e.select(F.col("x").alias("id"), F.col("y").alias("root"))


class Versions:
    """The groups of versions of a collection: links between distinct word sets, and who has which."""

    def __init__(self, df: DataFrame, key: str = "doc_id", slogan: str = "slogan", statement: str = "statement", threshold: float = THRESHOLD):
        self.sets = word_sets(df, key, slogan, statement)
        self.key = key
        rows = self.sets.count()
        weights = common_words(self.sets, rows) if rows else {}
        index = index_rows(self.sets, weights)
        self.members = self.sets.select("id", "doc_id", "h").join(index.select("h", "rep"), "h").select("id", "doc_id", "rep")
        self.links = materialize(verified(candidates(index, threshold=threshold), self.sets, threshold), "dup-links")

    def classes(self) -> DataFrame:
        """(key, class_id, copies, links): of every record with words, the least record number in its class, the records with the same words, and the other sets it is linked with."""
        roots = components(self.links)
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        copies = self.members.groupBy("rep").agg(F.count("*").alias("copies"))
        reps = copies.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(ends, "rep", "left")
        reps = reps.select("rep", F.coalesce("root", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
        return self.members.join(reps, "rep").select(F.col("doc_id").alias(self.key), "class_id", "copies", "links")

    def pairs(self) -> DataFrame:
        """All pairs of records (a < b by id) that are versions of each other.

        Copies of a word set are dealt into parts of about COPIES, and every two parts meet in a task of their own, so
        that a set with many copies is split; a set with one copy has one part.
        """
        m = self.members.filter("doc_id IS NOT NULL")
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("linked", F.lit(True))
        parts = m.groupBy("rep").agg(F.count("*").alias("n")).join(ends, "rep", "left").filter("n > 1 OR linked")
        # most records are alone: those that are not are written once
        parts = materialize(parts.select("rep", "n", F.ceil(F.col("n") / COPIES).alias("parts")), "dup-parts")
        m = m.join(parts, "rep").select("doc_id", "rep", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        m = materialize(m, "dup-versions")
        a = m.select(F.col("rep").alias("a"), F.col("doc_id").alias("da"), F.col("part").alias("pa"))
        b = m.select(F.col("rep").alias("b"), F.col("doc_id").alias("db"), F.col("part").alias("pb"))
        size = parts.select("rep", "parts")
        links = self.links.select("a", "b").join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
        links = links.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("pa"), "nb")
        links = links.select("a", "b", "pa", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pb"))
        many = parts.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pa"), "parts")
        many = many.select("a", "b", "pa", F.explode(F.sequence(F.lit(0), F.col("pa"))).alias("pb"))
        out = links.unionByName(many).join(a, ["a", "pa"]).join(b, ["b", "pb"]).filter("da <> db")
        return out.select(F.least("da", "db").alias(f"{self.key}_a"), F.greatest("da", "db").alias(f"{self.key}_b")).distinct()
