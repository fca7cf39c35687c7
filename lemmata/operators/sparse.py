"""Okapi BM25 for a batch of queries, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import columns as C
from lemmata.plans.runtime import BROADCAST_ROWS, materialize, partitions_of
from lemmata.sources import writers

K1, B = 1.5, 0.75


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term): the distinct terms of each query; a repeated term counts once."""
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(C.tokens(F.col(text)))).alias("term"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: records, and their mean length in tokens (G1)."""
    n = F.coalesce(F.size(C.tokens(F.col(text))), F.lit(0))
    return docs.agg(F.count("*").alias("n"), F.avg(F.greatest(n, F.lit(0))).alias("avgdl"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, len, term, tf) of every record and term."""
    t = docs.select(F.col(key).alias("doc_id"), C.tokens(F.col(text)).alias("t"))
    return t.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def scores(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, keep=None) -> DataFrame:
    """(query_id, doc_id, score) of every pair with a common term.

    Tokens that no query has are dropped before the shuffle; rows travel once, by record, and neither the term counts
    nor the sums over a record's terms need another exchange. keep: a condition on the records, applied after the
    statistics, which are those of all records.
    """
    stats = corpus_stats(docs, text).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else lambda x: x
    wanted = terms.select("term").distinct()
    t = docs.select(F.col(key).alias("doc_id"), C.tokens(F.col(text)).alias("t"), *([] if keep is None else [keep.alias("_keep")]))
    t = t.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term"), *([] if keep is None else ["_keep"])).join(hint(wanted), "term")
    tf = t.repartition(partitions_of(docs.sparkSession), "doc_id").groupBy("doc_id", "len", "term", *([] if keep is None else ["_keep"])).agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = terms.join(idf, "term")
    if keep is not None:
        tf = tf.filter("_keep")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avgdl)))
    return tf.join(hint(weighted), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank, score) of the k best of each query; ties by id; partial lists before the shuffle."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scored.withColumn("rank", r).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


#: Records to a block of the index, and queries to a block that is scored against it.
DOC_BLOCK, QUERY_BLOCK = 4096, 512
_INDEX = "ids array<string>, keep array<boolean>, lens array<int>, terms array<string>, ends array<int>, docs array<int>, tfs array<int>"


def block_index(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """The postings of DOC_BLOCK records to a row: distinct terms, and by term the records and their counts. Written once."""
    base = docs.select(F.col(key).cast("string").alias("id"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep"), F.coalesce(C.tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))

    def block(b: pa.Table) -> pa.RecordBatch:
        t = b["t"].combine_chunks()
        n = np.diff(np.asarray(t.offsets))
        words = t.flatten().dictionary_encode()
        term, of = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
        pair, tf = np.unique(term * len(n) + of, return_counts=True) if len(term) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        term, doc = pair // max(1, len(n)), pair % max(1, len(n))
        ends = np.searchsorted(term, np.arange(len(words.dictionary)), side="right")

        def row(x, kind):
            x = x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x.astype(np.int32))
            x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))

        return pa.RecordBatch.from_arrays(
            [row(b["id"], pa.string()), row(b["keep"], pa.bool_()), row(n, pa.int32()), row(words.dictionary, pa.string()), row(ends, pa.int32()), row(doc, pa.int32()), row(tf, pa.int32())],
            names=[f.split()[0] for f in _INDEX.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for a in range(0, b.num_rows, DOC_BLOCK):
                held.append(b.slice(a, DOC_BLOCK))
                rows += held[-1].num_rows
                if rows >= DOC_BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))

    return materialize(base.mapInArrow(run, _INDEX), "bm25-index")


def _counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) over all blocks, of the asked terms only: the others are dropped before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, ends in zip(b["terms"], b["ends"]):
                e = np.asarray(ends.values)
                yield pa.RecordBatch.from_arrays([terms.values, pa.array(np.diff(np.r_[0, e]).astype(np.int64))], names=["term", "df"])

    counts = index.select("terms", "ends").mapInArrow(run, "term string, df bigint")
    return counts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


#: Queries of a block that are scored in one pass, and blocks of queries that a task keeps decoded.
PASS, DECODED = 64, 64


class _Asked:
    """A block of queries: its distinct terms, and by query the places and weights of its terms in order of term."""

    def __init__(self, rows: list[dict]):
        self.ids = [r["query_id"] for r in rows]
        words = sorted({w["term"] for r in rows for w in r["w"]})
        place = {w: i for i, w in enumerate(words)}
        flat = sorted((q, place[w["term"]], w["idf"]) for q, r in enumerate(rows) for w in r["w"])
        self.words = words
        self.query, self.term, self.idf = (np.array(x, t) for x, t in zip(zip(*flat), (np.int64, np.int64, float)))

    def scores(self, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, gain: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, scores of PASS queries x docs); at: by own term, its place in the record block, or -1."""
        here = at[self.term]
        for a in range(0, len(self.ids), PASS):
            lo, hi = np.searchsorted(self.query, [a, a + PASS])
            on = np.flatnonzero(here[lo:hi] >= 0) + lo
            n = ends[here[on]] - starts[here[on]]
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[here[on]], n)
            cell = np.repeat(self.query[on] - a, n) * docs + doc[rows]
            many = min(PASS, len(self.ids) - a)
            yield a, np.bincount(cell, np.repeat(self.idf[on], n) * gain[rows], many * docs).reshape(many, docs)


def block_top(docs: DataFrame | None, terms: DataFrame, k: int, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, keep: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score) of the k best, as top(scores(...)), on blocks.

    Blocks of queries meet blocks of records; a block adds up arrays by term and passes on its k best of each
    query, so neither all scored pairs nor a common term's postings are ever shuffled. index: as block_index() or
    open_index() give it, in place of docs and keep.
    """
    index = block_index(docs, key, text, keep) if index is None else index
    stats = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)).alias("total")).first()
    n, avgdl = stats["n"], (stats["total"] / stats["n"] if stats["total"] else 1.0)
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(_counts(index, terms), "term").select("query_id", F.struct("term", idf.alias("idf")).alias("w")).groupBy("query_id").agg(F.collect_list("w").alias("w"))
    weighted = materialize(weighted, "bm25-asked")
    blocks = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-weighted.count() // QUERY_BLOCK))))
    queries = weighted.groupBy(blocks.alias("block")).agg(F.collect_list(F.struct("query_id", "w")).alias("q"))
    q_kind = dict(terms.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded: dict[int, _Asked] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch[c][r] for c in batch.schema.names}
                number = x["block"].as_py()
                if number not in decoded:
                    if len(decoded) >= DECODED:
                        decoded.clear()
                    decoded[number] = _Asked(x["q"].as_py())
                asked = decoded[number]
                ids, keep_ = x["ids"].values, np.asarray(x["keep"].values.to_numpy(zero_copy_only=False), bool)
                lens, ends, doc, tf = (np.asarray(x[c].values) for c in ("lens", "ends", "docs", "tfs"))
                starts = np.r_[0, ends[:-1]]
                found = pa.compute.index_in(pa.array(asked.words, pa.string()), value_set=x["terms"].values)
                at = found.fill_null(-1).to_numpy(zero_copy_only=False)
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[doc] / avgdl))
                out_q, out_d, out_s = [], [], []
                for first, scores_ in asked.scores(at, starts, ends, doc, gain, len(lens)):
                    v = np.round(np.where(keep_, scores_, 0.0), 9)
                    for q in np.flatnonzero(v.any(1)):
                        hits = np.flatnonzero(v[q])
                        if len(hits) > k:
                            w = v[q, hits]
                            floor = np.partition(w, -k)[-k]
                            better, ties = hits[w > floor], hits[w == floor]
                            if len(better) + len(ties) > k:  # of equal scores the least ids
                                names = ids.take(pa.array(ties)).to_pylist()
                                ties = ties[sorted(range(len(ties)), key=names.__getitem__)[: k - len(better)]]
                            hits = np.r_[better, ties]
                        out_q.extend([asked.ids[first + q]] * len(hits))
                        out_d.append(hits)
                        out_s.append(scores_[q, hits])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, batch_kind), ids.take(pa.array(np.concatenate(out_d))), pa.array(np.concatenate(out_s))], names=["query_id", "doc_id", "score"])

    batch_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[q_kind]
    pairs = index.repartition(partitions_of(terms.sparkSession)).crossJoin(queries.select("block", "q"))  # of blocks: a stated query set against all rows
    # a pair of blocks is some MB; few at a time keep a worker's memory small
    found = pairs.mapInArrow(run, f"query_id {q_kind}, doc_id string, score double")
    return top(found, k)


#: A block of score_index() ends with the record that reaches as many records or tokens; queries to a block that is scored against it.
SUM_DOCS, SUM_TOKENS, SUM_QUERIES = 32768, 1 << 21, 16384
#: Bytes of a block's postings that are laid out by record, and sums that are kept for the next query.
ROW_BYTES, SHARED = 64 << 20, 16
_SUMS = "number bigint, records bigint, tokens bigint, lens array<int>, doc array<int>, terms array<string>, ends array<int>, docs array<int>, tfs array<int>"


def _list(x: np.ndarray | pa.Array, kind: pa.DataType | None = None) -> pa.ListArray:
    """One row that holds all of x."""
    x = x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if kind is None else x.cast(kind))


def score_index(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str | None = None) -> DataFrame:
    """The postings of blocks of records, all records of an id in one block. Written once.

    Rows of one id, length and part count as one record, as postings() has it; lens and doc give the length of each record
    and the number of its id in the block.
    """
    base = docs.select(F.col(key).cast("string").alias("id"), (F.lit(None) if part is None else F.col(part)).cast("string").alias("part"), F.col(text).alias("text"))
    base = base.repartition(partitions_of(docs.sparkSession), "id").sortWithinPartitions("id")  # texts travel, not their tokens
    base = base.select("id", "part", F.coalesce(C.tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))

    def block(b: pa.Table, number: int) -> pa.RecordBatch:
        codes = [pa.compute.dictionary_encode(b[c].combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64) for c in ("id", "part")]
        t = b["t"].combine_chunks()
        n = pa.compute.list_value_length(t).to_numpy().astype(np.int64)
        doc, lens, of = codes[0], n, np.arange(len(n))
        if doc[-1] + 1 < len(doc):  # some id has several rows
            record, of = np.unique(np.stack([*codes, n]), axis=1, return_inverse=True)
            doc, lens, of = record[0], record[2], of.reshape(-1)
        words = t.flatten().dictionary_encode()
        pair = np.multiply(words.indices.to_numpy(), len(lens), dtype=np.int64)
        pair += np.repeat(of.astype(np.int32), n)
        pair.sort()  # in place: the tokens of a block are most of a worker's memory
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        tf, pair = np.diff(np.r_[first, len(pair)]), pair[first]
        ends = np.searchsorted(pair, np.arange(1, len(words.dictionary) + 1) * len(lens))
        head = [pa.array([x], pa.int64()) for x in (number, len(n), n.sum())]
        return pa.RecordBatch.from_arrays([*head, _list(lens), _list(doc), _list(words.dictionary, pa.string()), _list(ends), _list(pair % len(lens)), _list(tf)], names=[f.split()[0] for f in _SUMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, tokens, number = [], 0, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                held.append(b.slice(a, 1024))
                rows, tokens = rows + held[-1].num_rows, tokens + len(held[-1]["t"].flatten())
                if rows >= SUM_DOCS or tokens >= SUM_TOKENS:
                    whole = pa.Table.from_batches(held)
                    last, cut = whole["id"][rows - 1], rows - 1
                    while cut and whole["id"][cut - 1].as_py() == last.as_py():  # the last id may go on
                        cut -= 1
                    if cut:
                        yield block(whole.slice(0, cut), number)
                        held, number = whole.slice(cut).combine_chunks().to_batches(), number + 1
                        rows, tokens = rows - cut, sum(len(x["t"].flatten()) for x in held)
        if rows:
            yield block(pa.Table.from_batches(held), number)

    return materialize(base.mapInArrow(run, _SUMS), "bm25-records")


class _Block:
    """A block of score_index(), decoded once for all queries that meet it: by term its ids, their gains and the sum of these."""

    def __init__(self, x: dict, k1: float, b: float, avgdl: float):
        lens, of, ends, doc, tf = (np.asarray(x[c].values) for c in ("lens", "doc", "ends", "docs", "tfs"))
        self.docs, self.words, self.ends = int(of[-1]) + 1, x["terms"].values, ends.astype(np.int64)
        self.starts = np.r_[0, self.ends][: len(ends)]
        norm = k1 * (1 - b + b * lens / avgdl)
        self.gain = tf * (k1 + 1) / (tf + norm[doc])
        self.key = np.repeat(np.arange(len(ends)) * self.docs, self.ends - self.starts)
        self.key += of[doc]
        if self.docs < len(of):  # the records of an id are added up
            self.key, at = np.unique(self.key, return_inverse=True)
            self.gain = np.bincount(at, self.gain)
            self.starts, self.ends = (np.searchsorted(self.key, (np.arange(len(ends)) + i) * self.docs) for i in (0, 1))
        self.sums = np.add.reduceat(self.gain, self.starts) if len(ends) else self.gain  # no term is without records
        self.rows: dict[int, np.ndarray] = {}

    def few(self, t: int, idf: float) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a term and their scores in single precision."""
        a, b = self.starts[t], self.ends[t]
        return self.key[a:b] - t * self.docs, (self.gain[a:b] * idf).astype(np.float32)

    def row(self, t: int, idf: float) -> np.ndarray | None:
        """The same laid out by id, for terms of many ids, as far as ROW_BYTES go."""
        if t not in self.rows and self.ends[t] - self.starts[t] > self.docs // 64 and 4 * self.docs * len(self.rows) < ROW_BYTES:
            d, x = self.few(t, idf)
            self.rows[t] = np.zeros(self.docs, np.float32)
            self.rows[t][d] = x
        return self.rows.get(t)


class _Sets:
    """A block of term sets: their numbers, and in one order of terms, those of most records first, which terms each has."""

    def __init__(self, q: pa.StructArray):
        numbers, w = q.field("set").to_numpy(), q.field("w")
        flat, n = w.flatten(), pa.compute.list_value_length(w).to_numpy()
        code = flat.field("term").dictionary_encode()
        idf = np.zeros(len(code.dictionary))
        idf[code.indices.to_numpy()] = flat.field("idf").to_numpy()
        order = np.argsort(idf, kind="stable")
        self.words, self.idf = code.dictionary.take(pa.array(order)), idf[order]
        place = np.argsort(order)[code.indices.to_numpy()]
        place = place[np.lexsort((place, np.repeat(np.arange(len(n)), n)))].tolist()
        ends = np.cumsum(n).tolist()
        lists = sorted((place[e - m : e], i) for e, m, i in zip(ends, n.tolist(), numbers.tolist()))
        self.numbers, self.lists = np.array([i for _, i in lists], np.int64), [x for x, _ in lists]
        self.size = np.array([len(x) for x in self.lists])
        self.flat = np.array([t for x in self.lists for t in x], np.int64)

    def totals(self, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, ids with a score, best, sum) of every set that has a score in the block.

        Sums of a term's scores are added up for all ids at once. Which ids have a score and which may have the best is
        read from sums in single precision; whatever its error leaves open is added up in double precision.
        """
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        if not len(block.words):
            return none
        docs = block.docs
        at = pa.compute.index_in(self.words, value_set=block.words).fill_null(-1).to_numpy(zero_copy_only=False)
        total = np.where(at >= 0, block.sums[at] * self.idf, 0.0)
        rows: list[np.ndarray | None] = [None] * len(at)
        few: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(at)
        for t in np.flatnonzero(at >= 0).tolist():  # those of most records first
            rows[t] = block.row(int(at[t]), self.idf[t])
            if rows[t] is None:
                few[t] = block.few(int(at[t]), self.idf[t])
        sums = [np.zeros(docs, np.float32)]  # of the first terms: many sets begin as the one before
        work, near = np.empty(docs, np.float32), np.empty(docs, bool)
        before: list[int] = []
        count, sets, found = np.zeros(len(self.lists), np.int64), [], []
        for i, terms in enumerate(self.lists):
            here = [t for t in terms if rows[t] is not None]
            first, same = here[:SHARED], 0
            while same < len(first) and same < len(before) and first[same] == before[same]:
                same += 1
            for j in range(same, len(first)):
                if j + 1 == len(sums):
                    sums.append(np.empty(docs, np.float32))
                np.add(sums[j], rows[first[j]], out=sums[j + 1])
            before, s = first, sums[len(first)]
            rest = [few[t] for t in terms if few[t] is not None]
            if rest or len(here) > SHARED:
                np.copyto(work, s)
                s = work
                for t in here[SHARED:]:
                    np.add(s, rows[t], out=s)
                for d, x in rest:
                    s[d] += x
            count[i] = np.count_nonzero(s.view(np.int32))
            if count[i]:
                top = s.argmax()
                np.greater_equal(s, s[top] * np.float32(1 - (len(terms) + 2) * 2.0**-22), out=near)
                found.append([top] if np.count_nonzero(near) == 1 else np.flatnonzero(near))
                sets.append(i)
        if not sets:
            return none
        sets = np.array(sets)
        many_of = np.array([len(x) for x in found])
        pair_set, pair_doc = np.repeat(sets, many_of), np.concatenate(found)
        m, first = self.size[pair_set], np.cumsum(self.size) - self.size
        pair = np.repeat(np.arange(len(m)), m)
        term = self.flat[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[pair_set], m)]
        want = at[term] * docs + pair_doc[pair]
        place = np.minimum(np.searchsorted(block.key, want), len(block.key) - 1)
        exact = np.bincount(pair, np.where(block.key[place] == want, block.gain[place] * self.idf[term], 0.0), len(m))
        best = np.maximum.reduceat(exact, np.cumsum(many_of) - many_of)
        return self.numbers[sets], count[sets], best, np.add.reduceat(total[self.flat], first)[sets]


def score_totals(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, part: str | None = None) -> DataFrame:
    """(query_id, n, best, total): how many ids each query scores, their best score and the sum of all; as scores() gives them.

    Blocks of records meet blocks of queries, and a pair of blocks passes on one row a query: the scored pairs, which
    grow with the square of the tables, are never rows. Queries of the same terms are scored once. part: a column by
    which records of one id and length stay apart.
    """
    index = score_index(docs, key, text, part)
    stats = index.agg(F.sum("records").alias("n"), F.sum("tokens").alias("total")).first()
    n, avgdl = stats["n"] or 0, (stats["total"] / stats["n"] if stats["total"] else 1.0)
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(_counts(index, terms), "term").groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("term", idf.alias("idf")))).alias("w"))
    sets = asked.groupBy("w").agg(F.collect_list(F.struct("query_id")).alias("ids")).withColumn("set", F.monotonically_increasing_id())
    sets = materialize(sets, "bm25-sets")
    blocks = F.pmod(F.xxhash64("set"), F.lit(max(1, -(-sets.count() // SUM_QUERIES))))
    queries = materialize(sets.groupBy(blocks.alias("block")).agg(F.collect_list(F.struct("set", "w")).alias("q")), "bm25-set-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded: dict[int, _Sets] = {}
        number, block = -1, None
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch[c][r] for c in batch.schema.names}
                if x["number"].as_py() != number:
                    number, block = x["number"].as_py(), _Block(x, k1, b, avgdl)
                if x["block"].as_py() not in decoded:
                    if len(decoded) >= DECODED:
                        decoded.clear()
                    decoded[x["block"].as_py()] = _Sets(x["q"].values)
                found = decoded[x["block"].as_py()].totals(block)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in found], names=["set", "n", "best", "total"])

    pairs = index.drop("records", "tokens").crossJoin(queries.hint("shuffle_replicate_nl"))  # of blocks; neither side is broadcast, both grow
    found = pairs.mapInArrow(run, "set bigint, n bigint, best double, total double")
    found = found.groupBy("set").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.sum("total").alias("total"))
    return found.join(sets.select("set", F.inline("ids")), "set").select("query_id", "n", "best", "total")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> str:
    """Records and a sum of their hashes, whatever their order: equal for an index of the same texts."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, text).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['h'] or 0}"


def open_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """The saved index of docs at path, built and saved anew only if there is none or it was built from other texts."""
    spark, name = docs.sparkSession, fingerprint(docs, key, text)
    try:
        tables = writers.load_index(spark, path, f"bm25-{name}")
    except (ValueError, AnalysisException):
        writers.save_index({"blocks": block_index(docs, key, text, keep)}, path, f"bm25-{name}")
        tables = writers.load_index(spark, path, f"bm25-{name}")
    return tables["blocks"]
