"""Dense retrieval: exact, int8 and one-bit search of vectors, and a hashing embedder.

Searches run on blocks: both sides are packed into rows that hold a few thousand vectors each, every
pair of blocks is one matrix product, and only the best k of a block travel on. No side is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import columns as C
from lemmata.plans.runtime import partitions_of

BLOCK = 4096


def as_words(m: np.ndarray) -> np.ndarray:
    """Signs of vectors as words of 64 bits; what the last word lacks is filled with zeros on both sides of a search."""
    bits = np.packbits(m > 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


#: How a block holds its vectors: as floats, as codes of one byte, or as one bit a dimension.
FORMS = {"float": (np.float32, lambda m: m.astype(np.float32)), "int8": (np.int8, lambda m: m.astype(np.int8)), "bits": (np.uint64, as_words)}


def pack(df: DataFrame, key: str, vector: str, block: int = BLOCK, form: str = "float") -> DataFrame:
    """(ids, m, d): blocks of up to BLOCK vectors as matrices of the form; rows without a vector are left out."""
    kind = "array<tinyint>" if form == "int8" else "array<float>"
    base = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("v"))
    shaped = FORMS[form][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, d, held = [], [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            m = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            d = m.shape[1]
            ids.append(b["id"].to_numpy())
            rows.append(shaped(m))
            held += b.num_rows
            if held >= block:
                yield from out(np.concatenate(ids), np.concatenate(rows), d)
                ids, rows, held = [], [], 0
        if ids:
            yield from out(np.concatenate(ids), np.concatenate(rows), d)

    def out(ids: np.ndarray, m: np.ndarray, d: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(ids), block):
            yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + block].tobytes()]), pa.array([m[a : a + block].tobytes()]), pa.array([d], pa.int32())], names=["ids", "m", "d"])

    return base.mapInArrow(run, "ids binary, m binary, d int")


def _products(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    return np.round(x @ y.T, digits)


def _agreements(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """The negative numbers of differing signs, word by word."""
    differ = np.zeros((len(x), len(y)), np.int16)
    for w in range(x.shape[1]):
        differ += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return -differ


def block_search(queries: DataFrame, docs: DataFrame, k: int, form: str = "float", digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score) of the best k documents of every query and block, both sides as pack() gives them.

    form: how the documents are packed. Queries are floats, or bits where the documents are; the score is the product,
    of bits the negative number of differing signs. Products are computed in double and rounded to digits; of equal
    scores those with the least ids stay, so that copies never make more than k rows.
    """
    q = queries.select(F.col("ids").alias("qi"), F.col("m").alias("qm"), F.col("d").alias("qd"))
    docs = docs.repartition(partitions_of(docs.sparkSession))
    bits, kind = form == "bits", FORMS[form][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qi, di = np.frombuffer(r["qi"], np.int64), np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["qm"], np.uint64 if bits else np.float32).reshape(len(qi), -1)
                y = np.frombuffer(r["m"], kind).reshape(len(di), -1)
                if not bits:
                    x, y = x.astype(np.float64), y.astype(np.float64)
                for a in range(0, len(qi), 512):
                    s = (_agreements if bits else _products)(x[a : a + 512], y, digits)
                    if len(di) > k:
                        floor = np.partition(s, -k, axis=1)[:, -k]
                        i, j = np.nonzero(s >= floor[:, None])
                        order = np.lexsort((di[j], -s[i, j], i))
                        i, j = i[order], j[order]
                        place = np.arange(len(i)) - np.searchsorted(i, i)
                        i, j = i[place < k], j[place < k]
                    else:
                        i, j = (z.reshape(-1) for z in np.indices(s.shape))
                    yield pa.RecordBatch.from_arrays([pa.array(qi[a + i]), pa.array(di[j]), pa.array(s[i, j].astype(float))], names=["query_id", "doc_id", "score"])

    pairs = docs.crossJoin(q)  # of blocks: a stated query set against all rows
    found = pairs.select("qi", "qm", "qd", "ids", "m", "d").mapInArrow(run, "query_id bigint, doc_id bigint, score double")
    return found


def top(scored: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", r).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def scales(df: DataFrame, vector: str) -> DataFrame:
    """(dim, scale): the largest size of each dimension over 127; 1 for a dimension of zeros.

    A task reduces its rows to one vector of maxima, so as many rows as tasks and dimensions are shuffled.
    """

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = None
        for b in batches:
            if b.num_rows:
                m = np.abs(b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)).max(0)
                most = m if most is None else np.maximum(most, m)
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most), dtype=np.int32)), pa.array(most.astype(float))], names=["dim", "x"])

    t = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(vector).cast("array<double>").alias("v"))
    t = t.mapInArrow(largest, "dim int, x double").groupBy("dim").agg(F.max("x").alias("m"))
    return t.select("dim", F.when(F.col("m") > 0, F.col("m") / 127).otherwise(1.0).alias("scale"))


def scale_row(df: DataFrame, vector: str) -> list[float]:
    """The scales in order of dimension: as many numbers as a vector has, whatever the rows."""
    return [r["scale"] for r in scales(df, vector).orderBy("dim").collect()]


def quantised(v: Column, scale: list[float]) -> Column:
    """Codes from -127 to 127, rounded half to even."""
    s = F.array(*[F.lit(x) for x in scale])
    return F.zip_with(v, s, lambda x, y: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / y))).cast("tinyint"))


def sign_words(v: Column, dims: int = 64) -> Column:
    """Signs as words of 32 bits, the first dimension first."""
    return F.array(
        *[
            F.aggregate(F.transform(F.slice(v, 32 * w + 1, 32), lambda x: F.when(x > 0, 1).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 2 + x)
            for w in range(-(-dims // 32))
        ]
    )


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector of signed token counts: a token's bucket and sign come from its MD5.

    An Arrow UDF: as nested lambdas the sums would be made anew for every dimension. A null text gives null.
    """

    @F.pandas_udf("array<double>")
    def embed(tokens: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}

        def place(w: str) -> tuple[int, float]:
            h = md5(w.encode()).hexdigest()
            known[w] = p = int(h[:8], 16) % dims, 1.0 if int(h[8], 16) % 2 == 0 else -1.0
            return p

        out = []
        for t in tokens:
            if t is None:
                out.append(None)
                continue
            v = np.zeros(dims)
            for w in t:
                b, sign = known.get(w) or place(w)
                v[b] += sign
            norm = np.sqrt((v * v).sum())
            out.append(v / norm if norm > 0 else v)
        return pd.Series(out)

    return embed(C.tokens(text))
