"""What stands around a search: models that the caller brings, their replies, mapped results, samples, and formal hits."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import columns as C


@runtime_checkable
class Embedder(Protocol):
    """Texts to vectors (M16, P18): df with a column of texts, the same df with one of vectors; a map, without a shuffle."""

    dims: int

    def embed(self, df: DataFrame, text: str, vector: str) -> DataFrame: ...


@runtime_checkable
class Reranker(Protocol):
    """(query_id, query, doc_id, text) to (query_id, doc_id, score); listwise ones may group by query_id."""

    def score(self, pairs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Retriever(Protocol):
    """(query_id, query) to (query_id, doc_id, rank)."""

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class ManualRetriever:
    """Candidates that the caller supplies, in the order given (R15): (doc_id, pos), for all queries, or (query_id, doc_id, pos)."""

    def __init__(self, candidates: DataFrame):
        self.candidates = candidates

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        own = "query_id" in self.candidates.columns
        w = Window.orderBy("pos", "doc_id") if not own else Window.partitionBy("query_id").orderBy("pos", "doc_id")
        first = self.candidates.orderBy("pos", "doc_id").limit(k) if not own else self.candidates  # at most k rows reach the one window
        ranked = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        q = queries.select("query_id").distinct()
        return (ranked.join(q, "query_id", "left_semi") if own else ranked.crossJoin(q)).select("query_id", "doc_id", "rank")


def reranked(fused: DataFrame, pairs: DataFrame, reranker: Reranker | None, depth: int = 100) -> tuple[DataFrame, str | None]:
    """(query_id, doc_id, rank) with the first depth in the order of the reranker, and a notice if it could not be had.

    fused: (query_id, doc_id, rank); pairs: (query_id, query, doc_id, text). Ties keep the fused order; candidates that
    get no score, or NaN, follow those with one. Whatever the reranker raises while it is planned, the fused order is served.
    """
    order = fused.select("query_id", "doc_id", "rank")
    if reranker is None:
        return order, None
    try:
        scored = reranker.score(pairs.join(order.filter(F.col("rank") <= depth).select("query_id", "doc_id"), ["query_id", "doc_id"]))
        scored = scored.select("query_id", "doc_id", F.when(~F.isnan("score"), F.col("score")).alias("score"))
    except Exception as e:
        return order, f"reranker unavailable ({type(e).__name__}: {e}); the fused order is served"
    head = (F.col("rank") <= depth).cast("int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(head), F.when(head == 1, F.col("score")).desc_nulls_last(), "rank", "doc_id"))
    return order.join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", place.alias("rank")), None


def mapped(results: DataFrame, least: float = 0.5) -> DataFrame:
    """Results that apply with enough confidence, verified ones first, then by confidence (T7): adds place by query_id."""
    sure = results.filter(F.col("applies") & (F.col("confidence") >= least))
    order = [F.desc("verified"), F.desc("confidence"), F.asc("doc_id")]
    return sure.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


_VERDICT = "applies boolean, need_met_by_guarantee boolean, confidence double, failure string, conditions array<struct<text: string, satisfied: boolean, evidence: string>>"


def verdicts(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds the verdict that a model's reply holds (V6): applies, confidence, failure, conditions, unmet, note.

    It applies only if it says so and the need is met (if that is not said, it is). A reply without a readable object
    is a rejection with confidence 0.
    """
    v = F.from_json(F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)(\{.*\})", 1), _VERDICT)
    read = F.coalesce(v["applies"].isNotNull() | v["confidence"].isNotNull() | v["conditions"].isNotNull(), F.lit(False))
    applies = F.coalesce(v["applies"], F.lit(False)) & F.coalesce(v["need_met_by_guarantee"], F.lit(True))
    return replies.withColumns(
        {
            "applies": applies,
            "confidence": F.when(read, F.coalesce(v["confidence"], F.lit(0.0))).otherwise(0.0),
            "failure": F.when(~applies, C.filled(v["failure"])),
            "conditions": F.coalesce(v["conditions"], F.array().cast("array<struct<text: string, satisfied: boolean, evidence: string>>")),
            "unmet": F.coalesce(F.size(F.filter(v["conditions"], lambda c: ~F.coalesce(c["satisfied"], F.lit(True)))), F.lit(0)),
            "note": F.when(read, "precondition check").otherwise("reply not readable, so rejected"),
        }
    )


def worst(parsed: DataFrame, key: str) -> DataFrame:
    """Of several passes the one that counts (G16): a rejection with the least confidence, else the surest acceptance."""
    order = [F.asc("applies"), F.when(~F.col("applies"), F.col("confidence")).asc_nulls_last(), F.desc("confidence")]
    return parsed.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def solved(results: DataFrame, replies: DataFrame, least: float = 0.5) -> DataFrame:
    """Mapped results with the worst of their verdicts, if they were checked; verified ones first (V8).

    results: (query_id, doc_id, applies, confidence); replies: (query_id, doc_id, reply), none or several of each.
    """
    checked = verdicts(replies).select("query_id", "doc_id", F.col("applies").alias("applies"), "confidence", "failure")
    checked = worst(checked.withColumn("_k", F.struct("query_id", "doc_id")), "_k").drop("_k").toDF("query_id", "doc_id", "verified", "sure", "failure")
    both = results.filter(F.col("applies") & (F.col("confidence") >= least)).join(checked, ["query_id", "doc_id"], "left")
    both = both.withColumns({"verified": F.coalesce("verified", F.lit(False)), "confidence": F.coalesce("sure", "confidence")}).drop("sure")
    return mapped(both, float("-inf"))


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows without replacement, the same ones in every engine: those with the least MD5 of their key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def repeated_prefixes(df: DataFrame, text: str = "statement", length: int = 120) -> DataFrame:
    """One row: records, and those whose first characters an earlier one has."""
    t = df.select(F.md5(F.substring(F.coalesce(F.col(text), F.lit("")), 1, length)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


# fixed values: where the formal library is documented
DOCS_URL = "https://leanprover-community.github.io/mathlib4_docs/"
HIT = "name string, type string, module string, doc string, kind string, url string, source string, provenance string"
_LOOGLE = "count bigint, error string, hits array<struct<name: string, type: string, module: string, doc: string>>"
_LEAN = "array<array<struct<result: struct<name: array<string>, module_name: array<string>, type: string, kind: string, docstring: string>, distance: double>>>"


def declaration_url(module: Column, name: Column) -> Column:
    """The page of a declaration; null if either is missing."""
    return F.when((module != "") & (name != ""), F.concat(F.lit(DOCS_URL), F.replace(module, F.lit("."), F.lit("/")), F.lit(".html#"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))))


def _hit(service: str, x: Column, name: Column, module: Column, doc: str, kind: Column) -> Column:
    url = declaration_url(module, name)
    return F.struct(
        C.filled(name).alias("name"), x["type"].alias("type"), C.filled(module).alias("module"), x[doc].alias("doc"), kind.alias("kind"), url.alias("url"), F.lit(service).alias("source"), F.lit(f"external:{service}").alias("provenance")
    )


def formal_hits(payloads: DataFrame, k: int = 10) -> DataFrame:
    """Payloads of external formal search, (query, service, payload), to (query, service, available, error, hits).

    A payload that is null or no object of the service is an unavailable service without hits, never an error of the job.
    """
    p = F.col("payload")
    pattern = F.from_json(p, _LOOGLE)
    loogle = F.transform(F.slice(pattern["hits"], 1, k), lambda x: _hit("loogle", x, x["name"], x["module"], "doc", F.lit(None).cast("string")))
    natural = F.try_element_at(F.from_json(p, _LEAN), F.lit(1))

    def lean(row: Column) -> Column:
        r = row["result"]
        return _hit("leansearch", r, F.array_join(r["name"], "."), F.array_join(r["module_name"], "."), "docstring", r["kind"])

    none = F.array().cast(f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in HIT.split(', ')) }>>")
    of_loogle = F.col("service") == "loogle"
    found = F.when(of_loogle, loogle).otherwise(F.transform(F.slice(natural, 1, k), lean))
    error = F.when(of_loogle, pattern["error"])
    available = F.coalesce(F.when(of_loogle, pattern["hits"].isNotNull() | pattern["error"].isNotNull()).otherwise(natural.isNotNull()), F.lit(False))
    return payloads.select("query", "service", available.alias("available"), F.when(available, error).otherwise("unavailable").alias("error"), F.coalesce(F.when(available, found), none).alias("hits"))


def formal_merged(hits: DataFrame, k: int = 10) -> DataFrame:
    """(query, place, hit fields): the services taken in turn, a name once, hits without a name all kept."""
    t = hits.select("query", "service", F.posexplode("hits").alias("pos", "h"))
    t = t.withColumn("turn", F.when(F.col("service") == "loogle", 0).otherwise(1))
    same = Window.partitionBy("query", F.coalesce("h.name", F.concat(F.lit("\u0001"), "service", F.col("pos").cast("string")))).orderBy("pos", "turn")
    t = t.withColumn("n", F.row_number().over(same)).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("query").orderBy("pos", "turn"))
    return t.withColumn("place", place).filter(F.col("place") <= k).select("query", "place", "h.*")


TIERS = ("large", "small")


def resolve_index(tier: str = "large", quantised: bool = False, statement: bool = False, exists: Callable[[str], bool] = lambda name: True) -> dict[str, str]:
    """Names of the indexes that a configuration reads, or an error that says which is missing or does not fit."""
    tier = (tier or "large").strip().lower()
    if tier not in TIERS:
        raise ValueError(f"the encoder tier must be one of {', '.join(TIERS)}, got {tier!r}")
    if statement and quantised:
        raise ValueError("a statement index is searched by its vectors: it does not go with a quantised index")
    names = {"slogan": "index" if tier == "large" else "index-small"}
    if quantised:
        names["slogan"] += "-quantised"
    if statement:
        names["statement"] = names["slogan"] + "-statement"
    for name in names.values():
        if not exists(name):
            raise FileNotFoundError(f"the {tier} tier needs the index {name!r}, which was never built")
    return names
