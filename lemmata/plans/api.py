"""The tool surface: each tool takes DataFrames (or values) and returns rows; knobs are checked before planning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import columns as C
from lemmata.functions import extract as X
from lemmata.operators import fuse, numeric, sequence, sparse
from lemmata.sources.readers import unavailable

MODES = ("hybrid", "dense", "sparse")
# fixed values: where a result comes from
PROVENANCE = ("known_form", "cited", "numeric_verified", "proved", "refuted", "undetermined", "conjectured", "web_added")


@dataclass(frozen=True)
class Config:
    """All switches in one place."""

    mode: str = "hybrid"
    k: int = 10
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    rrf_k: float = fuse.RRF_K

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; known: {', '.join(MODES)}")
        for s in (*self.include, *self.exclude):
            if s not in C.SOURCE_KEYS:
                raise ValueError(f"unknown source {s!r}; known: {', '.join(C.SOURCE_KEYS)}")
        if self.k < 1:
            raise ValueError("k must be positive")
        fuse.checked_weights(self.weights, C.SOURCE_KEYS)


def search_existing(queries: DataFrame, corpus: DataFrame, config: Config = Config(), dense: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, place, score, statement, source): the ranking of the batch (M3).

    dense: a ranking (query_id, doc_id, rank) of the dense channel, if there is one; it is numbered anew among the
    allowed records, so it should reach as deep as they lie. findings join by their own statistics. Filters apply
    before ranking; texts join after the limit.
    """
    key = C.source_key(F.col("doc_id"), F.col("source"))
    docs = corpus.withColumn("_k", key).withColumn("text", C.sparse_text(F.col("name"), F.col("slogan"), F.col("statement"), F.col("label")))
    keep = F.lit(True)
    if config.include:
        keep &= F.col("_k").isin(*config.include)
    if config.exclude:
        keep &= ~F.col("_k").isin(*config.exclude)
    terms = sparse.query_terms(queries)
    depth = max(config.k, 50)
    channels = {}
    if config.mode != "sparse" and dense is not None:
        allowed = docs.filter(keep).select("doc_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
        channels["dense"] = dense.join(allowed, "doc_id", "left_semi").select("query_id", "doc_id", place.alias("rank")).filter(F.col("rank") <= depth)
    if config.mode != "dense":
        channels["sparse"] = sparse.block_top(docs, terms, depth, keep=keep)
    if not channels:
        raise ValueError("the dense mode needs a dense ranking")
    fused = fuse.rrf(channels, config.rrf_k)
    meta = corpus.select("doc_id", "source", C.citation_count(F.col("citations").cast("string")).alias("_cited"))
    fused = fused.join(meta, "doc_id")
    fused = fuse.weighted(fused, C.source_key(F.col("doc_id"), F.col("source")), fuse.checked_weights(config.weights, C.SOURCE_KEYS))
    if config.prior:
        fused = fuse.with_prior(fused, F.col("_cited"), config.prior)
    best = fuse.ordered(fused, list(channels), config.k).select("query_id", "doc_id", "place", "score")
    out = best.join(corpus.select("doc_id", "statement", "source"), "doc_id").withColumn("provenance", F.lit("cited"))
    if findings is None:
        return out
    f = findings.withColumn("text", F.concat_ws(" ", C.filled(F.col("name")), C.filled(F.col("slogan")), C.filled(F.col("statement")), C.filled(F.col("source"))))
    live = sparse.block_top(f, terms, config.k)
    stmt = F.substring(F.lower(C.strip(F.col("statement"))), 1, 200).alias("stmt_key")
    a = out.select("query_id", "doc_id", F.col("place").alias("rank"), stmt)
    b = live.join(f.select("doc_id", stmt).groupBy("doc_id").agg(F.min("stmt_key").alias("stmt_key")), "doc_id")
    return fuse.live_merge({"corpus": a, "findings": b})


def identify_sequence(queries: DataFrame, sequences: DataFrame | None, max_results: int = 5) -> DataFrame | dict[str, str]:
    """Matches, or how to get the data (M2)."""
    return unavailable("the sequence dump") if sequences is None else sequence.match(queries, sequences, max_results)


def verify_numeric(claims: DataFrame, min_digits: int = 20) -> DataFrame:
    """(value, expr, verified, digits, reeval, error) of claims (value, expr) given as decimals and expressions (M5)."""
    return numeric.checked(claims, min_digits)


def verify_formal(statement: str, proof: str | None = None) -> dict[str, str]:
    """No kernel is here: the answer is undetermined, and a proof with holes is refused without one (M6)."""
    if proof is not None:
        import re

        bare = re.sub(r"--[^\n]*", "", re.sub(r"/-.*?-/", "", proof, flags=re.S))
        if re.search(r"\b(sorry|admit)\b", bare):
            return {"proof_status": "REFUTED", "checked": "false", "note": "the proof has a hole"}
    return {"proof_status": "UNDETERMINED", "checked": "false"} | unavailable("a proof kernel")


def applicability_checklist(df: DataFrame, key: str = "doc_id", text: str = "statement") -> DataFrame:
    """(key, kind, pos, item) (M7)."""
    return X.table_function(df, key, text, "kind string, pos int, item string", X.checklist)


QUESTIONS = ("need", "guarantee", "connection", "reduction", "preconditions", "verdict")


def mapping_scaffold(problems: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, need, givens, objects, preconditions, conclusion, questions) of given (query_id, problem) and (query_id, doc_id, statement) (M8)."""
    items = applicability_checklist(candidates, "doc_id", "statement")
    pre = items.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "precondition", F.struct("pos", "item")))).alias("p"),
        F.max(F.when(F.col("kind") == "conclusion", F.col("item"))).alias("conclusion"),
    )
    pre = pre.select("doc_id", F.transform("p", lambda x: x["item"]).alias("preconditions"), "conclusion")
    q = problems.select("query_id", X.need(F.col("problem")).alias("need"), X.givens(F.col("problem")).alias("givens"), X.objects(F.col("problem")).alias("objects"))
    return candidates.select("query_id", "doc_id").join(q, "query_id").join(pre, "doc_id").withColumn("questions", F.array(*[F.lit(x) for x in QUESTIONS]))


TOOLS: dict[str, Callable] = {
    "identify_constant": numeric.identify,
    "identify_sequence": identify_sequence,
    "search_existing": search_existing,
    "search_formal": lambda *a, **k: unavailable("a formal search service"),
    "verify_numeric": verify_numeric,
    "verify_formal": verify_formal,
    "applicability_checklist": applicability_checklist,
    "mapping_scaffold": mapping_scaffold,
    "conjecture_relation": numeric.conjecture,
    "program_elites": lambda events: __import__("lemmata.operators.etl", fromlist=["elites"]).elites(events),
    "search_directive": X.directives,
    "add_finding": lambda *a, **k: __import__("lemmata.streaming.live", fromlist=["land"]).land(*a, **k),
}
