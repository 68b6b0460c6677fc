"""End-to-end evaluation of repositories: parse, index without comments, ask the comments, measure."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import constants as C
from sieveline.operators import dense, evaluate, lexical, rank
from sieveline.operators.numbering import numbered
from sieveline.plans.search import SearchIndex
from sieveline.sources.scratch import written


def query_ranks(index: SearchIndex, queries: DataFrame, methods=C.METHODS) -> DataFrame:
    """method, query_id, target, rank; all methods share the queries' tokens and vectors, and the scores of both sides."""
    return target_ranks(index, written(index.queries(queries.select("query_id", "text")), "asked"), queries.select("query_id", "target"), methods)


def target_ranks(index: SearchIndex, asked: DataFrame, targets: DataFrame, methods=C.METHODS, matched: DataFrame | None = None) -> DataFrame:
    """method, query_id, target, rank of the queries asked(query_id, tokens, embedding): counted, without a full ranking."""
    total = None
    if set(methods) - {"bm25"}:
        index = index.with_vectors()
    fused = index.shared_scores(asked, [m for m in methods if m not in ("bm25", "dense")], matched)
    for method in methods:
        if method == "bm25":
            own = lexical.target_ranks(index.tokens, asked, targets)
        elif method == "dense":
            own = dense.target_ranks(index.vectors, asked, targets)
        else:
            own = evaluate.target_ranks(fused[method], targets, rank.FUSED_DECIMALS)
        own = own.select(F.lit(method).alias("method"), "query_id", "target", "rank")
        total = own if total is None else total.unionByName(own)
    return total


def ablation_ranks(corpora: dict[str, DataFrame], embedders: dict[str, Callable], methods=C.METHODS[1:]) -> DataFrame:
    """model, repo, method, query_no, rank of the units of each repository under each model, with comments out of the index. The lexical side doesn't hang on the model: it is
    computed once for each repository."""
    total = None
    for repo, units in corpora.items():
        queries = written(evaluate.build_queries(units), "queries")
        matched = None
        for model, embedder in embedders.items():
            index = SearchIndex(units, include_comments=False, model_name=model, embedder=embedder)
            asked = written(index.queries(queries.select("query_id", "text")), "asked")
            if matched is None:
                matched = written(index.best(asked, "bm25", C.FUSION_DEPTH), "matched")
            own = target_ranks(index, asked, queries.select("query_id", "target"), methods, matched)
            own = own.select(F.lit(model).alias("model"), F.lit(repo).alias("repo"), "method", "query_id", "rank")
            total = own if total is None else total.unionByName(own)
    # Queries of a repository and method are numbered in their own order, the same for all models.
    return numbered(total, ["query_id"], ["model", "repo", "method"], "query_no").select("model", "repo", "method", "query_no", "rank")


def evaluate_repository(units: DataFrame, name: str, methods=C.METHODS, **options) -> tuple[list, dict]:
    """Metrics by method, and the corpus row."""
    began = time.time()
    index = SearchIndex(units, include_comments=False, **options)
    queries = evaluate.build_queries(units).persist()
    ranks = query_ranks(index, queries, methods)
    metrics = evaluate.metrics(ranks.withColumn("repo", F.lit(name)), "repo", "method").collect()
    return sorted(metrics, key=lambda r: methods.index(r["method"])), {"repo": name, "functions": units.count(), "queries": queries.count(), "seconds": time.time() - began}


def macro(metrics: list) -> list[dict]:
    out = []
    for method in dict.fromkeys(r["method"] for r in metrics):
        own = [r for r in metrics if r["method"] == method]
        out.append({"method": method} | {c: sum(r[c] for r in own) / len(own) for c in (*(f"recall_{k}" for k in C.RECALL_KS), "mrr")})
    return out
