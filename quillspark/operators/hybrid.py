"""Hybrid retrieval: fusion, merging over variants of a query, boosting and reranking.

Chunks are (id, content, section, embedding, ...) with their lexical index. A chunk without a vector competes by keywords
only. Similarities and BM25 are rounded to six digits, what is made of them to more, so that no rounding falls on a half;
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import has_any
from .ann import Tree, knn_all
from .lexical import Index, fuse, query_terms
from .vector import knn, top_per

RESULT = "id {id}, content string, section string, vector_score double, keyword_score double, score double, search_method string, fallback_reason string"


def merge(vectors: DataFrame, keywords: DataFrame, chunks: DataFrame, vector_weight: float = 0.7) -> DataFrame:
    """Full outer join of (id, vector_score) and (id, keyword_score), 0 for what is missing, with their chunks and fused score.

    A hit without a chunk is rebuilt from columns of the chunk's names in `vectors`, or dropped if these have no content.
    """
    both = vectors.join(keywords, "id", "full_outer")
    held = [c for c in chunks.columns if c != "id"]
    known = F.struct(*held) if held else F.struct(F.lit(True).alias("known"))
    joined = both.join(chunks.select("id", known.alias("chunk")), "id", "left")
    own = [c for c in held if c in vectors.columns]
    cols = [F.coalesce(F.col(f"chunk.{c}"), F.col(c)).alias(c) if c in own else F.col(f"chunk.{c}").alias(c) for c in held]
    found = F.col("chunk").isNotNull() | (F.col("content").isNotNull() if "content" in own else F.lit(False))
    scores = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vector_score", "keyword_score")]
    out = joined.where(found).select("id", *scores, *cols)
    return out.withColumn("score", F.round(fuse(F.col("keyword_score"), F.col("vector_score"), 1 - vector_weight), 8))


def multiquery(chunks: DataFrame, index: Index, variants: list[tuple[str, list[float]]], k: int = 10, vector_weight: float = 0.7, where: Column | None = None, tree: Tree | None = None, probes: int = 40, keep: int = 200) -> DataFrame:
    """(id, content, section, vector_score, keyword_score, score) of the k best over all variants of a query.

    Each variant (text, vector) takes its 2k best by vector, filtered, and its 2k best by BM25, unfiltered, and fuses
    them; a chunk keeps its best score, of the first variant if tied. All variants share one pass over the vectors, and
    the index's postings of their terms; texts join the few winners at the end. With a tree of the chunks' vectors, and no
    filter, the nearest are looked for in the tree's `probes` nearest lists, of which `keep` vectors a variant are read: a
    chunk may then be missed, and no call reads all vectors.
    """
    near = chunks.where(where) if where is not None else chunks
    asked = chunks.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, (_, v) in enumerate(variants)], "query int, v array<double>")
    vec = (knn_all(near, asked, 2 * k, "id") if tree is None or where is not None else tree.search(asked, 2 * k, probes, max(keep, 2 * k))).select(F.col("query").alias("variant"), "id", F.col("score").alias("vec"))
    kw = index.topk_each({str(i): query_terms(t) for i, (t, _) in enumerate(variants)}, 2 * k).select(F.col("query").cast("int").alias("variant"), "id", F.col("score").alias("kw"))
    both = vec.join(kw, ["variant", "id"], "full_outer").select("id", "variant", F.coalesce("vec", F.lit(0.0)).alias("vector_score"), F.coalesce("kw", F.lit(0.0)).alias("keyword_score"))
    both = both.withColumn("score", F.round(fuse(F.col("keyword_score"), F.col("vector_score"), 1 - vector_weight), 8))
    best = top_per(both, ["id"], [F.desc("score"), F.col("variant")], 1).orderBy(F.desc("score"), "id").limit(k).drop("variant")
    return F.broadcast(best).join(chunks.select("id", "content", "section"), "id").select("id", "content", "section", "vector_score", "keyword_score", "score")


def boost(results: DataFrame, query: str, boosts: list[tuple[list[str], list[str], list[str]]] = vocab.BOOSTS) -> DataFrame:
    """results with boosted scores, not ordered anew: 1.5 if the text has all words, 1.3 if the section has any, for each kind of query."""
    text, section, score = F.lower("content"), F.lower(F.coalesce("section", F.lit(""))), F.col("score")
    for words, needed, sections in boosts:
        if any(w in query.lower() for w in words):
            score = score * F.when(reduce(lambda a, b: a & b, [text.contains(w) for w in needed]), 1.5).otherwise(1.0)
            score = score * F.when(has_any(section, sections), 1.3).otherwise(1.0)
    return results.withColumn("score", F.round(score, 10))


def _present(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words], F.lit(0))


def reranked(query: str, lists: list[tuple[list[str], list[str], float]] = vocab.RERANK) -> Column:
    """The score of (content, section, score), boosted by terms of query, text and section."""
    q, text, section = query.lower(), F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("section", F.lit("")))
    score, hit = F.col("score"), []
    for terms, sections, factor in lists:
        hit.append(any(t in q for t in terms))
        if hit[-1]:
            score = score * F.when(has_any(section, sections), factor).otherwise(1.0) * F.pow(F.lit(1.1), _present(text, terms))
    if "risk" in q or "factor" in q:
        score = score * F.when(section.contains("risk"), 1.5).otherwise(1.0)
    if any(hit[:2]):
        score = score * F.when(text.contains("table"), 1.3).otherwise(1.0)
    short = (F.length("content") > 0) & (F.length("content") < 100)
    return F.round(score * F.when(short, 0.3).otherwise(1.0), 10)


def rerank(results: DataFrame, query: str, k: int = 5, lists: list[tuple[list[str], list[str], float]] = vocab.RERANK, least: float = 0.5) -> DataFrame:
    """The k best of (id, content, section, score) above `least`, by their boosted scores."""
    return results.where(F.col("score") > least).withColumn("score", reranked(query, lists)).orderBy(F.desc("score"), "id").limit(k)


def keyword_rule(query: str) -> Column:
    """Mean over the query's words of more than two characters: 1 in the text, 1.5 in the section, 0.5 for a stem in the text."""
    words = [w for w in query.lower().split() if len(w) > 2]
    text, section = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("section", F.lit("")))
    total = F.lit(0.0)
    for w in words:
        total = total + F.when(text.contains(w), 1.0).otherwise(0.0) + F.when(section.contains(w), 1.5).otherwise(0.0)
        if len(w) > 4:
            total = total + F.when(text.contains(w[:-1]), 0.5).otherwise(0.0)
    return total / max(1, len(words))


def hybrid_rule(results: DataFrame, query: str, k: int = 5, keyword_weight: float = 0.3, least: float = 0.3) -> DataFrame:
    """The k best of (id, content, section, score) by vector score blended with keyword_rule()."""
    blended = results.withColumn("keyword_score", F.round(keyword_rule(query), 6)).withColumn("semantic_score", F.col("score"))
    blended = blended.withColumn("score", F.round(F.col("semantic_score") * (1 - keyword_weight) + F.col("keyword_score") * keyword_weight, 8))
    return blended.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k)


def near(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, content, section, score) of the k chunks most similar to a vector; texts join the winners."""
    best = knn(chunks.where(F.col("embedding").isNotNull()), query, k, "id")
    return F.broadcast(best).join(chunks.select("id", "content", "section"), "id").select("id", "content", "section", "score")


def first_that_runs(steps: list[tuple[str, str | None, Callable[[], DataFrame]]], chunks: DataFrame) -> DataFrame:
    """The rows of the first of (method, reason, plan) that runs, few as they are, tagged with method and reason.

    A plan is lazy, so it is run here: only then does a missing file or a broken index show.
    """
    schema = RESULT.format(id=chunks.schema["id"].dataType.simpleString())
    for i, (method, reason, plan) in enumerate(steps):
        try:
            rows = plan().withColumn("search_method", F.lit(method)).withColumn("fallback_reason", F.lit(reason).cast("string"))
            names = [part.split()[0] for part in schema.split(", ")]
            return chunks.sparkSession.createDataFrame(rows.select(names).collect(), schema).coalesce(1)
        except Exception:  # noqa: BLE001  any failure but the last step's
            if i == len(steps) - 1:
                raise
    raise ValueError("no step")


def enhanced(chunks: DataFrame, index: Index | None, variants: list[tuple[str, list[float]]], k: int = 10, vector_weight: float = 0.7, tree: Tree | None = None) -> DataFrame:
    """multiquery(), boosted; if that fails when run, reranked similarity; if that fails too, plain similarity. At most k rows come to the driver."""
    query, vector = variants[0]
    alone = lambda df: df.withColumn("vector_score", F.col("score")).withColumn("keyword_score", F.lit(0.0))
    return first_that_runs(
        [
            ("hybrid", None, lambda: boost(multiquery(chunks, index, variants, k, vector_weight, tree=tree), query)),
            ("vector_fallback", "hybrid_search_unavailable", lambda: alone(rerank(near(chunks, vector, k), query, min(k, 5)))),
            ("basic_vector_fallback", "all_enhanced_methods_failed", lambda: alone(near(chunks, vector, k))),
        ],
        chunks,
    )
