"""Conversation memory over messages(conv_id, turn, role, text, ...).

A conversation may hold most of all messages, so nothing gathers one: the best of a conversation are the best of the best
of its slices, and neighbours are found by bins of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import cosine, spare

#: Slices that a conversation's messages are dealt to.
SLICES = 64


def best_each(rows: DataFrame, key: str, order: list[Column], k: int, deal: list[str]) -> DataFrame:
    """The first k rows of each key: of each slice of the key, then of what the slices send, k times SLICES at most.

    Rows are dealt to slices by a hash of the columns `deal`.
    """
    part, rank = spare(rows, "part"), spare(rows, "rank")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(*deal), F.lit(SLICES)))
    for keys in ([key, part], [key]):
        rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k).drop(rank)
    return rows.drop(part)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    return best_each(messages, "conv_id", [F.desc("turn")], n, ["turn", *(c for c in ("role", "text") if c in messages.columns)])


def semantic_recall(messages: DataFrame, query: list[float], k: int, around: int, vec_col: str = "embedding") -> DataFrame:
    """(conv_id, turn, role, text, hit): the k messages of each conversation most similar to a query's vector, with neighbours up to `around` turns away, each once.

    Messages without a vector are neighbours only. Hits go to the bins of turns that they reach into, and meet the
    messages of these; of the hits only their turns travel.
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.round(cosine(F.col(vec_col), query), 6).alias("score"))
    ranked = best_each(rows.where("score IS NOT NULL").select("conv_id", "turn", "score"), "conv_id", [F.desc("score"), F.asc("turn")], k, ["turn", "score"])
    width = 2 * around + 1
    bin_ = lambda turn: F.floor(turn / F.lit(width)).cast("long")
    reach = F.array_distinct(F.array(bin_(F.col("turn") - around), bin_(F.col("turn") + around)))
    hits = ranked.select("conv_id", F.col("turn").alias("at"), F.col("score").alias("best"), F.explode(reach).alias("bin"))
    # a message may have many hits around it, of which one is enough; a bin holds k at most
    hits = hits.groupBy("conv_id", "bin").agg(F.collect_set(F.struct("at", "best")).alias("hits"))
    near = rows.withColumn("bin", bin_(F.col("turn"))).join(hits, ["conv_id", "bin"]).where(F.exists("hits", lambda h: F.abs(h["at"] - F.col("turn")) <= around))
    own = F.exists("hits", lambda h: (h["at"] == F.col("turn")) & (h["best"] == F.col("score")))
    return near.select("conv_id", "turn", "role", "text", F.coalesce(own, F.lit(False)).cast("int").alias("hit"))
