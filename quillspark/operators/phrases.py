"""Matching a dictionary of phrases: one automaton over many phrases reads each text once, whatever their number.

The automaton is a trie whose nodes also know, for what has been read, the longest suffix that is itself a beginning of a
phrase; so no character is read twice. Phrases are dealt by a hash to dictionaries of about DICTIONARY phrases; with
several, each text meets each dictionary in a task of its own, so a dictionary's size is bounded for any number of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of a dictionary.
DICTIONARY = 100_000


def automaton(phrases: list[tuple[int, str]]):
    """Finds, in a text, the numbers of the phrases in it."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for number, phrase in phrases:
        out.add_word(phrase, (*out.get(phrase, ()), number))
    out.make_automaton()
    return out


def found(texts: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: bool = True) -> DataFrame:
    """(id, phrase): which of (phrase number `phrase`, `words`) each text contains as characters, each once.

    fold: regardless of case. An empty or null phrase is in no text; a null text has none. Rows of one id are rows each.
    """
    lower = (lambda c: F.lower(c)) if fold else (lambda c: c)
    listed = phrases.select(F.col("phrase").cast("long").alias("phrase"), lower(F.col("words")).alias("words")).where("words <> ''").distinct()
    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col).alias("id"), lower(F.col(text_col).cast("string")).alias("text")).where("text IS NOT NULL")
    schema = f"id {kind}, phrase long"

    def hits(tree, ids: pa.Array, texts_: list[str]) -> pa.RecordBatch:
        at, numbers = [], []
        for i, t in enumerate(texts_):
            seen = sorted({n for _, ns in tree.iter(t) for n in ns})
            at += [i] * len(seen)
            numbers += seen
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64())], ["id", "phrase"])

    some = listed.limit(DICTIONARY + 1).collect()
    if len(some) <= DICTIONARY:
        given = [(r["phrase"], r["words"]) for r in some]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = automaton(given) if given else None
            for b in batches:
                if tree is not None and b.num_rows:
                    yield hits(tree, b.column("id"), b.column("text").to_pylist())

        return rows.mapInArrow(run, schema)
    parts = -(-listed.count() // DICTIONARY)
    # texts of a dictionary go to as many tasks as a shuffle has; the dictionary goes to each
    slices = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase", "words"), F.lit(parts))
    left = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("slice", F.pmod(F.xxhash64("text", "id"), F.lit(slices)).cast("int"))
    right = listed.withColumn("part", part.cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a.column("id").combine_chunks()
        if not a.num_rows or not b.num_rows:
            return pa.table([ids.slice(0, 0), pa.array([], pa.int64())], ["id", "phrase"])
        tree = automaton(list(zip(b.column("phrase").to_pylist(), b.column("words").to_pylist(), strict=True)))
        return pa.Table.from_batches([hits(tree, ids, a.column("text").to_pylist())])

    return left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(pair, schema)


def listed(texts: DataFrame, lists: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, list, present, any_, all_): of each list of words how many a text contains, and whether any or all; texts without a word of a list have no row for it."""
    spark = texts.sparkSession
    numbered = [(i, name, w) for i, (name, w) in enumerate((name, w) for name, words in lists.items() for w in dict.fromkeys(words))]
    known = spark.createDataFrame(numbered, "phrase long, list string, words string").coalesce(1)
    sizes = F.create_map(*(F.lit(x) for name, words in lists.items() for x in (name, len(dict.fromkeys(words))))) if lists else F.create_map()
    hit = found(texts, known, id_col, text_col).join(F.broadcast(known.select("phrase", "list")), "phrase")
    each = hit.groupBy("id", "list").agg(F.count("*").cast("int").alias("present"))
    held: Column = F.element_at(sizes, F.col("list"))
    return each.select("id", "list", "present", (F.col("present") > 0).alias("any_"), (F.col("present") >= held).alias("all_"))
