"""Lexical index and BM25.

`Index` is a set of immutable segments in a folder. A segment holds compressed blocks of postings, sorted by term, with
the bounds of what each can add to a score, and its documents by stripe (see `postings`). `append` writes a new segment,
`delete` marks documents of old ones, `replace` does both, `merge` rewrites segments of one size as one; each writes a new
version of the list of segments and touches no file of older ones, so readers keep what they opened. Statistics follow:
documents, lengths and document frequencies are those of the living, so scores are those of an index built anew.

A query reads the blocks of its terms and no text. `topk` reads only blocks that can hold one of the k best: from the
blocks' bounds it knows for each small range of documents the most that any of them can score. It scores the ranges that
promise most, and then those that may still surpass the k-th score found.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import postings as P
from .postings import K1, B

#: Bytes of blocks of a file; bytes of a row group; documents, and postings, of a part when an index is built.
FILE_BYTES, GROUP_BYTES, PART_DOCS, PART_POSTINGS = 64 << 20, 4 << 20, 16_384, 1 << 22
#: Segments of one size that `merge` makes into one; a size is a power of it.
FAN = 4
#: Scores are rounded to six digits before they are ranked: what lies within this of the k-th may still be among the k.
SLACK = 2e-6
#: Rows that may be broadcast; postings of a query that one pass over all of them ranks sooner than two over some.
SMALL, ONE_PASS = 200_000, 20_000


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens"))


def term_freq(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf). Terms are counted where a row is read; only those of repeated ids are shuffled, and rows without an id."""
    ids = docs.select(F.col(id_col).alias("_id"))
    again = small(ids.groupBy("_id").count().where("count > 1 AND _id IS NOT NULL").select("_id"))
    known = docs.where(F.col(id_col).isNotNull())
    once = P.counts(known.join(again, F.col(id_col) == F.col("_id"), "left_anti"), id_col, text_col)
    rest = known.join(again, F.col(id_col) == F.col("_id"), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    return once.unionByName(P.counts(rest, id_col, text_col).groupBy("id", "term").agg(F.sum("tf").alias("tf")))


def doc_freq(postings: DataFrame) -> DataFrame:
    """(term, df) of (id, term, tf)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def doc_length(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl); a document without tokens has 0."""
    return tokens(docs, id_col, text_col).select("id", F.size("tokens").cast("long").alias("dl"))


def corpus_length(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def idf(n: Column, df: Column) -> Column:
    """Unfloored: negative for terms of more than half of the documents."""
    return F.log((n - df + 0.5) / (df + 0.5))


def term_idf(postings: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, idf); n_docs is one row with n_docs."""
    return doc_freq(postings).join(F.broadcast(n_docs.select("n_docs"))).select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def gain(tf: Column, n: Column, df: Column, dl: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n, df) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / mean))


def query_terms(text: str) -> list[str]:
    """Tokens of a query, as tokenize() makes them, on the driver."""
    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9_\s$%]", " ", text.lower(), flags=re.ASCII)) if len(t) > 2]


def small(df: DataFrame) -> DataFrame:
    """Broadcast if counting finds at most SMALL rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


class Index:
    """A BM25 index in a folder. Every row of a corpus is a document; those without a text have no length."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.version = self.versions(spark, path)[-1] if version is None else version
        self.segments = [r.asDict() for r in sorted(spark.read.parquet(f"{path}/versions/{self.version:010d}").collect(), key=lambda r: r["segment"])]
        alive = lambda a, b: sum(r[a] - r[b] for r in self.segments)
        self.n_docs, measured = alive("docs", "gone_docs"), alive("measured", "gone_measured")
        self.avg_dl = alive("length", "gone_length") / measured if measured else 0.0
        self._tables: dict[str, DataFrame] = {}
        #: Postings in the blocks that the last topk() unpacked, and those of its terms in all.
        self.last_read: tuple[int, int] | None = None

    # ------------------------------------------------------------ writing
    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """Complete versions, oldest first."""
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, "*/_SUCCESS"))
        return sorted(int(x.getPath().getParent().getName()) for x in found or ())

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """A new index of docs; where there is one at path, a new version of it without its segments."""
        made = cls._segment(docs.sparkSession, path, P.counted(docs, id_col, text_col))
        return cls._publish(docs.sparkSession, path, made)

    @classmethod
    def _publish(cls, spark: SparkSession, path: str, segments: list[dict]) -> Index:
        """A version of its own; of two writers at once the later one fails and changes nothing."""
        version = (cls.versions(spark, path) or [0])[-1] + 1
        schema = "segment string, docs long, measured long, length long, mean double, marks string, gone_docs long, gone_measured long, gone_length long"
        names = [x.split()[0] for x in schema.split(", ")]
        spark.createDataFrame([tuple(s[n] for n in names) for s in segments], schema).coalesce(1).write.mode("error").parquet(f"{path}/versions/{version:010d}")
        return cls(spark, path, version)

    @classmethod
    def _segment(cls, spark: SparkSession, path: str, counted: DataFrame) -> list[dict]:
        """Writes a segment of counted documents; none for none."""
        name = uuid.uuid4().hex
        at = f"{path}/segments/{name}"
        counted.write.parquet(f"{at}/counted")
        rows = spark.read.schema(counted.schema).parquet(f"{at}/counted")
        size = rows.agg(F.count("*").alias("docs"), F.count("dl").alias("measured"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).collect()[0].asDict()
        postings = size.pop("postings")
        if size["docs"]:
            mean = size["length"] / size["measured"] if size["length"] else 1.0
            P.striped(rows, mean, max(-(-size["docs"] // PART_DOCS), -(-postings // PART_POSTINGS))).write.parquet(f"{at}/striped")
            made = spark.read.parquet(f"{at}/striped")
            blocks = made.where("term IS NOT NULL").select(P.BLOCKS)
            held = blocks.agg(F.sum(F.octet_length("packed") + 24)).collect()[0][0] or 0
            order = ["term", "stripe", "begin"]
            blocks.repartitionByRange(max(1, -(-held // FILE_BYTES)), *order).sortWithinPartitions(*order).write.option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(f"{at}/blocks")
            made.where("term IS NULL").select("stripe", "ids", "dls").write.parquet(f"{at}/docs")
        for scratch in ("counted", "striped"):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{scratch}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if not size["docs"]:
            return []
        return [{"segment": name, **size, "mean": mean, "marks": None, "gone_docs": 0, "gone_measured": 0, "gone_length": 0}]

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """A version with a segment of further documents."""
        return self._publish(self.spark, self.path, self.segments + self._segment(self.spark, self.path, P.counted(docs, id_col, text_col)))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> Index:
        """A version in which documents of these ids don't count."""
        return self._publish(self.spark, self.path, self._marked(ids, id_col))

    def replace(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """A version in which documents stand for the old ones of their ids, if there are any."""
        return self._publish(self.spark, self.path, self._marked(docs, id_col) + self._segment(self.spark, self.path, P.counted(docs, id_col, text_col)))

    def _marked(self, ids: DataFrame, id_col: str) -> list[dict]:
        """Segments with more marks: numbers of deleted documents by stripe, and how many each term loses.

        Only stripes that lose a document are unpacked for that.
        """
        asked = ids.select(F.col(id_col).alias("id")).distinct()
        out = []
        for s in self.segments:
            hit = self._living(self._docs(s, marked=True)).join(asked, "id", "left_semi").groupBy("stripe").agg(F.sort_array(F.collect_list("no")).alias("nos"), F.count("*").alias("docs"), F.count("dl").alias("measured"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
            at = f"{self.path}/marks/{uuid.uuid4().hex}"
            hit.write.parquet(f"{at}/stripes")
            new = self.spark.read.parquet(f"{at}/stripes")
            gone = new.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("docs", "measured", "length"))).collect()[0]
            if not gone["docs"]:
                out.append(s)
                continue
            lost = self._lost(s, new).groupBy("term").agg(F.sum("n").alias("n"))
            marks, losses = self._marks(s), self._losses(s)
            if marks is not None:
                both = marks.unionByName(new.select("stripe", "nos")).groupBy("stripe").agg(F.sort_array(F.flatten(F.collect_list("nos"))).alias("nos"))
                lost = losses.unionByName(lost).groupBy("term").agg(F.sum("n").alias("n"))
            else:
                both = new.select("stripe", "nos")
            both.write.parquet(f"{at}/marks")
            lost.sort("term").write.parquet(f"{at}/losses")
            out.append(s | {"marks": at} | {f"gone_{x}": s[f"gone_{x}"] + gone[x] for x in ("docs", "measured", "length")})
        return out

    def merge(self) -> Index:
        """A version in which FAN or more segments of one size are one, without their deleted documents; texts aren't read."""
        tiers: dict[int, list[dict]] = {}
        for s in self.segments:
            tiers.setdefault((s["docs"] - s["gone_docs"]).bit_length() // (FAN.bit_length() - 1), []).append(s)
        kept, made = [], []
        for tier in tiers.values():
            if len(tier) < FAN:
                kept += tier
            else:
                made += self._segment(self.spark, self.path, reduce(DataFrame.unionByName, map(self._counted, tier)))
        return self._publish(self.spark, self.path, kept + made) if made else self

    def _counted(self, s: dict) -> DataFrame:
        """Counted living documents of a segment, from its blocks: those of a stripe meet in one task."""
        kind = self.id_type

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            no, tf, of = _unpacked(left)
            ids, dls = right.column("ids")[0].values, right.column("dls")[0].values
            coded = left.column("term").combine_chunks().dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            code = coded.indices.to_numpy().astype(np.int64)[of]
            # a document's terms stand together, the most frequent first
            order = np.lexsort((rank[code], -tf, no))
            ends = np.searchsorted(no[order], np.arange(len(ids) + 1)).astype(np.int32)
            term = coded.dictionary.take(pa.array(code[order]))
            lead = pa.array(ends[:-1].astype(np.int64), mask=ends[:-1] == ends[1:])
            lists = [pa.ListArray.from_arrays(pa.array(ends), term), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf[order].astype(np.int32)))]
            out = pa.table([ids, dls.cast(pa.int32()), term.take(lead), *lists], ["id", "dl", "lead", "terms", "tfs"])
            dead = right.column("nos")[0].as_py() or []
            return out.take(pa.array(np.setdiff1d(np.arange(len(ids)), dead))) if dead else out

        right = self._docs(s, marked=True)
        return self._blocks(s).groupBy("stripe").cogroup(right.groupBy("stripe")).applyInArrow(run, f"id {kind}, dl int, lead string, terms array<string>, tfs array<int>")

    # ------------------------------------------------------------ reading
    def _table(self, path: str) -> DataFrame:
        """Files never change, so their schema is read once."""
        if path not in self._tables:
            self._tables[path] = self.spark.read.parquet(path)
        return self._tables[path]

    @property
    def id_type(self) -> str:
        s = self.segments[0]["segment"]
        return self._table(f"{self.path}/segments/{s}/docs").schema["ids"].dataType.elementType.simpleString()

    def _blocks(self, s: dict) -> DataFrame:
        return self._table(f"{self.path}/segments/{s['segment']}/blocks")

    def _marks(self, s: dict) -> DataFrame | None:
        """(stripe, nos): numbers of the deleted documents."""
        return self._table(f"{s['marks']}/marks") if s["marks"] else None

    def _losses(self, s: dict) -> DataFrame | None:
        return self._table(f"{s['marks']}/losses") if s["marks"] else None

    def _docs(self, s: dict, marked: bool = False) -> DataFrame:
        """(stripe, ids, dls) of a segment, and if `marked`, the numbers of the deleted ones."""
        docs = self._table(f"{self.path}/segments/{s['segment']}/docs")
        if not marked:
            return docs
        marks = self._marks(s)
        return docs.join(small(marks), "stripe", "left") if marks is not None else docs.withColumn("nos", F.lit(None).cast("array<int>"))

    @staticmethod
    def _living(docs: DataFrame) -> DataFrame:
        """(stripe, no, id, dl) of documents that aren't deleted."""
        rows = docs.select("stripe", "nos", F.posexplode(F.arrays_zip("ids", "dls")).alias("no", "doc"))
        return rows.where(F.col("nos").isNull() | ~F.array_contains("nos", F.col("no"))).select("stripe", "no", F.col("doc.ids").alias("id"), F.col("doc.dls").alias("dl"))

    def _all(self, what) -> DataFrame:
        """what(segment) of all segments, with their numbers."""
        return reduce(DataFrame.unionByName, [what(s).withColumn("seg", F.lit(i)) for i, s in enumerate(self.segments)])

    @property
    def blocks(self) -> DataFrame:
        """All blocks, with the number of their segment; high and low hold for the lengths' present mean."""

        def one(s: dict) -> DataFrame:
            drift = self.avg_dl / s["mean"] if self.avg_dl else 1.0
            return self._blocks(s).withColumn("low", F.coalesce("low", F.col("high") - 1) * F.lit(P.UNIT * min(1.0, drift))).withColumn("high", F.col("high") * F.lit(P.UNIT * max(1.0, drift)))

        return self._all(one)

    @property
    def docs(self) -> DataFrame:
        return self._all(lambda s: self._docs(s, marked=True))

    @property
    def lengths(self) -> DataFrame:
        """(id, dl) of every living document."""
        return self._living(self.docs).select("id", F.col("dl").cast("long").alias("dl"))

    @property
    def terms(self) -> DataFrame:
        """(term, df)."""
        found = self.blocks.select("term", F.col("n").cast("long").alias("n"))
        for s in self.segments:
            if s["marks"]:
                found = found.unionByName(self._losses(s).select("term", (-F.col("n")).alias("n")))
        return found.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def _lost(self, s: dict, marks: DataFrame) -> DataFrame:
        """(term, n) of blocks: postings of the documents that (stripe, nos) lists. A stripe's blocks meet its list once."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            gone = np.zeros(P.WIDTH, bool)
            gone[right.column("nos")[0].values.to_numpy()] = True
            no, _, of = _unpacked(left)
            n = np.bincount(of[gone[no]], minlength=left.num_rows)
            some = pa.array(np.flatnonzero(n))
            return pa.table([left.column("term").take(some), pa.array(n).take(some)], ["term", "n"])

        some = self._blocks(s).select("stripe", "term", "begin", "n", "packed").join(small(marks.select("stripe")), "stripe", "left_semi")
        return some.groupBy("stripe").cogroup(marks.select("stripe", "nos").groupBy("stripe")).applyInArrow(run, "term string, n long")

    @property
    def postings(self) -> DataFrame:
        """(id, term, tf) of every living document, unpacked."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, dead = right.column("ids")[0].values, right.column("nos")[0].as_py() or []
            no, tf, of = _unpacked(left)
            out = pa.table([ids.take(pa.array(no)), left.column("term").combine_chunks().take(pa.array(of)), pa.array(tf)], ["id", "term", "tf"])
            return out.filter(pa.array(~np.isin(no, dead))) if dead else out

        return self._cells(self.blocks, run, f"id {self.id_type}, term string, tf long")

    def _cells(self, blocks: DataFrame, run, schema: str, stripes: DataFrame | None = None) -> DataFrame:
        """run(blocks, documents) for each stripe, or each of some."""
        docs = self.docs if stripes is None else self.docs.join(stripes, ["seg", "stripe"], "left_semi")
        return blocks.groupBy("seg", "stripe").cogroup(docs.groupBy("seg", "stripe")).applyInArrow(run, schema)

    def _of(self, terms: list[str]) -> DataFrame:
        """Blocks of some terms: rows are sorted by term, so files and row groups without one are left out."""
        return self.blocks.where(F.col("term").isin(sorted(set(terms))))

    def df(self, terms: list[str]) -> dict[str, int]:
        """Living documents that hold a term; a row a term comes to the driver."""
        found = {r["term"]: r["n"] for r in self._of(terms).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return self._less_deleted(found)

    def _less_deleted(self, found: dict[str, int]) -> dict[str, int]:
        found = dict(found)
        for s in self.segments:
            if s["marks"]:
                for r in self._losses(s).where(F.col("term").isin(sorted(found))).collect():
                    found[r["term"]] -= r["n"]
        return {t: n for t, n in found.items() if n > 0}

    def _idf(self, terms: list[str], df: dict[str, int] | None = None) -> dict[str, float]:
        df = self.df(terms) if df is None else df
        return {t: float(np.log((self.n_docs - df[t] + 0.5) / (df[t] + 0.5))) for t in dict.fromkeys(terms) if t in df}

    def _scored(self, blocks: DataFrame, gains: dict[str, dict[str, float]], k1: float = K1, b: float = B, best: int = 0, stripes: DataFrame | None = None) -> DataFrame:
        """(query, id, score) of living documents in some blocks; gains: idf of each term of each query, times its count there.

        best: at most so many of positive score a stripe and query, and what ties with the last. stripes: those that the
        blocks lie in; the blocks then have a list `cells` of the ranges to score.
        """
        bounds = stripes is not None
        mean, schema = self.avg_dl or 1.0, f"query string, id {self.id_type}, score double"

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, dead = right.column("ids")[0].values, right.column("nos")[0].as_py() or []
            dl = right.column("dls")[0].values.fill_null(0).to_numpy().astype(np.float64)
            held = [(t, *P.unpacked(packed, begin, n)) for t, begin, n, packed in zip(*(left.column(c).to_pylist() for c in ("term", "begin", "n", "packed")), strict=True)]
            wanted = np.ones(len(ids), bool)
            if bounds:
                wanted[:] = False
                for cell in {c for cells in left.column("cells").to_pylist() for c in cells}:
                    wanted[cell * P.CELL : (cell + 1) * P.CELL] = True
            wanted[dead] = False
            out = []
            for q, idf_ in gains.items():
                score, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for t in idf_:  # in the query's order
                    for u, no, tf in held:
                        if u == t:
                            score[no] += idf_[t] * P.weight(tf.astype(np.float64), dl[no], mean, k1, b)
                            met[no] = True
                at = np.flatnonzero(met & wanted)
                if best:
                    at = at[np.round(score[at], 6) > 0]
                    if len(at) > best:
                        at = at[score[at] >= np.partition(score[at], -best)[-best] - SLACK]
                out.append(pa.table([pa.array([q] * len(at), pa.string()), ids.take(pa.array(at)), pa.array(score[at])], ["query", "id", "score"]))
            return pa.concat_tables(out)

        return self._cells(blocks, run, schema, stripes)

    def _gains(self, queries: dict[str, list[str]]) -> dict[str, dict[str, float]]:
        known = self._idf([t for ts in queries.values() for t in ts])
        return {q: {t: n * known[t] for t, n in Counter(ts).items() if t in known} for q, ts in queries.items()}

    def scores(self, queries: dict[str, list[str]], k1: float = K1, b: float = B) -> DataFrame:
        """(query, id, score) of the documents that hold a term of a query; repeated terms count again."""
        return self._scored(self._of([t for ts in queries.values() for t in ts]), self._gains(queries), k1, b) if self.segments else self._nothing("query string, id long, score double")

    def _nothing(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def all_scores(self, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
        """(id, dl, score) of every document, 0 where it holds no term."""
        if not self.segments:
            return self._nothing("id long, dl long, score double")
        return self.lengths.join(self.scores({"q": terms}, k1, b).drop("query"), "id", "left").select("id", "dl", F.coalesce("score", F.lit(0.0)).alias("score"))

    def _heads(self, terms: list[str]) -> DataFrame:
        return self._of(terms).select("seg", "stripe", *HEADS)

    def _most(self, heads: DataFrame, gains: dict[str, float]) -> DataFrame:
        """(seg, stripe, cell, most) of each cell in which some document may score over 0."""
        names = ["seg", "stripe", "cell", "most"]

        def run(t: pa.Table) -> pa.Table:
            cell, most = _promising(t, gains)
            return pa.table([pa.array([t.column("seg")[0].as_py()] * len(cell), pa.int32()), pa.array([t.column("stripe")[0].as_py()] * len(cell), pa.int64()), pa.array(cell, pa.int32()), pa.array(most)], names)

        return heads.groupBy("seg", "stripe").applyInArrow(run, "seg int, stripe long, cell int, most double")

    def _within(self, terms: list[str], cells: DataFrame, few: pa.Table | None = None) -> tuple[DataFrame, DataFrame]:
        """Blocks of terms that reach into some of the cells, with those cells (`cells`) of the stripe; and the stripes."""
        wanted = cells.groupBy("seg", "stripe").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
        wanted = F.broadcast(wanted) if few is not None else small(wanted)
        blocks = self._of(terms)
        if few is not None and few.num_rows <= LISTED:
            blocks = blocks.where(F.col("stripe").isin(sorted(set(few.column("stripe").to_pylist()))))
        first, last = F.col("begin"), F.col("begin") + F.expr("shiftleft(1, span)")
        return blocks.join(wanted, ["seg", "stripe"]).where(F.exists("cells", lambda c: ((c + 1) * P.CELL > first) & (c * P.CELL < last))), wanted

    def topk(self, terms: list[str], k: int = 10) -> DataFrame:
        """The k best documents of positive score; ties to the smaller id.

        Heads of blocks come to the driver if there are at most SMALL of them; else bounds are taken by stripe in tasks.
        """
        kind = self.id_type if self.segments else "long"
        if not self.segments or k <= 0 or not terms:
            return self._nothing(f"id {kind}, score double")
        heads = self._heads(terms)
        near = heads.limit(SMALL + 1).toArrow()
        gathered = near.num_rows <= SMALL
        df = None
        if gathered:
            df = self._less_deleted({r["term"]: r["n_sum"] for r in near.group_by("term").aggregate([("n", "sum")]).to_pylist()})
        gains = {t: n * g for t, g in self._idf(terms, df).items() for n in [terms.count(t)]}
        if not any(g > 0 for g in gains.values()):
            self.last_read = (0, 0)
            return self._nothing(f"id {kind}, score double")

        if gathered and pc.sum(near.column("n")).as_py() <= ONE_PASS:
            self.last_read = (pc.sum(near.column("n")).as_py(),) * 2
            return self._scored(self._of(terms), {"q": gains}, best=k).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)

        def ranked(cells: DataFrame, few: pa.Table | None = None) -> DataFrame:
            blocks, stripes = self._within(list(gains), cells, few)
            return self._scored(blocks, {"q": gains}, best=k, stripes=stripes).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)

        if gathered:
            parts = near.sort_by([("seg", "ascending"), ("stripe", "ascending")])
            seg, stripe = parts.column("seg").to_numpy(), parts.column("stripe").to_numpy()
            cuts = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (stripe[1:] != stripe[:-1])))
            found = [(seg[a], stripe[a], *_promising(parts.slice(a, b - a), gains)) for a, b in zip(cuts, np.append(cuts[1:], len(seg)), strict=True)]
            many = [len(cell) for *_, cell, _ in found]
            cols = [np.repeat([f[0] for f in found], many), np.repeat([f[1] for f in found], many), *(np.concatenate([f[i] for f in found]) for i in (2, 3))]
            most = pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["seg", "stripe", "cell", "most"])
            some = most.sort_by([("most", "descending")]).slice(0, k + PROBES)
        else:
            bounds = self._most(heads, gains)
            some = bounds.orderBy(F.desc("most"), "seg", "stripe", "cell").limit(k + PROBES).toArrow()
        # cells that promise most first; what they hold tells which others can matter
        found = ranked(self.spark.createDataFrame(some), some).collect()
        least = found[-1]["score"] - SLACK if len(found) == k else 0.0
        if gathered:
            left = most.filter(pc.greater_equal(most.column("most"), least))
            self.last_read = _reached(near, left)
            return ranked(self.spark.createDataFrame(left), left)
        left = bounds.where(F.col("most") >= least)
        blocks, _ = self._within(list(gains), left)
        self.last_read = tuple(x.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0] for x in (blocks, heads))
        return ranked(left)

    def topk_each(self, queries: dict[str, list[str]], k: int) -> DataFrame:
        """(query, id, score): the k best of positive score of each query, from one pass over their terms' blocks; a stripe sends k a query at most, but for ties."""
        if not self.segments or k <= 0:
            return self._nothing(f"query string, id {self.id_type if self.segments else 'long'}, score double")
        some = self._scored(self._of([t for ts in queries.values() for t in ts]), self._gains(queries), best=k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return some.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


#: Columns that bounds are taken from; cells scored first beside one for each place; stripes that a filter lists.
HEADS, PROBES, LISTED = ["term", "begin", "span", "n", "low", "high", "tops"], 10, 1000


def _unpacked(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, term frequencies, row of its block) of all postings of some blocks."""
    n = blocks.column("n").to_numpy()
    no, tf = P.unpacked_all(blocks.column("packed").combine_chunks(), blocks.column("begin").to_numpy(), n)
    return no, tf, np.repeat(np.arange(len(n)), n)


def _promising(heads: pa.Table, gains: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, most) of a stripe's blocks."""
    most = P.most_of((*rest, gains[t]) for t, *rest in zip(*(heads.column(c).to_pylist() for c in HEADS), strict=True) if t in gains)
    cell = np.flatnonzero(most > 0)
    return cell.astype(np.int32), most[cell]


def _reached(heads: pa.Table, cells: pa.Table) -> tuple[int, int]:
    """Postings of the blocks that reach into some cells, and of all."""
    wanted: dict[tuple[int, int], np.ndarray] = {}
    for g, s, c in zip(*(cells.column(x).to_pylist() for x in ("seg", "stripe", "cell")), strict=True):
        wanted.setdefault((g, s), np.zeros(P.WIDTH // P.CELL, bool))[c] = True
    read = total = 0
    for g, s, begin, span, n in zip(*(heads.column(x).to_pylist() for x in ("seg", "stripe", "begin", "span", "n")), strict=True):
        total += n
        if (g, s) in wanted and wanted[g, s][P.cells_of(begin, span)].any():
            read += n
    return read, total


def fuse(bm25: Column, vector: Column, keyword_weight: float | Column = 0.3) -> Column:
    """Keyword score, a tenth of BM25 and 1 at most, and vector score, weighted."""
    w = keyword_weight if isinstance(keyword_weight, Column) else F.lit(keyword_weight)
    return F.least(bm25 / 10, F.lit(1.0)) * w + vector * (1 - w)
