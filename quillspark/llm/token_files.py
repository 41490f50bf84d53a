"""Token ids in raw binary files, with a minimal perfect hash index from document keys to places in them.

Files. Documents go in ascending order of their ids to shards of about SHARD_BYTES of text. A shard is one file: the token
ids of its documents, each with the end id, as little-endian unsigned integers of 2 or 4 bytes with nothing in between, and
then a directory: ids and token counts of its documents as 8-byte integers, and a footer. Spark's own text writer
writes them, through any file system it knows and with its commits: a document is a row of bytes, and the writer's line
separator is the last byte of the end id.

Index. Every distinct id is a key; its bucket, by a hash, is a row of the index. The bucket's keys have a minimal perfect
hash by displacement: a second hash deals them to small groups, largest first, and each group stores the first number that
sends all its keys to free slots. So a key's slot takes two hashes and one stored number, and slots are as many as keys.
A slot stores a fingerprint of its key, by which unknown keys are refused (but for one in 2^32), and the key's runs: shard,
first document, byte offset, documents, tokens. An id that one document has is one run of one document; those of many
documents have a run in each shard that holds some.

Defined results: a null or empty text is its end token alone. Documents of equal ids follow each other in order of their
texts' hashes; equal rows are each written. Documents without an id come first and have a key of their own. Very long
texts are read to their end; a shard is as long as its longest document at least. An empty table gives files without documents and
an index without keys. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import mixed, scratch, scratch_path, slices, small_batches, stored, table, tidied

#: Token that ends a document; bytes of text and documents of a shard; keys of a bucket and of a group within it.
END, SHARD_BYTES, SHARD_DOCS, BUCKET, GROUP = 1, 32 << 20, 65_536, 2048, 4
#: Characters of the encoder's leaves; any give the same tokens.
LEAF = 1 << 16
#: Documents, those without an id, bytes of an id; then the magic and the byte that rows end with.
FOOTER, MAGIC = "<QQB", b"QIDS1"
#: Seeds of the hashes for groups, slots and fingerprints; Spark deals keys to buckets.
SEEDS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0x082EFA98EC4E6C89))
#: Displacements tried at once.
TRIES = np.arange(1, 65, dtype=np.uint64)
RUN = "shard int, first long, at long, docs long, n long"
INDEX = f"bucket long, moves array<int>, prints array<long>, begins array<int>, runs array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>"


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    """One of the hashes of keys; all are bijective, so distinct keys never collide in 64 bits."""
    return mixed(keys.astype(np.int64).view(np.uint64) ^ SEEDS[seed])


def slots_of(keys: np.ndarray, moves: np.ndarray, slots: int) -> np.ndarray:
    """The slots of keys in a bucket with these stored displacements."""
    move = moves[(hashed(keys, 0) % np.uint64(len(moves))).astype(np.int64)]
    return (mixed(hashed(keys, 1) + move.astype(np.uint64) * SEEDS[2]) % np.uint64(slots)).astype(np.int64)


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (hashed(keys, 2) >> np.uint64(32)).astype(np.int64)


def perfect(keys: np.ndarray) -> np.ndarray:
    """A displacement for each group, with which distinct keys have distinct slots 0 .. len(keys) - 1."""
    n, groups = len(keys), max(1, len(keys) // GROUP)
    of = (hashed(keys, 0) % np.uint64(groups)).astype(np.int64)
    base = hashed(keys, 1)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=groups))
    sizes = np.diff(ends, prepend=0)
    moves, free = np.zeros(groups, np.int64), np.ones(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        if not sizes[g]:
            break
        mine = base[order[ends[g] - sizes[g] : ends[g]]]
        tried = np.uint64(0)
        while True:
            slots = (mixed(mine[None] + (tried + TRIES)[:, None] * SEEDS[2]) % np.uint64(n)).astype(np.int64)
            fits = free[slots].all(axis=1)
            if len(mine) > 1:
                inside = np.sort(slots, axis=1)
                fits &= (inside[:, 1:] != inside[:, :-1]).all(axis=1)
            if fits.any():
                first = int(fits.argmax())
                moves[g] = int(tried) + 1 + first
                free[slots[first]] = False
                break
            tried += np.uint64(len(TRIES))
    return moves


def directory(content: memoryview) -> tuple[str, list[int | None], np.ndarray]:
    """(numpy type of the ids, document ids, token counts) of a shard file."""
    docs, nulls, width = struct.unpack_from(FOOTER, content, len(content) - struct.calcsize(FOOTER) - len(MAGIC) - 1)
    if content[-len(MAGIC) - 1 : -1] != MAGIC:
        raise ValueError("not a shard of token ids")
    at = len(content) - struct.calcsize(FOOTER) - len(MAGIC) - 1 - 16 * docs
    keys = np.frombuffer(content, "<i8", docs, at).tolist()
    return f"<u{width}", [None] * nulls + keys[nulls:], np.frombuffer(content, "<i8", docs, at + 8 * docs)


def write(docs: DataFrame, path: str, end: int = END, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the shards of docs below path."""
    tokenizer = tokenizer or default_path()
    small_batches(docs.sparkSession)
    width = 2 if encoder(tokenizer).library.get_vocab_size() <= 0x10000 and end < 0x8000 else 4
    close = np.array([end], f"<u{width}").tobytes()[-1:]  # below 128: a character of one byte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, keys, counts = encoder(tokenizer), [], []
        for whole in batches:
            for b in slices(whole):
                ids = [np.append(x, end).astype(f"<u{width}") for x in tok.encode_all(b.column("text").to_pylist(), LEAF)]
                keys += b.column("id").to_pylist()
                counts += map(len, ids)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()[:-1] for x in ids], pa.binary())], ["row"])
        if keys:
            nulls = sum(k is None for k in keys)
            tail = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(counts, "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([tail + struct.pack(FOOTER, len(keys), nulls, width) + MAGIC], pa.binary())], ["row"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()[0]
    shards = max(1, -(-(size["bytes"] or 0) // SHARD_BYTES), -(-size["n"] // SHARD_DOCS))
    # the last two keys part rows of one id
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    out = rows.select("id", "text").mapInArrow(tidied(run, "bpe"), "row binary").select(F.col("row").cast("string").alias("value"))
    out.write.option("lineSep", close.decode()).option("maxRecordsPerFile", 0).option("compression", "none").text(f"{path}/ids")


class Files:
    """Written shards and their index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def contents(self) -> DataFrame:
        """(shard, content) of each file; files are read whole, a row a file."""
        shard = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int")
        return self.spark.read.format("binaryFile").load(f"{self.path}/ids").where("length > 0").select(shard.alias("shard"), "content")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    @property
    def shards(self) -> DataFrame:
        """(shard, docs, n, start): start counts the ids of all shards before."""
        rows = self.spark.read.schema("shard int, docs long, n long").parquet(f"{self.path}/shards")
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/size").collect()[0]["buckets"]

    def build(self) -> Files:
        """Writes the index from the directories of the files: runs of keys, dealt to buckets, a perfect hash for each bucket."""

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, content in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                    kind, keys, counts = directory(memoryview(content.as_buffer()))
                    starts = np.concatenate([[0], np.cumsum(counts)])
                    first = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
                    last = [*first[1:], len(keys)]
                    n = starts[last] - starts[first]
                    cols = [pa.array([keys[i] for i in first], pa.int64()), pa.array([shard] * len(first), pa.int32()), pa.array(first, pa.int64()), pa.array(starts[first] * int(kind[2:])), pa.array(np.subtract(last, first), pa.int64()), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "shard", "first", "at", "docs", "n"])

        spark = self.spark
        small_batches(spark)
        with scratch(spark):
            found = stored(self.contents.mapInArrow(tidied(runs), f"key long, {RUN}"))
            found.groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).coalesce(1).write.parquet(f"{self.path}/shards")
            keyed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "first", "at", "docs", "n"))).alias("runs"))
            buckets = max(1, -(-found.count() // BUCKET))
            spark.createDataFrame([(buckets,)], "buckets long").coalesce(1).write.parquet(f"{self.path}/size")

            def bucket(t: pa.Table) -> pa.Table:
                t = t.combine_chunks()
                which, keys = t.column("bucket")[0].as_py(), t.column("key").fill_null(0).to_numpy()
                moves = perfect(keys)
                order = np.argsort(slots_of(keys, moves, len(keys)))
                entries = pa.concat_arrays(t.column("runs").chunks).take(pa.array(order))
                begins = np.concatenate([[0], np.cumsum(entries.value_lengths().to_numpy())])
                cols = {"bucket": [which], "moves": [moves.tolist()], "prints": [prints_of(keys)[order].tolist()], "begins": [begins.tolist()], "runs": [entries.flatten().to_pylist()]}
                return pa.table({k: pa.array(v, t_) for (k, v), t_ in zip(cols.items(), KINDS, strict=True)})

            dealt = keyed.withColumn("bucket", bucket_of(F.col("key"), buckets))
            dealt.groupBy("bucket").applyInArrow(bucket, INDEX).write.parquet(f"{self.path}/index")
        return self

    def lookup(self, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(key, shard, first, at, docs, n): the runs of distinct keys, each found in constant time in its bucket's row. Unknown keys have none."""
        small_batches(self.spark)
        asked = keys.select(F.col(id_col).cast("long").alias("key")).distinct().withColumn("bucket", bucket_of(F.col("key"), self.buckets))
        names = ["key", "shard", "first", "at", "docs", "n"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]

        def find(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], k) for k in kinds], names)
            row = {c: right.column(c)[0].values for c in ("moves", "prints", "begins", "runs")}
            known = left.column("key").combine_chunks()
            values = known.fill_null(0).to_numpy()
            prints = row["prints"].to_numpy()
            slot = slots_of(values, row["moves"].to_numpy(), len(prints))
            mine = prints[slot] == prints_of(values)
            begins = row["begins"].to_numpy().astype(np.int64)
            low, many = begins[slot[mine]], begins[slot[mine] + 1] - begins[slot[mine]]
            at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            runs = row["runs"].take(pa.array(at))
            return pa.table([known.take(pa.array(np.repeat(np.flatnonzero(mine), many))), *(runs.field(x).cast(k) for x, k in zip(names[1:], kinds[1:], strict=True))], names)

        return asked.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInArrow(find, f"key long, {RUN}")

    def read(self, keys: DataFrame, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
        """(doc_id, shard, start, n_tokens, ids_crc32, ids) of all documents of some keys, from the files; ids: else they stay behind and only their crc32 is given.

        Places come from the index; a shard's places meet its content in one task, which cuts the ids out of it. start
        counts the ids of all documents before.
        """
        names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()]

        def cut(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
            content = memoryview(right.column("content")[0].as_buffer())
            kind, _, counts = directory(content)
            width, begin = int(kind[2:]), right.column("start")[0].as_py()
            out: list[tuple] = []
            held = 0
            for key, shard, first, at, docs, n in zip(*(left.column(x).to_pylist() for x in ("key", "shard", "first", "at", "docs", "n")), strict=True):
                for k in [n] if docs == 1 else counts[first : first + docs].tolist():
                    raw = np.frombuffer(content, kind, k, at).astype("<u4").tobytes()
                    out.append((key, shard, begin + at // width, k, zlib.crc32(raw), raw if ids else None))
                    at, held = at + k * width, held + (len(raw) if ids else 64)
                    if held > 4 << 20:
                        yield pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
            yield pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names)

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.concat_tables(cut(left, right)) if left.num_rows and right.num_rows else pa.table([pa.array([], k) for k in kinds], names)

        held = self.contents.join(F.broadcast(self.shards.select("shard", "start")), "shard")
        out = self.lookup(keys, id_col).groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(pair, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long, ids binary")
        return out if ids else out.drop("ids")


RUN_TYPE = pa.struct([("shard", pa.int32()), ("first", pa.int64()), ("at", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])
KINDS = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(RUN_TYPE))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key; that of no key is bucket -1, which holds nothing else."""
    return F.when(key.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("long")


def write_indexed(docs: DataFrame, path: str, end: int = END, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Files:
    write(docs, path, end, tokenizer, id_col, text_col)
    return Files(docs.sparkSession, path).build()


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, token count and checksum, read back from the files by its key."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        files = write_indexed(docs, scratch_path(spark))
        return stored(files.read(docs, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32"), lasting=True)


QUERIES = {"op11_token_files": op11_token_files}
ORACLES: dict[str, str] = {}
