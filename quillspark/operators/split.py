"""Splitting long texts at semantic boundaries: a fold over the text, so an Arrow function.

Where a piece begins decides all pieces after it, so a text is a chain of beginnings. A very long one is cut by several
tasks: each follows the chain that begins at its own stretch's start into the next stretch, up to the first beginning that
the next stretch's own chain has too. From there on both are one. So the true chain goes along the stretches' chains, from
meeting to meeting. A text of which some chain meets none of the next stretch's beginnings is cut in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .postings import slices

#: Characters looked back for a boundary, and the boundaries from best to worst; places of one don't overlap.
LOOK_BACK = 200
BOUNDARIES = [re.compile(x) for x in (r"\n\n", r"\. ", "; ", ", ", r"\s")]
PIECE = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("piece", T.StringType())]))


def cut(text: str, at: int, end: int) -> int:
    """Where the piece from `at` to `end` at most is cut."""
    low = max(at, end - LOOK_BACK)
    stretch = text[low:end]
    for mark in BOUNDARIES:
        if ends := [m.end() for m in mark.finditer(stretch)]:
            return low + ends[-1]
    return end


def windows(text: str, size: int, overlap: int, compat: bool = False) -> list[tuple[int, int]]:
    """Begin and end of each piece. compat: after the last full window go on in steps of one to the very end."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    out, at = [], 0
    while at < n:
        end = min(at + size, n)
        if end < n:
            end = cut(text, at, end)
        out.append((at, end))
        if end >= n and not compat:
            break
        at = max(at + 1, end - overlap)
    return out


def pieces(text: str, size: int, overlap: int, compat: bool = False) -> list[tuple[int, str]]:
    """(begin, trimmed piece), without empty ones."""
    return [(a, t) for a, b in windows(text, size, overlap, compat) if (t := text[a:b].strip())]


def chain(text: str, at: int | None, stop: int, size: int, overlap: int, final: bool, until: frozenset[int] = frozenset()) -> tuple[list[tuple[int, int]], int | None]:
    """Pieces (begin, end) that begin before `stop`, from `at` on or up to a place in `until`; and where the chain goes on.

    final: the text ends here, which ends the chain; else `size` characters or more follow `stop`.
    """
    out: list[tuple[int, int]] = []
    while at is not None and at < stop and at not in until:
        end = min(at + size, len(text))
        ends_here = final and end == len(text)
        if not ends_here:
            end = cut(text, at, end)
        out.append((at, end))
        at = None if ends_here or final and end >= len(text) else max(at + 1, end - overlap)
    return out, at


def split_long(docs: DataFrame, size: int = 1800, overlap: int = 300, stretch: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, start, piece) as split() gives them, with texts of more than `stretch` characters cut by several tasks.

    A stretch's task holds its characters and those of the next. Of a whole text only places meet in one task, two numbers
    a piece. Texts of which some chain meets none of the next stretch are cut by one task each.
    """
    step = size - overlap
    if step < 1:
        raise ValueError("overlap must be less than size")
    stretch = max(1, stretch // step) * step  # so that chains meet at once where nothing but the size cuts
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > stretch, F.lit(False))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, begin in enumerate(range(0, len(text), stretch)):
                    part = text[begin : begin + 2 * stretch + size]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array([begin + len(part) >= len(text)]), pa.array([part], pa.string())], ["row", "k", "final", "text"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stretch's own chain up to where it meets that of the next."""
        for b in batches:
            for row, k, final, text in zip(*(b.column(c).to_pylist() for c in ("row", "k", "final", "text")), strict=True):
                own, on = chain(text, 0, stretch, size, overlap, final)
                there = frozenset(x for x, _ in chain(text, stretch, 2 * stretch, size, overlap, final)[0]) if on is not None and len(text) > stretch else frozenset()
                more, on = chain(text, on, 2 * stretch, size, overlap, final, there)
                own += more
                meets = on if on in there else None
                lost = on is not None and meets is None and not (final and on >= len(text))
                cols = [pa.array([row]), pa.array([k]), pa.array([[k * stretch + x for x, _ in own]], pa.list_(pa.int64())), pa.array([[k * stretch + y for _, y in own]], pa.list_(pa.int64())), pa.array([[not text[x:y].strip() for x, y in own]], pa.list_(pa.bool_())), pa.array([k * stretch + meets if meets is not None else None], pa.int64()), pa.array([lost])]
                yield pa.RecordBatch.from_arrays(cols, ["row", "k", "begins", "ends", "blank", "meets", "lost"])

    def true(t: pa.Table) -> pa.Table:
        """The pieces of a text's true chain that aren't blank, numbered; none if a chain is lost."""
        names = ["row", "k", "n", "start", "stop"]
        at, out = 0, []
        for r in t.sort_by("k").to_pylist():
            if at is None:  # the chain before went on to the text's end
                break
            if r["lost"]:
                out = [(-1, -1, -1)]
                break
            kept = [(x, y) for x, y, blank in zip(r["begins"], r["ends"], r["blank"], strict=True) if x >= at and not blank]
            out += [(i, x, y) for i, (x, y) in enumerate(kept, len(out))]
            at = r["meets"]
        n, x, y = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ([], [], [])))
        return pa.table([pa.array(np.full(len(n), t.column("row")[0].as_py(), np.int64)), pa.array(np.maximum(x, 0) // stretch), pa.array(n), pa.array(x), pa.array(y)], names)

    def pieces_of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "n", "start", "piece"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.string())], names)
        text, base = right.column("text")[0].as_py(), right.column("k")[0].as_py() * stretch
        start = left.column("start").to_pylist()
        found = [text[x - base : y - base].strip() for x, y in zip(start, left.column("stop").to_pylist(), strict=True)]
        return pa.table([left.column("row"), left.column("n").cast(pa.int32()), pa.array(start, pa.int32()), pa.array(found, pa.string())], names)

    stretches = rows.where(long).select("row", "text").mapInArrow(parts, "row long, k long, final boolean, text string").repartition("row", "k")
    chains = stretches.mapInArrow(follow, "row long, k long, begins array<long>, ends array<long>, blank array<boolean>, meets long, lost boolean")
    places = chains.groupBy("row").applyInArrow(true, "row long, k long, n long, start long, stop long")
    found = places.where("n >= 0").groupBy("row", "k").cogroup(stretches.groupBy("row", "k")).applyInArrow(pieces_of, "row long, n int, start int, piece string")
    named = found.join(rows.where(long).select("row", "id"), "row").select("id", "n", "start", "piece")
    alone = rows.where(long).join(places.where("n < 0").select("row"), "row", "left_semi").select("id", "text")
    one = lambda few: split(few, size, overlap, id_col="id")
    return one(rows.where(~long).select("id", "text")).unionByName(one(alone)).unionByName(named)


def split(docs: DataFrame, size: int = 1800, overlap: int = 300, compat: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, start, piece) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, text_col)):
            rows = [(i, n, a, p) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, (a, p) in enumerate(pieces(t or "", size, overlap, compat))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.types[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["id", "n", "start", "piece"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n int, start int, piece string")
