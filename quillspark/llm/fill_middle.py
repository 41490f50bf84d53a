"""Fill-in-the-middle transformation by run-length class encoding.

A text is stored as its maximal runs of one character class, each with the number of units (lines, words or characters)
that end in the text up to the run's end. A cut after k units lies in the first run whose count reaches k, found by
binary search. Units that end in one run do so at its last characters, one each, so the cut's place is the run's end less
the units still to come in that run; nothing between the cuts is looked at. Which units the cuts follow, and the form,
come from a hash of the document's id.

Forms: `plain` is the text itself; `psm` writes prefix, suffix, middle, `spm` suffix, prefix, middle, each behind its
marker. `restore` rebuilds the text from output and form alone: no piece can hold a marker, since such texts stay plain.

Defined results: a null or empty text is plain, of 0 units. A null id is hashed as an empty string. Texts are read to
their end, whatever their length. Repeated rows are transformed each; rows of equal ids have the same hashes. An empty
table gives no rows. Other columns pass through `transform`, but for those of the names it adds, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, spare, table

#: Markers of prefix, suffix and middle; percent of texts that are cut, and of these in the form spm; seed of the hashes.
MARKS, RATE, SPM, SEED = ("<P>", "<S>", "<M>"), 100, 50, 7
#: White space of the unit `word`: a word and what follows it up to the next, and white space that begins a text.
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
#: What `transform` adds.
ADDED = T.StructType([T.StructField(n, k) for n, k in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))])


@dataclass
class Runs:
    """Maximal runs of one class: where each ends, and the units that end in the text up to there."""

    ends: np.ndarray
    units: np.ndarray

    @classmethod
    def of(cls, text: str, unit: str = "line") -> Runs:
        """Lines end at each character of a run of line ends, words at the end of a run of white space, characters at each of a single run; what is left at the text's end is a unit."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))
        if unit == "char":
            return cls(np.array([n]), np.array([n]))
        mark = points == 10 if unit == "line" else np.isin(points, SPACES)
        ends = np.append(np.flatnonzero(mark[1:] != mark[:-1]) + 1, n)
        closing = mark[ends - 1]
        size = np.diff(ends, prepend=0) if unit == "line" else np.ones(len(ends), np.int64)
        gained = np.where(closing, size, 0)
        gained[-1] = max(gained[-1], 1)
        return cls(ends, np.cumsum(gained))

    @property
    def total(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, k: int) -> int:
        """Characters of the first k units."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.units, k))
        return int(self.ends[run] - (self.units[run] - k))


def arranged(text: str, h: tuple[int, int, int, int], unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix and of the middle, output) by four hashes."""
    runs = Runs.of(text, unit)
    n = runs.total
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (runs.offset(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = MARKS
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output."""
    if unit not in ("line", "word", "char"):
        raise ValueError(f"no unit {unit!r}: line, word or char")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    kept = [c for c in docs.columns if c not in ADDED.names]
    hashed = spare(docs, "h")
    rows = docs.select(*kept, F.substring(digest, 1, 32).alias(hashed))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [arranged(x or "", tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24)), unit, rate, spm) for x, h in zip(b.column(text_col).cast(pa.string()).to_pylist(), b.column(hashed).to_pylist(), strict=True)]
        cols = list(zip(*made, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*kept, *ADDED.names])

    return map_arrow(rows, run, T.StructType([*(docs.schema[c] for c in kept), *ADDED.fields]))


def restore(rows: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """rows with the text rebuilt from output and form."""
    kept = [c for c in rows.columns if c != text]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [restored(o or "", f or "plain") for o, f in zip(b.column(output).to_pylist(), b.column(form).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(made, pa.string())], [*kept, text])

    return map_arrow(rows, run, T.StructType([*(rows.schema[c] for c in kept), T.StructField(text, T.StringType())]))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's form, cuts and digests of its output and of the text rebuilt from it."""
    out = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def _hash_sql(i: int) -> str:
    return f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"


SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
b AS (SELECT *, CAST(len(u) AS BIGINT) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_hash_sql(2)} % 100 >= {RATE} AS plain FROM a),
c AS (SELECT *, least({_hash_sql(0)} % (n + 1), {_hash_sql(1)} % (n + 1)) AS p, greatest({_hash_sql(0)} % (n + 1), {_hash_sql(1)} % (n + 1)) AS q FROM b),
d AS (SELECT *, array_to_string(u[1:p], '') AS prefix, array_to_string(u[p + 1:q], '') AS middle, array_to_string(u[q + 1:], '') AS suffix,
             CASE WHEN plain THEN 'plain' WHEN {_hash_sql(3)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN plain THEN NULL ELSE CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN plain THEN NULL ELSE CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM d"""

QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {"op13_fill_middle": SQL}
