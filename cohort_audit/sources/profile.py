"""One pass over all columns of a table: missing values, numbers of distinct values, extremes and first values.

Each task keeps a bounded *capped set* for every column: the ``KEPT`` least hashes of its distinct values, and its ``FIRST`` least
values as text. Up to ``KEPT`` distinct values the count is exact; beyond, the greatest hash kept tells how dense the values lie
(an estimate with a deviation of about 3 %). Sets are merged in two levels. The plan has no Expand, however many columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

KEPT, FIRST, FANS = 1024, 21, 32
#: Columns that are never demographic, and words that hint at a demographic column. Fixed names.
RESERVED = ("y_true", "y_prob", "y_pred", "id", "patient_id", "index")
HINTS = ("race", "ethnicity", "gender", "sex", "age", "insurance", "language", "income", "education", "zip", "region", "site")
_PART = "column string, fan long, n long, nulls long, hashes array<long>, values array<string>, lo double, hi double"


class Capped:
    """What one column keeps."""

    def __init__(self):
        self.n = self.nulls = 0
        self.hashes, self.values, self.lo, self.hi = np.zeros(0, np.uint64), [], np.inf, -np.inf

    def add(self, column: pa.Array, text: pa.Array) -> None:
        self.n, self.nulls = self.n + len(text), self.nulls + text.null_count
        distinct = pc.drop_null(pc.unique(text)).to_pylist()
        if distinct:
            self._keep(pd.util.hash_array(np.array(distinct, object), categorize=False), distinct)
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            ends = pc.min_max(column)
            if ends["min"].is_valid:
                self.lo, self.hi = min(self.lo, float(ends["min"].as_py())), max(self.hi, float(ends["max"].as_py()))

    def _keep(self, hashes: np.ndarray, values: list[str]) -> None:
        self.hashes = np.unique(np.concatenate([self.hashes, hashes.astype(np.uint64)]))[:KEPT]
        self.values = sorted({*self.values, *values})[:FIRST]

    def merge(self, row) -> None:
        self.n, self.nulls = self.n + row.n, self.nulls + row.nulls
        self._keep(np.asarray(row.hashes, np.int64).view(np.uint64), list(row.values))
        if row.lo is not None and not np.isnan(row.lo):
            self.lo, self.hi = min(self.lo, row.lo), max(self.hi, row.hi)

    def row(self, name: str, fan: int) -> tuple:
        seen = self.lo <= self.hi
        return name, fan, self.n, self.nulls, self.hashes.view(np.int64).tolist(), self.values, self.lo if seen else None, self.hi if seen else None

    def distinct(self) -> int:
        """The number of distinct values, a null among them."""
        few = len(self.hashes) < KEPT
        return (len(self.hashes) if few else round((KEPT - 1) / (float(self.hashes[-1]) / 2.0**64))) + (self.nulls > 0)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_unique (a null counts as a value), exact, null_count, lo, hi, first_values (least ``FIRST`` as text)."""
    columns = list(df.columns if columns is None else columns)
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    own = [F.col(q).alias(f"c{i}") for i, q in enumerate(quoted)]
    text = [F.col(q).cast("string").alias(f"t{i}") for i, q in enumerate(quoted)]
    names = [x.split(" ")[0] for x in _PART.split(", ")]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Capped() for _ in columns]
        for batch in batches:
            for i, c in enumerate(held):
                c.add(batch.column(i), batch.column(len(columns) + i))
        fan = TaskContext.get().partitionId() % FANS
        rows = [c.row(name, fan) for name, c in zip(columns, held, strict=True)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.float64(), pa.float64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def together(pdf: pd.DataFrame) -> Capped:
        out = Capped()
        for r in pdf.itertuples():
            out.merge(r)
        return out

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([together(pdf).row(pdf["column"].iloc[0], int(pdf["fan"].iloc[0]))], columns=names)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        c = together(pdf)
        row = pdf["column"].iloc[0], c.distinct(), len(c.hashes) < KEPT, c.nulls, *((c.lo, c.hi) if c.lo <= c.hi else (None, None)), c.values
        return pd.DataFrame([row], columns=["column", "n_unique", "exact", "null_count", "lo", "hi", "first_values"])

    parts = df.select(*own, *text).mapInArrow(part, _PART).groupBy("column", "fan").applyInPandas(merge, _PART)
    return parts.groupBy("column").applyInPandas(finish, "column string, n_unique long, exact boolean, null_count long, lo double, hi double, first_values array<string>")


def detect_demographics(df: DataFrame, most: int = 20, hints: Sequence[str] = HINTS) -> DataFrame:
    """column, kind, n_unique, exact, null_count, sample_values, hinted of every column that is not reserved.

    A column of up to ``most`` values is categorical (with its first five), else numeric (with its extremes) or text (with its
    first three). ``hinted`` if its name holds one of the words.
    """
    columns = [c for c in df.columns if c not in RESERVED]
    schema = "column string, kind string, n_unique long, exact boolean, null_count long, sample_values array<string>, hinted boolean"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    kind = F.when(F.col("n_unique") <= most, "categorical").when(F.col("column").isin(numeric) if numeric else F.lit(False), "numeric").otherwise("text")
    found = profile(df, columns).withColumn("kind", kind)
    ends = F.array(F.concat(F.lit("min: "), F.col("lo").cast("string")), F.concat(F.lit("max: "), F.col("hi").cast("string")))
    sample = F.when(F.col("kind") == "categorical", F.slice("first_values", 1, 5)).when(F.col("kind") == "numeric", ends).otherwise(F.slice("first_values", 1, 3))
    hinted = F.lit(False)
    for h in hints:
        hinted = hinted | F.lower("column").contains(h)
    return found.select("column", "kind", "n_unique", "exact", "null_count", sample.alias("sample_values"), hinted.alias("hinted"))
