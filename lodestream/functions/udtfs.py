"""Table functions whose argument is a table, dealt by a key and sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Packed:
    """Rows packed, in order, into batches: one is closed when the next row would take its total over the limit.

    Each total depends on where the batch before ended, which no window function
    can say. The result has the table's own columns, `batch` (from 0 in each key)
    and `filled`, the batch's total up to the row, of the measure's type.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, measure: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument has to be a table")
        if measure.value is None or measure.value not in rows.dataType.names:
            raise ValueError("the second argument has to name a column of the table")
        if limit.value is None or not limit.value > 0:
            raise ValueError("the limit has to be over 0")
        out = StructType(list(rows.dataType.fields))
        return AnalyzeResult(schema=out.add("batch", LongType()).add("filled", rows.dataType[measure.value].dataType))

    def __init__(self):
        self.batch, self.filled = 0, None

    def eval(self, row, measure: str, limit):
        more = row[measure]
        if more is not None:
            if self.filled is not None and self.filled + more > limit:
                self.batch, self.filled = self.batch + 1, more
            else:
                self.filled = more if self.filled is None else self.filled + more
        yield (*row, self.batch, self.filled)


def packed(df: DataFrame, by: list[str], order: list[str], measure: str, limit) -> DataFrame:
    """df with batch and filled of each row within `by`, in `order`; a null measure adds nothing. A key's rows go through one task in a stream."""
    return F.udtf(Packed)(df.asTable().partitionBy(*by).orderBy(*order), F.lit(measure), F.lit(limit))
