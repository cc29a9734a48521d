"""Places and running sums over an order of all rows, made in many tasks.

Rows are sorted by range over all tasks and written once. A window runs inside each sorted part; what lies before a part are
the sums of earlier parts, one small row each, so no window holds the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanguard.session import scratch

_PART, _ROW = "_part", "_row"


class Ordered:
    """A table sorted by ``order``, written in parts; ``sums`` are columns of whole numbers to add up along the order.

    Make the order total where places must be the same in every run: rows equal in it come in any order.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()):
        self.columns, self.sums = df.columns, list(sums)
        spark, path = df.sparkSession, scratch(df.sparkSession, "ordered")
        # The number within a part grows with the rows of one task: it numbers them as they lie.
        sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
        numbered = sorted_rows.withColumn(_PART, F.spark_partition_id()).withColumn(_ROW, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        numbered.write.parquet(path)
        self.rows = spark.read.schema(numbered.schema).parquet(path)
        totals = self.rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in self.sums])
        self.parts = []  # (part, rows before it, rows in it, sums before it); as many as sorted parts
        before, added = 0, [0] * len(self.sums)
        for row in sorted(totals.collect(), key=lambda r: r[_PART]):
            self.parts.append((row[_PART], before, row["n"], list(added)))
            before += row["n"]
            added = [a + int(row[c]) for a, c in zip(added, self.sums)]
        self.total, self.totals = before, dict(zip(self.sums, added))

    def _ahead(self, values: Sequence[int], kind: str = "bigint") -> Column:
        """What lies before the part of a row; a lookup by part number."""
        if not self.parts:
            return F.lit(0).cast(kind)
        listed = dict(zip((p[0] for p in self.parts), values))
        known = F.array(*[F.lit(str(listed.get(i, 0))).cast(kind) for i in range(max(listed) + 1)])
        return F.get(known, F.col(_PART))

    def placed(self, place: str = "place", running: dict[str, str] | None = None) -> DataFrame:
        """All rows with their place from 0 and, by output name, sums of columns up to and with the row."""
        out = self.rows.withColumn(place, self._ahead([p[1] for p in self.parts]) + F.col(_ROW))
        inside = Window.partitionBy(_PART).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
        for output, column in (running or {}).items():
            at = self.sums.index(column)
            own = F.coalesce(F.sum(column).over(inside), F.lit(0)).cast("decimal(38,0)")
            out = out.withColumn(output, self._ahead([p[3][at] for p in self.parts], "decimal(38,0)") + own)
        return out.select(*self.columns, place, *(running or {}))

    def between(self, first: int, after: int, place: str = "place") -> DataFrame:
        """The rows with places from ``first`` to ``after`` - 1; other parts are not read, their row groups are left out."""
        held = [p for p in self.parts if p[1] < after and first < p[1] + p[2]]
        if not held:
            return self.rows.where(F.lit(False)).select(*self.columns, F.lit(0).cast("bigint").alias(place))
        wanted = F.lit(False)
        for part, before, size, _ in held:
            wanted = wanted | ((F.col(_PART) == part) & F.col(_ROW).between(max(0, first - before), min(size, after - before) - 1))
        return self.rows.where(wanted).withColumn(place, self._ahead([p[1] for p in self.parts]) + F.col(_ROW)).select(*self.columns, place)
