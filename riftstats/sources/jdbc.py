"""Reading tables of a running database, in parallel and piece by piece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import VersionedTable

#: Rows that a connection fetches at a time; error of the quantiles, as a share of
#: a range.
FETCH_ROWS, QUANTILE_ERROR = 10_000, 0.05


class Source:
    """A database: its URL and the properties of connections (driver, user and so
    on)."""

    def __init__(self, spark: SparkSession, url: str, **properties: str):
        self.spark, self.url = spark, url
        self.properties = {"fetchsize": str(FETCH_ROWS), **properties}

    def query(self, text: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, query=text, **self.properties).load()

    def where(self, table: str, predicates: list[str]) -> DataFrame:
        """A table's rows, a partition for each predicate; columns and filters that
        are asked of the result are pushed down as well."""
        return self.spark.read.jdbc(self.url, table, predicates=predicates, properties=self.properties)

    def ranges(self, table: str, key: str, parts: int, above: int | None = None, upto: int | None = None) -> list[str]:
        """Predicates that cut the rows with above < key <= upto into parts of about
        the same number of rows, wherever keys are dense. The keys alone are read for
        this, over ranges of equal width."""
        lo = f"{key} > {above}" if above is not None else f"{key} IS NOT NULL"
        ends = self.query(f"SELECT MIN({key}) AS a, MAX({key}) AS b FROM {table} WHERE {lo}" + (f" AND {key} <= {upto}" if upto is not None else "")).first()
        first, last = (None if x is None else int(x) for x in ends)
        if first is None:
            return []
        width = (last - first) // parts + 1
        wide = [f"{key} >= {first + i * width} AND {key} < {first + (i + 1) * width}" for i in range(parts) if first + i * width <= last]
        keys = self.where(table, [f"{p} AND {key} <= {last}" for p in wide]).select(F.col(key).cast("long").alias("k"))
        shares = [i / parts for i in range(1, parts)]
        cuts = sorted(set(keys.agg(F.percentile_approx("k", shares, int(parts / QUANTILE_ERROR))).first()[0])) if shares else []
        edges = [first - 1, *[c for c in cuts if first <= c < last], last]
        return [f"{key} > {a} AND {key} <= {b}" for a, b in zip(edges, edges[1:], strict=False)]

    def table(self, table: str, key: str, parts: int) -> DataFrame:
        """A whole table, also rows without a key."""
        return self.where(table, [*self.ranges(table, key, parts), f"{key} IS NULL"])

    def land_new(self, table: str, key: str, sink: VersionedTable, parts: int) -> int | None:
        """Appends the rows whose key (which only grows) is above the sink's
        high-water mark, up to the highest there is now, and moves the mark: it is the
        sink's label, so that rows and mark are switched together, and a run that
        stops before starts again where it was. Returns the mark, None if there was
        nothing new."""
        mark = sink.pointer()["label"]
        above = None if mark < 0 else mark
        top = self.query(f"SELECT MAX({key}) AS b FROM {table}").first()[0]
        if top is None or (above is not None and int(top) <= above):
            return None
        sink.append(self.where(table, self.ranges(table, key, parts, above, int(top))), int(top))
        return int(top)
