"""Market data providers behind one data source.

A provider gives pages; a page is fetched by one task as rows of text, in whatever columns the provider has. The adapter
makes bars of them: one partition a page, only pages that can hold what is asked for (bounds on `start` are pushed down),
and a row that can't be read stays, with `error` and the text that came, so that raw data can be judged again.

    spark.dataSource.register(Bars)
    spark.read.format("bars").option("provider", "order_lines").option("location", path).load()
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "instrument bigint, start timestamp_ntz, open double, high double, low double, close double, volume bigint, reference string, error string, payload string"
_NUMBERS = {"instrument": pa.int64(), "open": pa.float64(), "high": pa.float64(), "low": pa.float64(), "close": pa.float64(), "volume": pa.int64()}


@dataclass
class Page(InputPartition):
    """A provider's page, and the first and last instants that it may hold (null: unknown)."""

    number: int
    first: dt.datetime | None = None
    last: dt.datetime | None = None


class Provider(Protocol):
    """`pages` lists what there is without fetching it; `fetch` gives a page as text columns named as in SCHEMA."""

    def pages(self) -> list[Page]: ...

    def fetch(self, page: Page) -> Iterator[pa.RecordBatch]: ...


class OrderLines:
    """A file of order lines as a provider: a page is a row group, a bar is a line at its unit price."""

    _COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]

    def __init__(self, location: str):
        self.location = location

    def _file(self):
        from pyarrow import parquet

        if "://" in self.location or self.location.startswith("file:"):
            from pyarrow.fs import FileSystem

            files, path = FileSystem.from_uri(self.location)
            return parquet.ParquetFile(files.open_input_file(path))
        return parquet.ParquetFile(self.location)

    def pages(self) -> list[Page]:
        about = self._file().metadata
        at = about.schema.names.index("l_shipdate")
        found = []
        for k in range(about.num_row_groups):
            said = about.row_group(k).column(at).statistics
            found.append(Page(k, said.min, said.max) if said and said.has_min_max else Page(k))
        return found

    def fetch(self, page: Page) -> Iterator[pa.RecordBatch]:
        for batch in self._file().iter_batches(row_groups=[page.number], columns=self._COLUMNS):
            line = {n: batch.column(n) for n in self._COLUMNS}
            text = lambda x: pc.cast(x, pa.string())
            unit = text(pc.divide(line["l_extendedprice"], line["l_quantity"]))
            high = pc.if_else(pc.greater_equal(line["l_discount"], 0.09), pa.scalar("n/a"), unit)  # such lines have no high
            columns = {"instrument": text(line["l_partkey"]), "start": text(line["l_shipdate"]), "open": unit, "high": high, "low": unit, "close": unit, "volume": text(pc.cast(line["l_quantity"], pa.int64())), "reference": pc.binary_join_element_wise(text(line["l_orderkey"]), text(line["l_linenumber"]), "-")}
            yield pa.RecordBatch.from_pydict(columns)


PROVIDERS: dict[str, type] = {"order_lines": OrderLines}


def _read(x: pa.Array, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """A text column as a kind, null where it can't be read, and where that is so."""
    try:
        return pc.cast(x, kind), pa.array([False] * len(x))
    except pa.ArrowInvalid:
        out = []
        for v in x.to_pylist():  # only batches with such rows
            try:
                out.append(pc.cast(pa.array([v], pa.string()), kind)[0].as_py())
            except pa.ArrowInvalid:
                out.append(None)
        made = pa.array(out, kind)
        return made, pc.and_(pc.is_null(made), pc.is_valid(x))


def bars_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A provider's text as bars; `error` names the columns of a row that can't be read, and `payload` is the row then."""
    n = batch.num_rows
    wrong: dict[str, pa.Array] = {}
    columns = {}
    for name, kind in {**_NUMBERS, "start": pa.timestamp("us")}.items():
        columns[name], wrong[name] = _read(batch.column(name), kind)
    errors: list[str | None] = [None] * n
    payloads: list[str | None] = [None] * n
    for name in sorted(wrong):
        for i in pc.indices_nonzero(wrong[name]).to_pylist():
            errors[i] = f"{errors[i]},{name}" if errors[i] else name
    bad = [i for i, e in enumerate(errors) if e]
    for i, row in zip(bad, batch.take(pa.array(bad, pa.int64())).to_pylist(), strict=True):
        payloads[i] = "|".join("" if v is None else v for v in row.values())
    columns |= {"reference": batch.column("reference"), "error": pa.array(errors, pa.string()), "payload": pa.array(payloads, pa.string())}
    order = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in order], order)


class _Reader(DataSourceReader):
    def __init__(self, provider: Provider):
        self.provider = provider
        self.first: dt.datetime | None = None
        self.last: dt.datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on `start` choose pages; Spark applies all filters again, as a page holds other rows too."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("start",) and isinstance(value, dt.datetime):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first or value, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last or value, value)
            yield f

    def partitions(self) -> list[Page]:
        """Pages without known bounds are always read."""
        return [p for p in self.provider.pages() if (self.first is None or p.last is None or p.last >= self.first) and (self.last is None or p.first is None or p.first <= self.last)] or [Page(-1)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition.number >= 0:
            for batch in self.provider.fetch(partition):
                yield bars_of(batch)


class Bars(DataSource):
    """Options: provider (a name in PROVIDERS) and location."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        name, location = self.options.get("provider"), self.options.get("location")
        if name not in PROVIDERS or not location:
            raise ValueError(f"bars need a location and one of the providers {sorted(PROVIDERS)}, not {name!r}")
        return _Reader(PROVIDERS[name](location))


def register(spark: SparkSession) -> None:
    """Makes the format `bars` known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bars)
