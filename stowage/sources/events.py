"""A streaming data source that polls a table of events: spark.readStream.format("event_poll").option("path", uri).

The table is a folder of Parquet files with id, level, title and created_us; other columns are left alone. A poll gives the `page`
events of the least ids after the cursor, in order; the cursor after a poll is the last id it gave, and is what the stream keeps in
its checkpoint. So each event comes once, whatever polls fail or are restarted. Events need not be stored in any order, but an id
under the cursor that is added later isn't seen, as with any cursor. Null ids are no events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "id long, level string, title string, created_us long"
COLUMNS = ["id", "level", "title", "created_us"]


class EventPoll(SimpleDataSourceStreamReader):
    def __init__(self, path: str, after: int, page: int) -> None:
        self.path, self.after, self.page = path, after, page

    def initialOffset(self) -> dict:
        return {"after": self.after}

    def _least(self, where: pc.Expression, n: int | None) -> pa.Table:
        """Rows in the order of ids, the first n; batches are looked at one by one, and no more than n rows are kept."""
        kept = None
        for batch in ds.dataset(self.path, format="parquet").to_batches(columns=COLUMNS, filter=where):
            rows = pa.Table.from_batches([batch])
            kept = rows if kept is None else pa.concat_tables([kept, rows])
            kept = kept.take(pc.sort_indices(kept, [("id", "ascending")])[:n])
        return kept if kept is not None else pa.table({c: [] for c in COLUMNS})

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._least(pc.field("id") > start["after"], self.page)
        rows = [tuple(r[c] for c in COLUMNS) for r in found.to_pylist()]
        return iter(rows), {"after": rows[-1][0] if rows else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        found = self._least((pc.field("id") > start["after"]) & (pc.field("id") <= end["after"]), None)
        return iter([tuple(r[c] for c in COLUMNS) for r in found.to_pylist()])

    def commit(self, end: dict) -> None:
        """Nothing is held for a poll that is through; the cursor is in the stream's checkpoint."""


class EventTable(DataSource):
    """Options: path; after, the cursor to begin at (0); page, events a poll (20)."""

    @classmethod
    def name(cls) -> str:
        return "event_poll"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> EventPoll:
        return EventPoll(self.options["path"], int(self.options.get("after", 0)), int(self.options.get("page", 20)))


def poll_stream(spark: SparkSession, path: str, after: int = 0, page: int = 20) -> DataFrame:
    """A stream of the events after a cursor, a page a poll."""
    spark.dataSource.register(EventTable)
    return spark.readStream.format("event_poll").option("path", path).option("after", after).option("page", page).load()
