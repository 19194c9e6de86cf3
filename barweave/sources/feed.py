"""A recorded tick feed as a stream with offsets.

The feed is a folder of folders of Parquet segments whose names rise with time. A folder counts once its ``_SUCCESS`` is there and
never changes then. An offset is a segment and a number of its rows, so a stream that stops anywhere, and is started again on its
checkpoint, reads on from there, and a batch that failed is read again row for row. A batch is dealt to tasks by ranges of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, price double, volume double, ts timestamp, event_id long"
COLUMNS = ["symbol", "price", "volume", "ts", "event_id"]


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``end`` (not included) of a segment."""

    path: str
    first: int
    end: int


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows_per_task", 1_000_000))

    def _store(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _segments(self) -> list[str]:
        store, root = self._store()
        done = [x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not x.is_file and store.get_file_info(f"{x.path}/_SUCCESS").is_file]
        found = [x for folder in done for x in store.get_file_info(fs.FileSelector(folder)) if x.is_file and x.base_name.endswith(".parquet")]
        return sorted("/".join(x.path.rsplit("/", 2)[-2:]) for x in found)

    def _size(self, segment: str) -> int:
        store, root = self._store()
        with store.open_input_file(f"{root}/{segment}") as file:
            return pq.read_metadata(file).num_rows

    def initialOffset(self) -> dict:
        return {"segment": "", "row": 0}

    def latestOffset(self) -> dict:
        segments = self._segments()
        return {"segment": segments[-1], "row": self._size(segments[-1])} if segments else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        _, root = self._store()
        out = []
        for segment in self._segments():
            if start["segment"] <= segment <= end["segment"]:
                first = start["row"] if segment == start["segment"] else 0
                last = end["row"] if segment == end["segment"] else self._size(segment)
                out += [Rows(f"{root}/{segment}", i, min(i + self.rows, last)) for i in range(first, last, self.rows)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as opened:
            file, before = pq.ParquetFile(opened), 0
            for group in range(file.metadata.num_row_groups):
                size = file.metadata.row_group(group).num_rows
                first, end = max(partition.first - before, 0), min(partition.end - before, size)
                before += size
                if first < end:
                    table = file.read_row_group(group, columns=COLUMNS).slice(first, end - first)
                    table = table.set_column(3, "ts", table["ts"].cast(pa.timestamp("us", "UTC")))
                    yield from table.to_batches(max_chunksize=65_536)


class TickFeed(DataSource):
    """Options: path, rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "tick_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def tick_feed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The feed under ``path`` as a stream of ticks."""
    spark.dataSource.register(TickFeed)
    return spark.readStream.format("tick_feed").options(path=path, **options).load()


def record_ticks(ticks: DataFrame, path: str, number: int = 0, segments: int = 8) -> None:
    """Writes ticks as folder ``number`` of a feed, in the order of their times."""
    ordered = ticks.select(*COLUMNS).repartitionByRange(segments, "ts", "event_id").sortWithinPartitions("ts", "event_id")
    ordered.write.parquet(f"{path}/{number:08d}")
