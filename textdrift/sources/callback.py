"""A user's function as a table or a stream (F2).

``poll(feed, number)`` gives what feed ``feed`` observed at its poll ``number``
(both from 0): a dict, a list of dicts, a pandas DataFrame, or None for
nothing.  Missing columns are null, further ones are left out.  ``polls()``
says how many polls can be read by now.

Every (feed, poll) is one input partition and is read by a task, so nothing
passes through the driver but numbers.  A task or a micro-batch that runs again
asks for the same (feed, poll), which must give the same rows; the stream's
offset is the number of polls read, and a micro-batch takes the polls that came
since the one before.  A poll's rows are held together by its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Poll = Callable[[int, int], "dict | list[dict] | pd.DataFrame | None"]


def as_batch(found: dict | list[dict] | pd.DataFrame | None, schema: pa.Schema) -> pa.RecordBatch:
    """What a poll gave as rows of ``schema``."""
    if isinstance(found, pd.DataFrame):
        return pa.RecordBatch.from_pandas(found.reindex(columns=schema.names), schema=schema, preserve_index=False)
    rows = [] if found is None else [found] if isinstance(found, dict) else list(found)
    columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def callback_source(poll: Poll, polls: Callable[[], int], schema: StructType | str, feeds: int = 1,
                    name: str = "textdrift_callback") -> type[DataSource]:
    """The data source class of a callback, for ``spark.dataSource.register``."""

    def parts(start: int, end: int) -> list[InputPartition]:
        return [InputPartition((feed, number)) for number in range(start, end) for feed in range(feeds)]

    def rows(fields: StructType, part: InputPartition) -> Iterator[pa.RecordBatch]:
        # Arrow keeps instants in UTC; a timestamp without a zone is taken as UTC
        yield as_batch(poll(*part.value), to_arrow_schema(fields))

    class Reader(DataSourceReader):
        def __init__(self, fields: StructType) -> None:
            self.fields = fields

        def partitions(self) -> list[InputPartition]:
            return parts(0, polls())

        def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
            # without polls Spark still asks once, for no partition
            return rows(self.fields, partition) if partition is not None else iter(())

    class StreamReader(DataSourceStreamReader):
        def __init__(self, fields: StructType) -> None:
            self.fields = fields

        def initialOffset(self) -> dict:
            return {"polls": 0}

        def latestOffset(self) -> dict:
            return {"polls": polls()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return parts(start["polls"], end["polls"])

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            return rows(self.fields, partition)

    class Callback(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType | str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return StreamReader(schema)

    return Callback


def read_callback(spark: SparkSession, source: type[DataSource], stream: bool = False) -> DataFrame:
    """All polls so far as a table, or the polls as a stream."""
    spark.dataSource.register(source)
    return (spark.readStream if stream else spark.read).format(source.name()).load()
