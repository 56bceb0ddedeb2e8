"""A sequential file as a stream: batches are appended, seen at once, and merged into the main part later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Catalog


def append_and_compact(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to the table; readers see it at once, and the catalog merges parts into a snapshot in key
    order when enough have come.  A batch that is delivered again replaces its own part, or is passed over if the parts
    have been merged since: the last batch's number is kept with the table."""

    def batch(df: DataFrame, epoch: int) -> None:
        own = catalog.entry(table)
        done = int(own.source.rpartition(" ")[2]) if own.source.startswith("epoch ") else -1
        if epoch > done:
            own.source = f"epoch {epoch}"  # persisted with the part
            catalog.append(table, df, f"{catalog.root}/{table}/epoch-{epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
