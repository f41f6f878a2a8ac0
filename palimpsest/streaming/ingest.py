"""Structured Streaming into versioned tables: each micro-batch is one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.plans.types import of_spark
from palimpsest.session import Session


def into_table(stream: DataFrame, session: Session, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ``stream`` to ``table``. A batch that runs again after a failure is skipped if it was published.

    The number of the last batch is kept in the manifest, in the same atomic write as its rows, so each row is stored
    exactly once. ``trigger`` goes to ``DataStreamWriter.trigger``.
    """
    columns = [(f.name, of_spark(f.dataType)) for f in stream.schema]

    def publish(batch: DataFrame, number: int) -> None:
        manifest = session.store.latest()
        done = manifest.setdefault("streams", {})
        if done.get(checkpoint, -1) >= number:
            return
        session.tick()
        session.manifest = manifest
        session.check_names(table, [n for n, _ in columns])
        session.store.append(manifest, table, batch, columns, session.now())
        done[checkpoint] = number
        session.store.publish(manifest, session.now())

    out = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
