"""Models kept up to date by Structured Streaming: every micro-batch is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keep_fitted(model, stream: DataFrame, checkpoint: str, **trigger):
    """Feeds micro-batches to model.partial_fit (MiniBatchKMeans, GaussianNB); returns the running query."""

    def learn(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            model.partial_fit(batch)

    writer = stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()
