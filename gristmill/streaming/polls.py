"""Polls of repositories as a stream: moved heads and unreviewed pulls of each round, a fault of one repository kept to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gristmill.operators import activity


def poll_rounds(rounds: DataFrame, repositories: Callable[[], DataFrame], reviews: Callable[[], DataFrame], path: str, checkpoint: str):
    """A stream of what was polled (repo_id, head, pulls, fault; see :func:`gristmill.operators.activity.polled`), its outcomes appended to the Parquet table ``path``.

    ``repositories`` and ``reviews`` are asked anew for each round, as they change between rounds. A round that runs again writes its own folder anew.
    """

    def outcome(batch: DataFrame, number: int) -> None:
        activity.polled(batch, repositories(), reviews()).write.mode("overwrite").parquet(f"{path}/round={number}")

    return rounds.writeStream.foreachBatch(outcome).option("checkpointLocation", checkpoint)
