"""Answer request records as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tuneloom.operators.generate import Engine, batch_generate
from tuneloom.operators.requests import accepted, parse_requests, rejected, response_envelope
from tuneloom.streaming.sinks import batch_folder, write_per_batch


def answer_requests(requests: DataFrame, factory: Callable[[], Engine] | DataFrame, model: str,
                    max_batch: int = 8, created: int | None = None,
                    chat_style: str = "instruct") -> DataFrame:
    """Requests to response documents; unknown routes are left out."""
    asked = accepted(parse_requests(requests, chat_style))
    return response_envelope(batch_generate(asked, factory, max_batch), model, created)


def stream_score_requests(requests: DataFrame, factory: Callable[[], Engine], model: str,
                          out: str, rejects: str, checkpoint: str, max_batch: int = 8,
                          created: int | None = None) -> StreamingQuery:
    """Every micro-batch of requests is answered and written; rejects go beside it."""
    def answer(rows: DataFrame, batch_id: int) -> DataFrame:
        rejected(parse_requests(rows)).write.mode("overwrite").parquet(
            batch_folder(rejects, batch_id))
        return answer_requests(rows, factory, model, max_batch, created)

    return write_per_batch(requests, out, checkpoint, transform=answer)


