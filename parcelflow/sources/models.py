"""Calls of a model as a source: any callable over rows, with retries, whose answers and failures are rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from parcelflow.sources.shipping import ship

ANSWERS = "id string, status string, response string, error string, attempts int"


class Client(Protocol):
    """What a provider offers; requests and answers are plain dictionaries, so tests pass a table's look-up instead."""

    def scout(self, request: dict) -> dict: ...

    def verify(self, request: dict) -> dict: ...


def error_message(error: BaseException) -> str:
    return (str(error) or type(error).__name__)[:300]


def retryable(error: BaseException) -> bool:
    return isinstance(error, TimeoutError | ConnectionError)


def answers(requests: DataFrame, call: Callable[[dict], dict], retries: int = 2) -> DataFrame:
    """ANSWERS of each row of requests (id and any columns, given to call as a dictionary), in tasks side by side.

    status is completed, timed_out or failed; what can pass by itself (time-outs, lost
    connections) is tried again so many times. response: the answer as JSON. A call may run
    again when a task is lost, so it must be safe to repeat; write the answers once and read those.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for request in pdf.to_dict("records"):
                row = {"id": str(request["id"]), "status": "failed", "response": None, "error": None, "attempts": 0}
                for attempt in range(1, retries + 2):
                    row["attempts"] = attempt
                    try:
                        row |= {"response": json.dumps(call(request)), "status": "completed", "error": None}
                        break
                    except Exception as e:  # any failure of a call is a row, not the job's end
                        row |= {"error": error_message(e), "status": "timed_out" if isinstance(e, TimeoutError) else "failed"}
                        if not retryable(e):
                            break
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    ship(requests.sparkSession)
    return requests.mapInPandas(run, ANSWERS)
