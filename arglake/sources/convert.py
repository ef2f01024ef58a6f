"""Side-effect jobs over files: download and conversion behind a pluggable function, with a status for each row."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def run_jobs(rows: DataFrame, key: str, payload: str, factory: Callable[[], Callable], tasks: int | None = None, pause: float = 0.0) -> DataFrame:
    """(key, status, output, error): ``factory`` makes one function a worker; it takes a payload and returns a text.

    A failure is a row with status 'failed'; a result of None (such as a missing file) is 'empty'.
    """
    kind = dict(rows.dtypes)[key]
    dealt = rows.select(key, payload)
    dealt = dealt.repartition(tasks, key) if tasks else dealt

    def work(frames):
        f = factory()
        for frame in frames:
            out = []
            for k, p in zip(frame[key], frame[payload]):
                try:
                    text = f(p)
                    out.append((k, "success" if text is not None else "empty", text, None))
                except Exception as e:  # one row must not fail the job
                    out.append((k, "failed", None, f"{type(e).__name__}: {e}"[:500]))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame(out, columns=[key, "status", "output", "error"])

    return dealt.mapInPandas(work, f"`{key}` {kind}, status string, output string, error string")
