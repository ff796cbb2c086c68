"""External calls (language models, searches, reachability) as one operator with an injected client."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A client maker is called once per task: it returns a function from prompt to answer.
Client = Callable[[], Callable[[str], str]]


def stub() -> Callable[[str], str]:
    """Deterministic client for tests and dry runs."""
    return lambda prompt: "stub:" + hashlib.md5(prompt.encode()).hexdigest()


# Answers of a server after which a call is worth another try; seconds between tries.
RETRY_CODES = (429, 500, 502, 503, 504)
WAIT, WAIT_MOST = 2.0, 16.0


def is_retryable(e: BaseException) -> bool:
    """Timeouts, lost connections, and errors that carry one of the codes, as ``status_code`` or in "API <code>"."""
    if isinstance(e, (TimeoutError, ConnectionError)) or type(e).__name__ in ("TimeoutException", "ConnectError", "APITimeoutError", "APIConnectionError"):
        return True
    return getattr(e, "status_code", None) in RETRY_CODES or isinstance(e, RuntimeError) and any(f"API {c}" in str(e) for c in RETRY_CODES)


def with_retry(call: Callable[[str], str], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Up to ``attempts`` tries, waits doubling from two to sixteen seconds."""

    def run(prompt: str) -> str:
        for i in range(attempts):
            try:
                return call(prompt)
            except Exception as e:
                if i == attempts - 1 or not is_retryable(e):
                    raise
                sleep(min(WAIT_MOST, WAIT * 2**i))
        return ""

    return run


def answered(df: DataFrame, prompt: str, client: Client, cache: DataFrame | None = None) -> DataFrame:
    """(prompt_hash, answer) of each distinct prompt; prompts in ``cache`` (prompt_hash, answer) are not sent again,
    so a task that runs twice costs nothing where earlier answers were stored. Null prompts are left out."""
    todo = df.where(F.col(prompt).isNotNull()).select(F.md5(prompt).alias("prompt_hash"), F.col(prompt).alias("p")).dropDuplicates(["prompt_hash"])
    if cache is not None:
        todo = todo.join(cache.select("prompt_hash"), "prompt_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = with_retry(client())
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([call(p) for p in b.column(1).to_pylist()], pa.string())], names=["prompt_hash", "answer"])

    new = todo.mapInArrow(run, "prompt_hash string, answer string")
    return new if cache is None else new.unionByName(cache.select("prompt_hash", "answer"))
