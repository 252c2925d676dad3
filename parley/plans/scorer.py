"""A re-ranking service as a scorer: clients made when first needed, a time limit, second attempts; what fails has no answer.

Requests are asked on the executors, each worker through a client of its own. A request without an answer keeps the
order that it had, and is asked again by a later run, as nothing is kept for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.memo import SCHEMA

#: (prompt, ids) to (ids in order, prompt tokens, completion tokens).
Client = Callable[[str, Sequence[str]], tuple[list[str], int, int]]
ANSWER = pa.schema([("key", pa.string()), ("ranked", pa.list_(pa.string())), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64())])


def answered(client: Client, prompt: str, ids: Sequence[str], attempts: int, seconds: float) -> tuple[list[str], int, int] | None:
    """What the client answers within the time, or None: after `attempts` failures, or if the answer is no list of ids."""
    for _ in range(attempts):
        pool = ThreadPoolExecutor(1)
        try:
            ranked, asked, told = pool.submit(client, prompt, ids).result(seconds)
        except Exception:  # a service may raise anything, and time may run out
            continue
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if isinstance(ranked, list) and all(isinstance(x, str) for x in ranked):
            return ranked, int(asked or 0), int(told or 0)
        return None
    return None


def calling(make_client: Callable[[], Client], attempts: int = 2, seconds: float = 20.0) -> Callable[[DataFrame], DataFrame]:
    """A scorer of requests (key, ids, prompt). A worker whose client cannot be made answers nothing and tries no more."""

    def score(requests: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client, able = None, True
            for batch in batches:
                out = []
                for key, ids, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not ids or not able:
                        continue
                    if client is None:
                        try:
                            client = make_client()
                        except Exception:  # no key, no library, no connection
                            able = False
                            continue
                    if (found := answered(client, prompt, ids, attempts, seconds)) is not None:
                        out.append((key, *found))
                columns = list(zip(*out, strict=True)) or [[]] * len(ANSWER)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ANSWER, strict=True)], schema=ANSWER)

        return requests.select("key", "ids", "prompt").mapInArrow(run, SCHEMA)

    return score
