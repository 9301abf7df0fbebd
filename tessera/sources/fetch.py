"""Pages by a caller's fetcher, with the retry policy; there is no fetcher of a network here."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .pages import FETCH


def patient(fetch: Callable[[str], tuple[str, str, int]], url: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One row of FETCH. fetch gives (html, final URL, status) or raises.

    A good answer or a 404 ends it. After a 429 it waits and tries again, after anything else it waits unless that was the
    last attempt; waits are 1, 4, 16 seconds. An error that says that something closed ends it at once.
    """
    began, error = time.monotonic(), None
    for k in range(attempts):
        try:
            html, final, status = fetch(url)
        except Exception as e:
            error = "timeout" if isinstance(e, TimeoutError) else str(e)
            if "closed" in error.lower():
                break
        else:
            if status == 404 or (status < 400 and html):
                return {"url": url, "html": html, "final_url": final, "status": status, "elapsed": time.monotonic() - began, "error": None}
            error = f"status {status}"
            if status == 429:
                sleep(4.0**k)
                continue
        if k < attempts - 1:
            sleep(4.0**k)
    return {"url": url, "html": "", "final_url": url, "status": 0, "elapsed": 0.0, "error": error}


def fetch_pages(urls: DataFrame, fetch: Callable[[str], tuple[str, str, int]], column: str = "url", attempts: int = 3) -> DataFrame:
    """A row of FETCH for each row of urls; tasks fetch the URLs of their rows one after the other."""

    def run(batches):
        for batch in batches:
            rows = [patient(fetch, u, attempts) for u in batch.column(0).to_pylist() if u is not None]
            kinds = {"url": pa.string(), "html": pa.string(), "final_url": pa.string(), "status": pa.int32(), "elapsed": pa.float64(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))

    return urls.select(column).mapInArrow(run, FETCH)
