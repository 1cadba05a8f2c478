"""Live HTTP probes of URLs, by Arrow batches with a few threads a task.  Off unless asked for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "url string, status int, error string, timed_out boolean"
AGENT = "Mozilla/5.0 (X11; Linux x86_64) weftline"


def probe(urls: DataFrame, *, timeout_ms: int = 10_000, concurrency: int = 5) -> DataFrame:
    """url, status, error, timed_out of each row of urls(url, method); HEAD falls back to GET on 404 and 405."""

    def ask(url: str, method: str) -> tuple[int | None, str | None, bool]:
        import urllib.error
        import urllib.request

        try:
            request = urllib.request.Request(url, method=method, headers={"User-Agent": AGENT, "Accept": "text/html,*/*;q=0.8"})
            with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as answer:
                return answer.status, None, False
        except urllib.error.HTTPError as e:
            return e.code, None, False
        except TimeoutError:
            return None, None, True
        except (OSError, ValueError) as e:
            return None, str(e), isinstance(getattr(e, "reason", None), TimeoutError)

    def one(row: tuple[str, str]) -> tuple[int | None, str | None, bool]:
        url, method = row
        out = ask(url, method)
        return ask(url, "GET") if method == "HEAD" and out[0] in (404, 405) else out

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                got = list(pool.map(one, rows))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.bool_())], names=["url", "status", "error", "timed_out"])

    return urls.select("url", "method").mapInArrow(run, SCHEMA)
