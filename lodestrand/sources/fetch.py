"""Remote calls: retries within a budget, and the files of papers.

A call is any function from a URL to a Response, so that a test or an offline
run can hand in its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


Call = Callable[[str], Response]
#: Seconds that all waits of one request may take together, and the first wait, which doubles (fixed values).
BUDGET, FIRST_WAIT = 30.0, 1.5


class FetchError(Exception):
    def __init__(self, status: int | None, reason: str):
        super().__init__(reason)
        self.status = status


def wait_before(attempt: int, retry_after: str | None, budget: float) -> float:
    """What a server asks for if it says a number, else doubling waits; never more than what is left."""
    try:
        wanted = float(retry_after) if retry_after else FIRST_WAIT * 2**attempt
    except ValueError:
        wanted = FIRST_WAIT * 2**attempt
    return min(wanted, budget)


def fetched(call: Call, url: str, budget: float = BUDGET, sleep: Callable[[float], None] = time.sleep) -> Response:
    """The response, after retries of failed connections, of 429 and of 5xx while the budget lasts; other errors are raised at once."""
    attempt = 0
    while True:
        try:
            response, reason = call(url), None
        except OSError as e:
            response, reason = None, str(e)
        if response is not None and response.status < 400:
            return response
        status = response.status if response else None
        if status is not None and status != 429 and not 500 <= status < 600:
            raise FetchError(status, f"status {status}")
        delay = wait_before(attempt, {k.lower(): v for k, v in response.headers.items()}.get("retry-after") if response else None, budget)
        if delay <= 0:
            raise FetchError(status, reason or f"status {status}")
        sleep(delay)
        budget -= delay
        attempt += 1


def paper_urls(papers: DataFrame) -> DataFrame:
    """(paper_id, doi, url): a paper's file name, its DOI without the service's address, and its best link (null: only the DOI can help)."""
    bare = F.regexp_replace("doi", "^https?://doi[.]org/", "")
    return papers.select(F.element_at(F.split("id", "/"), -1).alias("paper_id"), T.falsy_null(bare).alias("doi"), T.best_pdf_url("best_oa_location", "primary_location", "locations").alias("url"))


def paper_files(papers: DataFrame, call: Call, by_doi: Callable[[str], str | None], cached: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(paper_id, url, content, outcome) of papers (paper_id, doi, url).

    Papers in `cached` are not fetched again. Without a link, or if the link is
    forbidden (403), the DOI service is asked once for another. outcome is
    `ok`, `no_url`, `not_pdf` (by content type) or `failed: ...`; nothing is
    passed over in silence.
    """

    def one(doi: str | None, url: str | None) -> tuple[str | None, bytes | None, str]:
        asked = False
        if not url and doi:
            url, asked = by_doi(doi), True
        while url:
            try:
                got = fetched(call, url, sleep=sleep)
            except FetchError as e:
                other = by_doi(doi) if e.status == 403 and doi and not asked else None
                asked = True
                if not other or other == url:
                    return url, None, f"failed: {e}"
                url = other
                continue
            kind = {k.lower(): v for k, v in got.headers.items()}.get("content-type", "")
            return (url, got.body, "ok") if "pdf" in kind.lower() else (url, None, "not_pdf")
        return None, None, "no_url"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *one(None if d is None or d != d else d, None if u is None or u != u else u)) for p, d, u in zip(frame["paper_id"], frame["doi"], frame["url"])]
            yield pd.DataFrame(rows, columns=["paper_id", "url", "content", "outcome"])

    todo = papers if cached is None else papers.join(cached.select("paper_id"), "paper_id", "left_anti")
    return todo.select("paper_id", "doi", "url").mapInPandas(run, "paper_id string, url string, content binary, outcome string")
