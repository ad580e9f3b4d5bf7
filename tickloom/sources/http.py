"""A Python data source over paged HTTP endpoints, with an injected fetcher."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: FIXED VALUES: tries, and seconds waited after the i-th refusal.
TRIES, WAIT = 4, 8


def get(url: str, fetch: Callable[[str], str] | None = None, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> str:
    """A url's body.  Status 429 waits 8, 16, .. seconds and tries again; other errors are raised."""
    fetch = fetch or (lambda u: urlopen(u, timeout=30).read().decode())  # noqa: S310
    for i in range(tries):
        try:
            return fetch(url)
        except HTTPError as e:
            if e.code != 429 or i == tries - 1:
                raise
            sleep(WAIT * (i + 1))
    raise RuntimeError("no tries")


def history(page: Callable[[int | None], list[list]], pages: int, step: int = 60) -> dict[int, list]:
    """Pages back in time: each asks before the earliest stamp less a step; stops on an empty page; a
    later page's row replaces an earlier one of the same stamp."""
    rows: dict[int, list] = {}
    before = None
    for _ in range(pages):
        got = page(before)
        if not got:
            break
        rows.update((int(r[0]), r) for r in got)
        before = min(int(r[0]) for r in got) - step
    return rows


def pages_until_last(url: str, get_: Callable[[str], str] | None = None, most: int = 10_000) -> list[tuple[int, str]]:
    """(page number, payload) of ``url`` with {page} from 0 on, as long as a payload says page.hasNextPage."""
    out: list[tuple[int, str]] = []
    for number in range(most):
        payload = (get_ or get)(url.format(page=number))
        out.append((number, payload))
        if not (json.loads(payload).get("page") or {}).get("hasNextPage"):
            return out
    raise RuntimeError(f"over {most} pages")


class _Url(InputPartition):
    def __init__(self, number: int, url: str):
        self.number, self.url = number, url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]

    def partitions(self) -> list[_Url]:
        return [_Url(i, u) for i, u in enumerate(self.urls)]

    def read(self, partition: _Url) -> Iterator[tuple]:
        yield partition.number, partition.url, get(partition.url)


class PagedJson(DataSource):
    """spark.read.format("paged_json").option("urls", "one url a line").load(): (page_no, url, payload),
    one task a page.  file: urls work offline."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page_no int, url string, payload string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
