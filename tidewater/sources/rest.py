"""Paged REST sources: a client with bounded retries, offset and cursor paging,
and a Python data source so pages can be read as a DataFrame."""

from __future__ import annotations

import datetime
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ApiError(RuntimeError):
    pass


class TransportError(RuntimeError):
    """The request didn't get an answer."""


@dataclass
class Response:
    status: int
    body: bytes
    headers: dict[str, str]


class Client:
    """GET with at most ``attempts`` tries, exponential backoff with jitter, a
    capped numeric Retry-After, an overall deadline and a request rate limit."""

    def __init__(self, send: Callable[[str, dict], Response], attempts: int = 5, base_s: float = 0.5, cap_s: float = 30.0, deadline_s: float = 120.0, per_second: float | None = None, clock=time.monotonic, sleep=time.sleep, rng: random.Random | None = None):
        self.send, self.attempts, self.base, self.cap, self.deadline = send, attempts, base_s, cap_s, deadline_s
        self.gap, self.clock, self.sleep, self.rng = 1 / per_second if per_second else 0.0, clock, sleep, rng or random.Random()
        self.next_at = 0.0

    def _wait(self, n: int, response: Response | None) -> float:
        told = (response.headers.get("Retry-After", "") if response else "").strip()
        if told.replace(".", "", 1).isdigit():
            return min(float(told), self.cap)
        return min(self.base * 2**n, self.cap) * (0.5 + self.rng.random() / 2)

    def get(self, path: str, params: dict) -> dict:
        began = self.clock()
        for n in range(self.attempts):
            if (ahead := self.next_at - self.clock()) > 0:
                self.sleep(ahead)
            self.next_at = self.clock() + self.gap
            response, why = None, ""
            try:
                response = self.send(path, params)
                if response.status == 200:
                    return json.loads(response.body)
                why = f"status {response.status}"
                if response.status != 429 and response.status < 500:
                    raise ApiError(f"{path}: {why}")
            except TransportError as e:
                why = str(e)
            wait = self._wait(n, response)
            if n + 1 == self.attempts or self.clock() - began + wait > self.deadline:
                raise ApiError(f"{path}: gave up after {n + 1} attempts, last {why}")
            self.sleep(wait)
        raise ApiError(f"{path}: no attempts allowed")


def offset_pages(get: Callable[[dict], dict], field: str, size: int = 100) -> Iterator[dict]:
    """Numbered pages until one is empty or the announced total is reached."""
    page = 1
    while True:
        body = get({"page": page, "page_size": size})
        if not isinstance(body.get(field), list):
            raise ApiError(f"page {page} has no list of {field}")
        if not body[field]:
            return
        yield body
        if page * size >= body.get("total_count", float("inf")):
            return
        page += 1


def cursor_pages(get: Callable[[dict], dict], field: str, day: datetime.date) -> Iterator[dict]:
    """Pages by cursor of what changed since the day before ``day``; an empty
    page that names a next one is an error, as is a cursor that comes again."""
    params, seen = {"updated_since": (day - datetime.timedelta(days=1)).isoformat()}, set()
    while True:
        body = get(params)
        if not isinstance(body.get(field), list):
            raise ApiError(f"no list of {field}")
        cursor = body.get("next_cursor")
        if cursor and (not body[field] or cursor in seen):
            raise ApiError("an empty page or a known cursor names a next page")
        if body[field]:
            yield body
        if not cursor:
            return
        seen.add(cursor)
        params = params | {"cursor": cursor}


@dataclass
class _Page(InputPartition):
    number: int


def page_source(name: str, schema: str, field: str, fetch: Callable[[int], dict], pages: int) -> type[DataSource]:
    """A batch data source of a paged API: one partition a page, fetched where
    the task runs. ``fetch`` travels with the class."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Page(k) for k in range(1, pages + 1)]

        def read(self, partition):
            columns = [c.split()[0] for c in schema.split(",")]
            for record in fetch(partition.number)[field]:
                yield tuple(record[c] for c in columns)

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Pages


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)
