"""Paged JSON services as a Spark data source.

``spark.read.format("paged_json").schema(...).option("path", ...)`` reads result pages: each request is a partition that
follows its pages by cursor or offset until there are none or a limit is met. The transport is a folder of saved pages
(``<request>/<cursor>.json``) or, where a network is there, an HTTP endpoint with retries.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

RETRY_STATUS = frozenset({429, 500, 502, 503, 504})


def get_json(url: str, params: dict | None = None, headers: dict | None = None, timeout: float = 30.0, retries: int = 5, pause: float = 1.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> dict:
    """A JSON answer; busy and failing servers are asked again after pauses that grow evenly."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for attempt in range(1, retries + 1):
        try:
            with opener(urllib.request.Request(full, headers=headers or {}), timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if error.code not in RETRY_STATUS or attempt == retries:
                raise
        except urllib.error.URLError:
            if attempt == retries:
                raise
        sleep(pause * attempt)
    raise AssertionError("unreachable")


def follow(fetch: Callable[[str, int], dict], limit: int, page: int = 200) -> Iterator[dict]:
    """Rows of all pages: until there is no next cursor, a page is empty, or ``limit`` rows came. The last page asks for no
    more than is left."""
    cursor, left = "*", limit
    while cursor and left > 0:
        answer = fetch(cursor, min(page, left))
        rows = answer.get("results") or []
        if not rows:
            return
        yield from rows[:left]
        left -= len(rows)
        cursor = (answer.get("meta") or {}).get("next_cursor")


@dataclass(frozen=True)
class Provider:
    """A service that answers works requests page by page."""

    name: str
    endpoint: str
    headers: dict = field(default_factory=dict)

    def fetch(self, path: str, params: dict, get: Callable = get_json) -> Callable[[str, int], dict]:
        """The pages of a request, for ``follow``."""
        return lambda cursor, size: get(f"{self.endpoint}/{path.lstrip('/')}", params | {"cursor": cursor, "per_page": size}, self.headers)


def provider(name: str = "auto", endpoint: str | None = None, token: str | None = None) -> Provider:
    """The provider that a name stands for: the public works API, or a service at an endpoint of the caller's."""
    if name in ("auto", "openalex"):
        return Provider("openalex", (endpoint or "https://api.openalex.org").rstrip("/"))
    if name == "service":
        if not endpoint:
            raise ValueError("a service needs an endpoint")
        return Provider("service", endpoint.rstrip("/"), {"Authorization": f"Bearer {token}"} if token else {})
    raise ValueError(f"no provider {name}")


class _Request(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]) -> None:
        self.path, self.limit = options["path"], int(options.get("limit", 10_000))
        self.fields, self.wanted = fields, {}

    def pushFilters(self, filters):  # noqa: N802
        """Equality on top-level fields is checked while pages are read; everything else stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        return [_Request(n) for n in sorted(os.listdir(self.path))]

    def read(self, partition):
        def fetch(cursor: str, size: int) -> dict:
            name = "first" if cursor == "*" else cursor
            with open(f"{self.path}/{partition.name}/{name}.json", encoding="utf-8") as f:
                return json.load(f)

        for row in follow(fetch, self.limit):
            if all(row.get(k) == v for k, v in self.wanted.items()):
                yield tuple(row.get(c) for c in self.fields)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "id string, title string"

    def reader(self, schema):
        return PagedReader(self.options, schema.fieldNames())


def register(spark) -> None:
    """Make the source known; filters are pushed where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
