"""Sources that are called for rather than read: pages of an API, with resume, bounds and redaction; and URLs."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import socket
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from brindle.sources.readers import SourceError

#: client(params, page) gives (records, reported total or None); an empty page is the last.
Client = Callable[[dict[str, Any], int], tuple[list[dict[str, Any]], int | None]]
MAX_AGE, PREVIEW_PAGES = timedelta(days=1), 3


@dataclass(frozen=True)
class Fetched:
    records: list[dict[str, Any]]
    totals: list[tuple[int | None, int]]  # reported and fetched, per combination
    stopped_early: bool = False
    resumed: bool = False  # what was taken up again may be older than the rest


def scrub(value: Any, secrets: list[str], mark: str = "[redacted]") -> Any:
    """value with every occurrence of a secret in any text of it replaced."""
    if isinstance(value, str):
        for s in secrets:
            value = value.replace(s, mark) if s else value
        return value
    if isinstance(value, list):
        return [scrub(v, secrets, mark) for v in value]
    return {k: scrub(v, secrets, mark) for k, v in value.items()} if isinstance(value, dict) else value


class Fragments:
    """One file per finished combination, found again by the combination's content, for a day."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)

    def _file(self, params: dict[str, Any]) -> Path:
        return self.folder / f"{hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()}.json"

    def get(self, params: dict[str, Any]) -> tuple[list[dict], int | None] | None:
        file = self._file(params)
        if not file.is_file() or datetime.now(UTC) - datetime.fromtimestamp(file.stat().st_mtime, UTC) > MAX_AGE:
            return None
        kept = json.loads(file.read_text(encoding="utf-8"))
        return kept["records"], kept["total"]

    def put(self, params: dict[str, Any], records: list[dict], total: int | None) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        draft = self._file(params).with_suffix(".part")
        draft.write_text(json.dumps({"records": records, "total": total}, ensure_ascii=False, default=str), encoding="utf-8")
        draft.replace(self._file(params))


def fetch(client: Client, combinations: list[dict[str, Any]], fragments: Fragments | None = None, secrets: list[str] | None = None, max_rows: int | None = None) -> Fetched:
    """All pages of all combinations, in order; with max_rows, a preview that stops early and says so."""
    records, totals, resumed = [], [], False
    for params in combinations:
        kept = fragments.get(params) if fragments else None
        if kept:
            got, total = kept
            resumed = True
        else:
            got, total, page = [], None, 1
            while True:
                rows, reported = client(params, page)
                total = reported if total is None else total
                got += scrub(rows, secrets or [])
                if not rows or total is not None and len(got) >= total or max_rows is not None and (len(records) + len(got) >= max_rows or page >= PREVIEW_PAGES):
                    break
                page += 1
            if fragments and max_rows is None:
                fragments.put(params, got, total)
        records += got
        totals.append((total, len(got)))
        if max_rows is not None and len(records) >= max_rows:
            return Fetched(records[:max_rows], totals, True, resumed)
    return Fetched(records, totals, False, resumed)


class CallPartition(InputPartition):
    def __init__(self, params: dict[str, Any]) -> None:
        self.params = params


def call_source(spark: SparkSession, client: Client, combinations: list[dict[str, Any]], schema: StructType) -> DataFrame:
    """Rows of an API as a data source: one partition per combination, called on the executors, in parallel."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [CallPartition(p) for p in combinations]

        def read(self, partition: CallPartition) -> Iterator[tuple]:
            page, got = 1, 0
            while True:
                rows, total = client(partition.params, page)
                for r in rows:
                    yield tuple(r.get(f.name) for f in schema.fields)
                got += len(rows)
                if not rows or total is not None and got >= total:
                    return
                page += 1

    class Calls(DataSource):
        @classmethod
        def name(cls) -> str:
            return "brindle_calls"

        def schema(self) -> StructType:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Calls)
    return spark.read.format("brindle_calls").load()


MAX_BYTES, MAX_REDIRECTS = 20 << 20, 5


def check_url(url: str, resolve: Callable[[str], list[str]] | None = None) -> str:
    """The address to call for an https URL: public ones alone, found once, so that a name cannot change meanwhile."""
    parts = urlsplit(url)
    if parts.scheme != "https" or not parts.hostname or parts.username or parts.password or parts.port not in (None, 443):
        raise SourceError("only https URLs without credentials, on their own port")
    found = resolve(parts.hostname) if resolve else [i[4][0] for i in socket.getaddrinfo(parts.hostname, 443, proto=socket.IPPROTO_TCP)]
    if not found or any(not ipaddress.ip_address(a).is_global for a in found):
        raise SourceError(f"{parts.hostname} is no public address")
    return found[0]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: Any) -> None:
        return None


def fetch_url(url: str, timeout: float = 20) -> bytes:
    """The body of a URL, of at most MAX_BYTES, after at most MAX_REDIRECTS redirects, each of them checked."""
    opener = urllib.request.build_opener(_NoRedirect)
    for _ in range(MAX_REDIRECTS + 1):
        check_url(url)
        try:
            with opener.open(urllib.request.Request(url, method="GET"), timeout=timeout) as response:
                body = response.read(MAX_BYTES + 1)
        except urllib.error.HTTPError as error:
            if error.code not in (301, 302, 303, 307, 308) or not error.headers.get("Location"):
                raise SourceError(f"the server answered {error.code}") from error
            url = urljoin(url, error.headers["Location"])
            continue
        if len(body) > MAX_BYTES:
            raise SourceError(f"more than {MAX_BYTES} bytes")
        return body
    raise SourceError("too many redirects")
