"""A Python data source for OAI-PMH harvests: batch, streaming with the resumption token as offset, and streaming by date windows in parallel."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader


def fetch(url: str, retries: int = 5, wait: float = 5.0, get: Callable[[str], bytes] | None = None, sleep=time.sleep) -> bytes:
    """GET with a wait of ``wait`` * n seconds before the n-th retry."""
    get = get or (lambda u: urllib.request.urlopen(u, timeout=60).read())
    for n in range(retries + 1):
        try:
            return get(url)
        except OSError:
            if n == retries:
                raise
            sleep(wait * (n + 1))
    raise AssertionError


def page_url(server: str, options: dict, token: str = "") -> str:
    query = {"verb": "ListRecords"}
    if token:
        query["resumptionToken"] = token
    else:
        query["metadataPrefix"] = options.get("prefix", "oai_dc")
        query |= {k: options[o] for k, o in (("from", "from"), ("until", "until"), ("set", "set")) if options.get(o)}
    return f"{server}?{urllib.parse.urlencode(query)}"


def read_page(data: bytes) -> tuple[list[tuple[str, str]], str]:
    """([(identifier, record as XML)], resumption token)."""
    root = ET.fromstring(data)
    local = lambda e: e.tag.rpartition("}")[2]
    records, token = [], ""
    for e in root.iter():
        if local(e) == "record":
            ident = next((x.text or "" for x in e.iter() if local(x) == "identifier"), "")
            records.append((ident, ET.tostring(e, encoding="unicode")))
        elif local(e) == "resumptionToken":
            token = (e.text or "").strip()
    return records, token


class HarvestSource(DataSource):
    """``spark.read.format("oai").option("url", ...)``: (identifier, xml).

    As a stream with the options ``windows`` (``from/until`` pairs, by commas) and ``state`` (a folder that driver and tasks
    share), windows load in parallel, up to ``pages`` (1) of each a batch; else one window, a page a batch.
    """

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return "identifier string, xml string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        options = dict(self.options)
        if "windows" not in options:
            raise NotImplementedError  # Spark then takes the simple reader
        return _Windows(options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        token, first = "", True
        while first or token:
            records, token = read_page(fetch(page_url(self.options["url"], self.options, token)))
            yield from records
            first = False


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"token": "", "page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["page"] and not start["token"]:
            return iter([]), start
        records, token = read_page(fetch(page_url(self.options["url"], self.options, start["token"])))
        return iter(records), {"token": token, "page": start["page"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]


class _Pages(InputPartition):
    def __init__(self, window: int, start: int, end: int):
        self.window, self.start, self.end = window, start, end


class _Windows(DataSourceStreamReader):
    """A task for each date window; the offset has the page that each window has come to, and whether it is the last.

    A page's resumption token is known only once the page before was read, by a task: it leaves the token in the ``state``
    folder, under window and page.  Only batches whose offsets Spark has logged write there, and a batch that runs again
    asks for the same pages and leaves the same tokens, so that a restart loses and repeats nothing.
    """

    def __init__(self, options: dict):
        self.options, self.state, self.pages = options, options["state"].removeprefix("file://"), int(options.get("pages", 1))
        self.windows = [tuple(w.strip().split("/")) for w in options["windows"].split(",")]

    def _token_file(self, window: int, page: int) -> str:
        return f"{self.state}/window={window}/{page:09d}.json"

    def _leave(self, window: int, page: int, token: str) -> None:
        path = self._token_file(window, page)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{os.getpid()}.{time.time_ns()}"
        with open(draft, "w") as f:
            json.dump({"page": page, "token": token}, f)
        os.replace(draft, path)

    def _come_to(self, window: int) -> dict:
        """The last page whose token is known: {"page": pages read, "token": that of the next, empty after the last}."""
        folder = f"{self.state}/window={window}"
        known = sorted(n for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []
        if not known:
            return {"page": 0, "token": None}
        with open(f"{folder}/{known[-1]}") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {str(w): {"page": 0, "last": False} for w in range(len(self.windows))}

    def latestOffset(self) -> dict:
        out = {}
        for w in range(len(self.windows)):
            at = self._come_to(w)
            done = at["token"] == ""
            out[str(w)] = {"page": at["page"] + (0 if done else self.pages), "last": done}
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Pages(int(w), start[w]["page"], end[w]["page"]) for w in sorted(end, key=int) if end[w]["page"] > start[w]["page"]]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        since, until = self.windows[partition.window]
        options, token = self.options | {"from": since, "until": until}, ""
        if partition.start:
            with open(self._token_file(partition.window, partition.start)) as f:
                token = json.load(f)["token"]
            if not token:
                return
        for page in range(partition.start, partition.end):
            records, token = read_page(fetch(page_url(options["url"], options, token)))
            yield from records
            if not token:
                break
        # a window that ended early has come to the end of what the batch was to read
        self._leave(partition.window, partition.end, token)

    def commit(self, end: dict) -> None:
        """Tokens before the committed pages are no longer needed, but for those of the batch that may run again."""
        for w, at in end.items():
            folder = f"{self.state}/window={w}"
            for n in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                if n.endswith(".json") and int(n.removesuffix(".json")) < at["page"] - 2 * self.pages:
                    os.remove(f"{folder}/{n}")
