"""OAI-PMH as a Python data source, batch and stream: one partition a source, resumption tokens, retries, skipping of bad pages, and records
without fields asked for once more in plain Dublin Core.

spark.dataSource.register(OaiSource); spark.read.format("oai").options(sources=json, fetch="module:function").load(). Rows are
(source_id, metadata_prefix, seq, xml). `fetch(url, timeout) -> bytes` is an importable function; without the option pages are fetched over
HTTP. With retries=3 a failed page is fetched again, after wait, 2 * wait, ... seconds and a call of `warm` ("module:function", which renews a
session); fallback=true asks for the plain form of records that came empty. A "dir:/path/{id}" address reads pages 0.xml, 1.xml, ... of a folder, for offline replays and tests.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

OAI = "{http://www.openarchives.org/OAI/2.0/}"
SCHEMA = "source_id string, metadata_prefix string, seq bigint, xml string"
TIMEOUTS = (120, 240)
MOST_SKIPS = 50


@dataclass
class SourcePartition(InputPartition):
    source: dict
    from_date: str | None = None


def http(url: str, timeout: float) -> bytes:
    with urlopen(Request(url, headers={"User-Agent": "quillon-harvester"}), timeout=timeout) as r:  # noqa: S310
        return r.read()


class Retrying:
    """A fetcher that tries again, waits longer each time and warms its session up anew before it does."""

    def __init__(self, fetch: Callable[[str, float], bytes], retries: int = 3, wait: float = 2.0, warm: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.retries, self.wait, self.warm, self.sleep = fetch, retries, wait, warm, sleep

    def __call__(self, url: str, timeout: float) -> bytes:
        for n in range(1, self.retries + 1):
            try:
                return self.fetch(url, timeout)
            except OSError:
                if n == self.retries:
                    raise
                self.sleep(self.wait * n)
                if self.warm is not None:
                    self.warm()
        raise ValueError("at least one try is needed")


def bumped(token: str, by: int = 1) -> str | None:
    """A token whose trailing ":N" cursor is moved on; None if it has none."""
    m = re.fullmatch(r"(.*:)(\d+)", token, re.S)
    return f"{m[1]}{int(m[2]) + by}" if m else None


class Harvest:
    """Pages of one source."""

    def __init__(self, source: dict, fetch: Callable[[str, float], bytes] = http, delay: float = 0.5, from_date: str | None = None):
        self.source, self.fetch, self.delay, self.from_date = source, fetch, delay, from_date
        self.skipped = 0

    def url(self, token: str | None) -> str:
        base = self.source["base_url"]
        if base.startswith("dir:"):
            return os.path.join(base[4:], f"{token or 0}.xml")
        if token:
            return f"{base}?{urlencode({'verb': 'ListRecords', 'resumptionToken': token})}"
        asked = {"verb": "ListRecords", "metadataPrefix": self.source.get("metadata_prefix", "oai_dc"), "set": self.source.get("set"), "from": self.from_date}
        return f"{base}?{urlencode({k: v for k, v in asked.items() if v})}"

    def page(self, token: str | None) -> bytes:
        url = self.url(token)
        if self.source["base_url"].startswith("dir:"):
            with open(url, "rb") as f:
                return f.read()
        try:
            return self.fetch(url, TIMEOUTS[0])
        except OSError:  # a slow or broken connection is tried once more, with more patience
            return self.fetch(url, TIMEOUTS[1])

    def pages(self, token: str | None = None) -> Iterator[tuple[list[str], str | None]]:
        """(records as XML, next token) of every page."""
        while True:
            root = ET.fromstring(self.page(token))
            error = root.find(f"{OAI}error")
            if error is not None:
                code = error.get("code")
                if code == "noRecordsMatch":
                    return
                moved = bumped(token) if token and code == "cannotDisseminateFormat" and self.skipped < MOST_SKIPS else None
                if moved is None:
                    raise RuntimeError(f"{self.source['id']}: {code}: {(error.text or '').strip()}")
                self.skipped += 1
                token = moved
                continue
            listed = root.find(f"{OAI}ListRecords")
            records = [] if listed is None else [ET.tostring(r, "unicode") for r in listed.findall(f"{OAI}record")]
            after = None if listed is None else listed.findtext(f"{OAI}resumptionToken")
            token = (after or "").strip() or None
            yield records, token
            if token is None:
                return
            time.sleep(self.delay)


def get_record(source: dict, identifier: str, fetch: Callable[[str, float], bytes] = http) -> str | None:
    """One record in plain Dublin Core; None if it can't be had, whatever the reason."""
    try:
        root = ET.fromstring(fetch(f"{source['base_url']}?{urlencode({'verb': 'GetRecord', 'metadataPrefix': 'oai_dc', 'identifier': identifier})}", TIMEOUTS[0]))
        found = root.find(f"{OAI}GetRecord/{OAI}record")
        return None if found is None else ET.tostring(found, "unicode")
    except Exception:  # noqa: BLE001 - the fallback is optional by definition
        return None


def filled(source: dict, xml: str, fetch: Callable[[str, float], bytes] = http) -> tuple[str, bool]:
    """(the record, or its plain form if it has an identifier but no fields and the plain form can be had; whether it is the plain form)."""
    record = ET.fromstring(xml)
    head, fields = record.find(f"{OAI}header"), record.find(f"{OAI}metadata")
    identifier = None if head is None else (head.findtext(f"{OAI}identifier") or "").strip()
    if not identifier or head.get("status") == "deleted" or (fields is not None and any("".join(x.itertext()).strip() for x in fields)):
        return xml, False
    plain = get_record(source, identifier, fetch)
    return (xml, False) if plain is None else (plain, True)


def _named(path: str) -> Callable:
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)


def _fetcher(options: dict) -> Callable[[str, float], bytes]:
    fetch = _named(options["fetch"]) if "fetch" in options else http
    if "retries" not in options:
        return fetch
    return Retrying(fetch, int(options["retries"]), float(options.get("wait", 2.0)), _named(options["warm"]) if "warm" in options else None)


def _sources(options: dict) -> list[dict]:
    rows = json.loads(options["sources"])
    only = {x for x in options.get("only", "").split(",") if x}
    kept = [r for r in rows if not only or r["id"] in only]
    if not kept:
        raise ValueError("no source of that name")
    return kept


class OaiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        starts = json.loads(self.options.get("from", "{}"))
        return [SourcePartition(s, starts.get(s["id"])) for s in _sources(self.options)]

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        most = int(self.options.get("max_records", 0)) or None
        fetch, fallback = _fetcher(self.options), str(self.options.get("fallback", "false")).lower() == "true"
        harvest = Harvest(partition.source, fetch, float(self.options.get("delay", 0.5)), partition.from_date)
        prefix = partition.source.get("metadata_prefix", "oai_dc")
        seq = 0
        for records, _ in harvest.pages():
            for xml in records:
                whole, plain = filled(partition.source, xml, fetch) if fallback and prefix != "oai_dc" else (xml, False)
                yield partition.source["id"], "oai_dc" if plain else prefix, seq, whole
                seq += 1
                if seq == most:
                    return


class OaiStreamReader(SimpleDataSourceStreamReader):
    """A page of every source at a time; the offset holds each source's next token."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {s["id"]: "" for s in _sources(self.options)}

    def _page(self, source: dict, token: str) -> tuple[list[tuple], str]:
        harvest = Harvest(source, _fetcher(self.options), 0, self.options.get("from"))
        for records, after in harvest.pages(token or None):
            return [(source["id"], source.get("metadata_prefix", "oai_dc"), i, x) for i, x in enumerate(records)], after or "done"
        return [], "done"

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for source in _sources(self.options):
            if start.get(source["id"]) != "done":
                found, end[source["id"]] = self._page(source, start.get(source["id"], ""))
                rows += found
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for source in _sources(self.options):
            if start.get(source["id"]) != "done" and start.get(source["id"]) != end.get(source["id"]):
                yield from self._page(source, start.get(source["id"], ""))[0]


class OaiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return OaiReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return OaiStreamReader(self.options)


def catalogue(spark, path: str, only: list[str] | None = None):
    """The source catalogue (a YAML or JSON list of id, name, short, platform, base_url, metadata_prefix, set) as a DataFrame."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            rows = json.load(f)
        else:
            import yaml

            rows = yaml.safe_load(f)
    rows = rows["sources"] if isinstance(rows, dict) else rows
    names = ("id", "name", "short", "platform", "base_url", "metadata_prefix", "set")
    found = spark.createDataFrame([tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    if only:
        found = found.where(found["id"].isin(*only))
        if found.isEmpty():
            raise ValueError("no source of that name")
    return found
