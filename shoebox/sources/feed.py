"""A paged change feed as a streaming source.

A feed is anything with `zones()`, own zone first, `ends(zone, token)`, which yields the
token behind each page that follows, and `pages(zone, token)`, which yields (records,
token); the option `feed` names its class as module:Class, which is given the options.

The driver asks for tokens alone.  A micro-batch has a range of pages of each zone, ranges
are dealt to input partitions, and executors read the pages.  The stream's offset holds a
token and a number of pages by zone, so a restart resumes each zone where its last
committed batch ended, and the errors of zones that gave no token.  A record's position
`seq` follows from the numbers of pages alone: the same range gives the same positions.

A shared zone whose pages can't be read leaves a row of type `zone_error` with the range,
which `again` reads later at the positions that it had.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from importlib import import_module
from itertools import islice
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "name string, type string, deleted boolean, modified timestamp, master_ref string, json string, zone string, seq bigint"
#: The own zone, and how names of shared ones begin.
OWN, SHARED = "PrimarySync", "SharedSync"
#: Type of the row that stands for pages that couldn't be read.
ERROR = "zone_error"
#: A page has at most 2**PAGE_BITS records.
PAGE_BITS = 24
#: Seconds before each new attempt.
DELAYS = (2.0, 5.0, 15.0, 45.0, 120.0)
T = TypeVar("T")


class FeedError(Exception):
    """The feed's service answered with something that can't be used, or no longer answers."""


class Feed(Protocol):
    def zones(self) -> list[str]: ...

    def ends(self, zone: str, token: str | None) -> Iterator[str]: ...

    def pages(self, zone: str, token: str | None) -> Iterator[tuple[list[dict], str]]: ...


def retried(call: Callable[[], T], what: str, delays: tuple[float, ...] = DELAYS, sleep: Callable[[float], None] = time.sleep) -> T:
    """What the call gives; after an error it is made again behind each delay, and then a FeedError says so. A FeedError is raised at once."""
    for pause in (*delays, None):
        try:
            return call()
        except FeedError:
            raise
        except Exception as e:  # whatever a remote service throws
            if pause is None:
                raise FeedError(f"{what}: no answer in {len(delays) + 1} attempts: {e}") from e
            sleep(pause)
    raise AssertionError


def migrate_tokens(cursors: dict[str, str] | None, cursor: str | None, zones: list[str]) -> dict[str, str]:
    """Tokens by zone; a single token of older state is the first zone's."""
    if cursors:
        return dict(cursors)
    return {zones[0]: cursor} if cursor and zones else {}


class JsonFeed:
    """A feed in a folder: <zone>/<page>.json, arrays of records, and albums.json; the token is the number of pages read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]

    def zones(self) -> list[str]:
        names = [n for n in os.listdir(self.root) if os.path.isdir(f"{self.root}/{n}")]
        return sorted(names, key=lambda z: (z != OWN, z))

    def ends(self, zone: str, token: str | None) -> Iterator[str]:
        at = int(token or 0)
        while os.path.exists(f"{self.root}/{zone}/{at}.json"):
            at += 1
            yield str(at)

    def pages(self, zone: str, token: str | None) -> Iterator[tuple[list[dict], str]]:
        at = int(token or 0)
        while os.path.exists(p := f"{self.root}/{zone}/{at}.json"):
            with open(p) as f:
                yield json.load(f), str(at + 1)
            at += 1

    def albums(self) -> list[dict]:
        """id, name, fullname of each album."""
        if not os.path.exists(p := f"{self.root}/albums.json"):
            return []
        with open(p) as f:
            return json.load(f)


def opened(options: dict[str, str]) -> Feed:
    module, _, name = options.get("feed", f"{__name__}:JsonFeed").partition(":")
    return getattr(import_module(module), name)(options)


def zone_listing(spark: SparkSession, feed: Feed) -> DataFrame:
    """place, zone, shared: zones in the order they are read."""
    return spark.createDataFrame([(k, z, z.startswith(SHARED)) for k, z in enumerate(feed.zones())], "place int, zone string, shared boolean")


def album_listing(spark: SparkSession, feed: JsonFeed) -> DataFrame:
    return spark.createDataFrame([(a["id"], a["name"], a.get("fullname", a["name"])) for a in feed.albums()], "id string, name string, fullname string")


def moment(value) -> datetime | None:
    """A record's time: milliseconds since 1970 or ISO text."""
    if value is None:
        return None
    if isinstance(value, (int, float)):
        return datetime.fromtimestamp(value / 1000, timezone.utc)
    at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def master_of(record: dict) -> str | None:
    """The master that a record names, on its own or in its fields."""
    if (own := record.get("master_ref")) is not None:
        return own
    fields = (record.get("fields") or {}).get("fields") or {}
    ref = (fields.get("masterRef") or {}).get("value")
    return ref.get("recordName") if isinstance(ref, dict) else None


@dataclass
class Pages(InputPartition):
    """`count` pages of a zone behind a token, the first of which is the feed's page number `first`."""

    zone: str
    token: str | None
    count: int
    first: int


def _in_order(zones) -> list[str]:
    return sorted(zones, key=lambda z: (z.startswith(SHARED), z != OWN, z))


class _Access:
    """A feed with the settings that all readers share: delays, and pages a partition."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.delays = tuple(float(x) for x in options.get("delays", ",".join(map(str, DELAYS))).split(",") if x)
        self.each = int(options.get("pages_per_partition", "16"))

    @property
    def feed(self) -> Feed:
        if "_feed" not in self.__dict__:
            self._feed = opened(self.options)
        return self._feed

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_feed"}  # executors open their own

    def ends(self, zone: str, token: str | None, most: int) -> list[str]:
        return retried(lambda: list(islice(self.feed.ends(zone, token), most)), f"tokens of {zone}", self.delays)

    def dealt(self, pages: Pages, end: str | None = None) -> list[Pages]:
        """The same pages as partitions of `each` at most."""
        ends = self.ends(pages.zone, pages.token, pages.count)
        if len(ends) < pages.count or end is not None and ends[-1] != end:
            raise ValueError(f"zone {pages.zone} no longer has the pages up to {end or pages.count}")
        return [Pages(pages.zone, ends[k - 1] if k else pages.token, min(self.each, pages.count - k), pages.first + k) for k in range(0, pages.count, self.each)]

    def rows(self, pages: Pages) -> Iterator[tuple]:
        """The records of the pages with their positions; of a shared zone that fails a row that says what is left."""
        source, token = self.feed.pages(pages.zone, pages.token), pages.token
        for k in range(pages.count):

            def one():
                nonlocal source
                try:
                    return next(source, None)
                except Exception:
                    source = self.feed.pages(pages.zone, token)  # a generator ends with its error
                    raise

            at = pages.first + k << PAGE_BITS
            try:
                page = retried(one, f"pages of {pages.zone}", self.delays)
                if page is None:
                    raise FeedError(f"zone {pages.zone} ends before page {pages.first + k}")
                if len(page[0]) >> PAGE_BITS:
                    raise FeedError(f"a page of {len(page[0])} records")
                rows = [_row(r, pages.zone, at + n) for n, r in enumerate(page[0])]
            except Exception as e:
                if not pages.zone.startswith(SHARED):
                    raise
                left = Pages(pages.zone, token, pages.count - k, pages.first + k)
                yield (None, ERROR, False, None, None, json.dumps(asdict(left) | {"error": str(e)[:200]}), pages.zone, at)
                return
            yield from rows
            token = page[1]


def _row(r: dict, zone: str, seq: int) -> tuple:
    fields = r.get("fields")
    return (r["name"], r.get("type"), bool(r.get("deleted")), moment(r.get("modified")), master_of(r), None if fields is None else json.dumps(fields), zone, seq)


class _StreamReader(DataSourceStreamReader):
    """`at` is how far batches were planned: the engine plans the last batch first when a query restarts."""

    def __init__(self, options: dict[str, str]) -> None:
        self.access = _Access(options)
        self.start = json.loads(options.get("tokens", "{}"))
        self.shared = options.get("shared", "true").lower() == "true"
        self.most = int(options.get("pages_per_batch", "4096"))
        #: Pages of older state, which come before the first one; they stand under a zone without a name.
        self.before = {"": int(options["first"])} if int(options.get("first", "0")) else {}
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"tokens": self.start, "pages": self.before, "errors": {}}

    def latestOffset(self) -> dict:
        """The next pages of each zone, so many at most; a zone that fails keeps its token and has its error in the offset, but the own one must answer."""
        self.at = self.at or self.initialOffset()
        tokens, pages, errors = dict(self.at["tokens"]), dict(self.at["pages"]), {}
        zones = retried(self.access.feed.zones, "zones", self.access.delays)
        for k, zone in enumerate(z for z in zones if self.shared or not z.startswith(SHARED)):
            try:
                ends = self.access.ends(zone, tokens.get(zone), self.most)
            except Exception as e:
                if k == 0:
                    raise
                errors[zone] = str(e)[:200]
                continue
            if ends:
                tokens[zone], pages[zone] = ends[-1], pages.get(zone, 0) + len(ends)
        self.at = {"tokens": tokens, "pages": pages, "errors": errors}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at = self.at or end
        number, out = sum(start["pages"].values()), []
        for zone in _in_order(end["pages"]):
            count = end["pages"][zone] - start["pages"].get(zone, 0)
            if count:
                out += self.access.dealt(Pages(zone, start["tokens"].get(zone), count, number), end["tokens"][zone])
            number += count
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.access.rows(partition)


class _RangeReader(DataSourceReader):
    """A batch of page ranges, which the option `ranges` lists."""

    def __init__(self, options: dict[str, str]) -> None:
        self.access = _Access(options)
        self.ranges = [Pages(x["zone"], x["token"], x["count"], x["first"]) for x in json.loads(options["ranges"])]

    def partitions(self) -> list[Pages]:
        return [p for r in self.ranges for p in self.access.dealt(r)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.access.rows(partition)


class ChangeFeed(DataSource):
    """spark.dataSource.register(ChangeFeed); spark.readStream.format("change_feed").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(dict(self.options))


def again(spark: SparkSession, ranges: list[dict], options: dict[str, str]) -> DataFrame:
    """The records of page ranges that failed before, at the positions that they had."""
    return spark.read.format(ChangeFeed.name()).options(**options, ranges=json.dumps(ranges)).load()
