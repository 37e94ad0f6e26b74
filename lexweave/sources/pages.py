"""Fetching pages politely: robots.txt once per host, a pause between requests to it.

All URLs of a host go to one task, which keeps the host's clock; hosts run side by side.
"""

from __future__ import annotations

import dataclasses
import http.client
import time
import urllib.error
import urllib.parse
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexweave.functions.text import authority, robots_url
from lexweave.sources.config import CONFIG_DIR, ConfigError, SourceConfig, read_url_list

PAGES = "ordinal bigint, url string, html string, status bigint, error string"


def http_get(url: str, agent: str, timeout: float) -> tuple[int, str]:
    """(status, body); raises OSError if the host can't be reached."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, ""


def robots_for(status: int, body: str) -> urllib.robotparser.RobotFileParser:
    """The rules of a host; anything but status 200 allows all."""
    rules = urllib.robotparser.RobotFileParser()
    rules.parse(body.splitlines() if status == 200 else [])
    return rules


def pause(configured: float, asked: float | None) -> float:
    return max(configured, float(asked or 0.0))


def allowed(url: Column, robots: Column, agent: str) -> Column:
    """Whether a host's robots.txt (null: none) lets ``agent`` read a URL."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("boolean")
    def each(urls, bodies):
        import pandas as pd

        known: dict = {}
        out = []
        for u, body in zip(urls, bodies):
            if body not in known:
                known[body] = robots_for(200 if body is not None else 404, body or "")
            out.append(known[body].can_fetch(agent, u))
        return pd.Series(out)

    return each(url, robots)


class Host:
    """The rules and the clock of one host."""

    def __init__(self, robots: str, agent: str, timeout: float, least: float, get: Callable, clock: Callable, sleep: Callable):
        self.agent, self.timeout, self.get, self.clock, self.sleep = agent, timeout, get, clock, sleep
        self.rules = robots_for(*get(robots, agent, timeout))
        self.pause = pause(least, self.rules.crawl_delay(agent))
        self.last = clock()  # reading the rules is a request, too

    def page(self, url: str) -> tuple[str | None, int | None, str | None]:
        """(html, status, error), after as long a wait as the host wants."""
        if not self.rules.can_fetch(self.agent, url):
            return None, None, "robots.txt disallows it for our user agent"
        wait = self.pause - (self.clock() - self.last)
        if wait > 0:
            self.sleep(wait)
        try:
            status, html = self.get(url, self.agent, self.timeout)
        finally:
            self.last = self.clock()
        return (html, status, None) if status == 200 else (None, status, f"returned HTTP {status}")


def fetched(rows: Iterable[tuple], config: SourceConfig, hosts: dict, get: Callable, clock: Callable, sleep: Callable) -> Iterator[tuple]:
    """(ordinal, url, html, status, error) for each (ordinal, url, host, robots); ``hosts`` keeps what is known of hosts."""
    for ordinal, url, host, robots in rows:
        html, status, error = None, None, None
        try:
            if host not in hosts:
                hosts[host] = Host(robots, config.user_agent, config.timeout_seconds, config.request_delay_seconds, get, clock, sleep)
            html, status, error = hosts[host].page(url)
        except (OSError, ValueError, http.client.HTTPException) as problem:  # ValueError: no URL that can be asked for
            error = f"could not fetch: {problem}"
        yield ordinal, url, html, status, error


def fetch_pages(urls: DataFrame, config: SourceConfig, get: Callable = http_get, clock: Callable = time.monotonic, sleep: Callable = time.sleep) -> DataFrame:
    """(ordinal, url, html, status, error) for each row of ``urls`` (ordinal, url); a failure is a row."""

    def run(batches):
        import pandas as pd

        hosts: dict = {}
        for batch in batches:
            asked = zip(batch["ordinal"], batch["url"], batch["host"], batch["robots"])
            yield pd.DataFrame(fetched(asked, config, hosts, get, clock, sleep), columns=["ordinal", "url", "html", "status", "error"]).astype({"status": "Int64"})

    dealt = urls.select("ordinal", "url", authority(F.col("url")).alias("host"), robots_url(F.col("url")).alias("robots")).repartition("host")
    return dealt.sortWithinPartitions("host", "ordinal").mapInPandas(run, PAGES)


class HostPart(InputPartition):
    """The URLs of one host, in list order."""

    def __init__(self, host: str, robots: str, urls: list[tuple[int, str]]):
        self.host, self.robots, self.urls = host, robots, urls


class PoliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ConfigError("the source needs the path of a URL list: .load(path)")
        known = {"user_agent": options.get("useragent"), "request_delay_seconds": options.get("delay"), "timeout_seconds": options.get("timeout")}
        self.config = dataclasses.replace(SourceConfig.load(CONFIG_DIR / "source.yaml"), **{k: v if k == "user_agent" else float(v) for k, v in known.items() if v is not None})

    def partitions(self) -> list[HostPart]:
        """One per host, in the order of its first URL."""
        parts: dict[str, HostPart] = {}
        for ordinal, url in enumerate(read_url_list(Path(self.path))):
            at = urllib.parse.urlsplit(url)
            part = parts.setdefault(at.netloc, HostPart(at.netloc, f"{at.scheme}://{at.netloc}/robots.txt", []))
            part.urls.append((ordinal, url))
        return list(parts.values())

    def read(self, partition: HostPart) -> Iterator[tuple]:
        asked = ((ordinal, url, partition.host, partition.robots) for ordinal, url in partition.urls)
        yield from fetched(asked, self.config, {}, http_get, time.monotonic, time.sleep)


class PoliteSource(DataSource):
    """``spark.read.format("polite_pages").load(url_list)``: pages as rows, a partition for each host.

    Options ``userAgent``, ``delay`` and ``timeout`` replace the configuration's. The list of URLs is
    read by the driver, which has to know the hosts; for lists too long for it there is :func:`fetch_pages`.
    """

    @classmethod
    def name(cls) -> str:
        return "polite_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PoliteReader:
        return PoliteReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``polite_pages`` known to a session."""
    spark.dataSource.register(PoliteSource)
