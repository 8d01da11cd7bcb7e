"""robots.txt as a column: whether an address may be crawled, or null where that can't be told."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_robots(sites: DataFrame, agent: str) -> DataFrame:
    """sites(url, robots_status, robots_text) with robots_allowed: a missing file allows, other failures tell nothing.

    The rules for the agent are asked first, then those for all.
    """

    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for urls, statuses, texts in parts:
            out = []
            for url, status, text in zip(urls, statuses, texts, strict=True):
                if pd.isna(status) or (status >= 400 and status != 404):
                    out.append(None)
                    continue
                parser = RobotFileParser()
                parser.parse(("" if status == 404 else text or "").splitlines())
                out.append(bool(parser.can_fetch(agent, url) or parser.can_fetch("*", url)))
            yield pd.Series(out, dtype=object)

    return sites.withColumn("robots_allowed", F.pandas_udf(read, "boolean")("url", "robots_status", "robots_text"))
