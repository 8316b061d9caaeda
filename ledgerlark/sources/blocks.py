"""The block splitter as a table function for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

LONGEST = 20_000


class Blocks:
    """One row for each block of a page: its place from 0 and its text, from one match of `start` to the next; the last has LONGEST characters
    at most. What stands before the first match is dropped; a null page has no blocks."""

    def eval(self, html: str, start: str) -> Iterator[tuple[int, str]]:
        if html is None or start is None:
            return
        at, pos = None, 0
        for m in re.finditer(start, html):
            if at is not None:
                yield pos, html[at : m.start()]
                pos += 1
            at = m.start()
        if at is not None:
            yield pos, html[at : at + LONGEST]


def register(spark: SparkSession, name: str = "html_blocks") -> str:
    """Register it: SELECT … FROM pages, LATERAL html_blocks(html, '<li>')."""
    spark.udtf.register(name, udtf(Blocks, returnType="pos int, block string"))
    return name
