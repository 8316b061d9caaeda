"""Texts cut at points that their content chooses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunks(text: Column, size: int) -> Column:
    """Lines in chunks: one ends before a line that would overflow it, and after a line whose hash says so once it is half full. Lines
    added at the top then change the chunks near them only. The sum over lines counts a line break for each."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def step(acc, line):
        full = (acc["n"] + F.length(line) > size) & (F.size(acc["open"]) > 0)
        done = F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["done"])
        opened = F.when(full, F.array(line)).otherwise(F.concat(acc["open"], F.array(line)))
        n = F.when(full, 0).otherwise(acc["n"]) + F.length(line) + 1
        cut = (n >= size // 2) & (F.conv(F.substring(F.sha1(line.cast("binary")), 1, 4), 16, 10).cast("int") % 16 == 0)
        return F.struct(F.when(cut, F.concat(done, F.array(F.array_join(opened, "\n")))).otherwise(done).alias("done"), F.when(cut, none).otherwise(opened).alias("open"), F.when(cut, 0).otherwise(n).alias("n"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["done"]))
