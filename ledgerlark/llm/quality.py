"""Quality rules as a short-circuit cascade: each rule's cost and selectivity are estimated on a sample, and rules run in the order of
rejections per cost; a text that one rule rejects skips the rest.

The sample sets only the order. The verdict is the conjunction of all rules, so it is the same for any order, sample or partitioning.

Defined results: a null or empty text has no words and fails; a text without a line break is one line; repeated rows are judged each
on their own; other columns pass through if named in `keep`.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, free, mix, tidy

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
FOLLOWERS = bytes(range(0x80, 0xC0))
DIGITS = b"0123456789"
SAMPLE_ROWS = 400


class Text:
    """One text as bytes; what rules measure is computed when first asked for."""

    __slots__ = ("raw", "memo", "_words", "_repeats", "_dups")

    def __init__(self, raw: bytes, memo: Memo):
        self.raw, self.memo, self._words, self._repeats, self._dups = raw, memo, None, None, None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()  # of bytes: splits at exactly \x20 and \x09-\x0D
        return self._words

    @property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, FOLLOWERS + BLANKS))

    @property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @property
    def n_dup_lines(self) -> int:
        if self._dups is None:
            lines = [x for x in self.raw.split(b"\n") if x.strip()]
            self._dups = len(lines) - len(set(lines))
        return self._dups

    @property
    def n_repeat_words(self) -> int:
        """Words covered by 5-word windows that occur twice or more."""
        if self._repeats is None:
            n = len(self.words)
            self._repeats = 0
            if n > 5:
                h = np.fromiter(map(self.memo.__getitem__, self.words), np.uint64, n)
                m = n - 4
                s = h[:m].copy()
                for i in range(1, 5):
                    s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : m + i]
                s = mix(s)
                order = np.argsort(s, kind="stable")
                same = s[order][1:] == s[order][:-1]
                if same.any():
                    twice = np.zeros(m, bool)
                    twice[order[1:][same]] = True
                    twice[order[:-1][same]] = True
                    covered = np.zeros(n, bool)
                    for i in range(5):
                        covered[i : m + i] |= twice
                    self._repeats = int(covered.sum())
        return self._repeats


@dataclass(frozen=True)
class Rule:
    """fails(text) is True for a text to reject."""

    name: str
    fails: object


#: The production rules. Thresholds are meant to reject only what is plainly no prose.
RULES = [
    Rule("few_words", lambda t: len(t.words) < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * len(t.words)),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * max(1, t.word_chars)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words)),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 3 * (t.raw.count(b"\n") + 1)),
    Rule("digits", lambda t: 10 * (len(t.raw) - len(t.raw.translate(None, DIGITS))) > 3 * max(1, len(t.raw))),
]
BASE = ("few_words", "repeated_windows")


def hashed_words() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w))


def plan(texts: list[bytes], rules=None) -> list[dict]:
    """Each rule's cost (seconds a text, alone) and share of rejections over a sample, by falling rejection per cost."""
    rules = RULES if rules is None else rules
    out, memo = [], hashed_words()
    for r in rules:
        began = time.perf_counter()
        rejected = sum(bool(r.fails(Text(t, memo))) for t in texts)
        cost = (time.perf_counter() - began) / max(1, len(texts))
        out.append({"rule": r.name, "cost": max(cost, 1e-9), "rejects": rejected / max(1, len(texts))})
    return sorted(out, key=lambda x: (-x["rejects"] / x["cost"], x["cost"], x["rule"]))


def sampled(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[bytes]:
    """At most `rows` texts for the estimate, the first that a few partitions give: only the order depends on them. Very long texts
    are left to the estimate of others."""
    got = df.select(F.col(text).cast("string").alias("t")).where(F.length("t") < 200_000).limit(rows).collect()
    return [r.t.encode() for r in got]


def cascade(df: DataFrame, text: str = "text", keep=("doc_id",), rules=None, order: list[str] | None = None, measures: bool = True) -> DataFrame:
    """Per row: `keep`, kept, failed_rule (the first in cascade order, null if kept), base_failed and, with measures=True, the
    measures that the base rules rest on, which are then computed for every text whatever the cascade has decided. A result that has a
    kept column's name gets an underscore behind it."""
    rules = RULES if rules is None else rules
    if order is None:
        order = [x["rule"] for x in plan(sampled(df, text), rules)]
    by = {r.name: r for r in rules}
    chain = [by[n] for n in order]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if measures else []
    inner = df.select(F.col(text).cast("string").cast("binary").alias("__text"), *[F.col(c) for c in keep])
    kinds = [T.LongType()] * len(names) + [T.BooleanType(), T.BooleanType(), T.StringType()]
    results = free([*names, "base_failed", "kept", "failed_rule"], keep)
    schema = T.StructType(inner.schema.fields[1:] + [T.StructField(n, k) for n, k in zip(results, kinds, strict=True)])

    def run(batches):
        memo = hashed_words()
        for batch in batches:
            got, base, kept, first = [[] for _ in names], [], [], []
            for raw in batch.column(0).to_pylist():
                t = Text(raw or b"", memo)
                failed = next((r.name for r in chain if r.fails(t)), None)
                b = failed in BASE or failed is not None and any(by[n].fails(t) for n in BASE if n in by)
                base.append(b)
                kept.append(failed is None)
                first.append(failed)
                if names:
                    for column, v in zip(got, (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                batch.columns[1:] + [pa.array(x, pa.int64()) for x in got] + [pa.array(base, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(first, pa.string())], [f.name for f in schema.fields]
            )

    return inner.mapInArrow(tidy(run), schema)
