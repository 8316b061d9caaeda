"""Fill-in-middle documents: two cuts at token borders, the middle moved to the end.

Tokens are runs of letters A-Z, a-z and all other single characters, found by the tokenizers library's Split pre-tokenizer with isolated
matches, which needs no training. The ends of its pieces, in code points, are all that Python returns a text's cuts from: their number
is n, and the ends at the two drawn ranks are where the slices lie. Draws, form, slices and digests are expressions.

Scale: one pass without a shuffle; a text is split BLOCK characters or so at a time, cut where no run of letters goes on, so what a long
text needs besides itself is one number a token.

Defined results: a null text counts as empty and is plain with n = 0; a null id draws as empty text does; repeated rows come out
alike; an empty table gives an empty result; a result whose name a kept column has gets an underscore behind it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free

PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20  # of 100 texts, how many are cut; of 100 of those, how many have the suffix first
BLOCK = 1 << 16
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")

_letters = re.compile("[A-Za-z]*")


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(PATTERN), "isolated").pre_tokenize_str


def token_ends(text: str, split, block: int = BLOCK) -> np.ndarray:
    """Where each token ends, in code points."""
    parts, at = [np.empty(0, np.int64)], 0
    while at < len(text):
        stop = min(at + block, len(text))
        if _letters.fullmatch(text, stop - 1, stop):  # a run of letters may go on
            stop = _letters.match(text, stop).end()
        pieces = split(text[at:stop])
        parts.append(np.fromiter((span[1] for _, span in pieces), np.int64, len(pieces)) + at)
        at = stop
    return np.concatenate(parts)


def cut(text: str, one: int, other: int, split, block: int = BLOCK) -> tuple[int, int, int]:
    """Number of tokens, and the code points at which prefix and middle end, for two draws."""
    ends = np.concatenate([[0], token_ends(text, split, block)])
    lo, hi = sorted((one % len(ends), other % len(ends)))  # as many ranks as borders
    return len(ends) - 1, int(ends[lo]), int(ends[hi])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "from", "to")]))
def cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    split = splitter()
    rows = [cut(t.as_py(), a.as_py(), b.as_py(), split) for t, a, b in zip(text, one, other, strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["n", "from", "to"])


def draw(key: Column, seed: str, k: int) -> Column:
    """The k-th draw (from 1) of an id: a group of eight digits of the SHA-256 of 'seed:id'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", keep=(), seed: str = "1", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """keep and key, then n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output. A text that is empty or
    holds a marker stays plain, for its output could not be read back."""
    kept = list(dict.fromkeys([*keep, key]))
    t, drawn = F.coalesce(F.col(text).cast("string"), F.lit("")), lambda k: draw(F.col(key), seed, k)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(t, F.lit(m))
    plain = (t == "") | marked | (drawn(3) % 100 >= rate)
    form = F.when(plain, "plain").when(drawn(4) % 100 < spm, "spm").otherwise("psm")
    rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], t.alias("__t"), form.alias("__form"), cuts(t, drawn(1), drawn(2)).alias("__c"))
    prefix, middle = F.substr("__t", F.lit(1), F.col("__c.from").cast("int")), F.substr("__t", (F.col("__c.from") + 1).cast("int"), (F.col("__c.to") - F.col("__c.from")).cast("int"))
    suffix = F.substr("__t", (F.col("__c.to") + 1).cast("int"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("__form") == "plain", F.col("__t")).when(F.col("__form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    chars = lambda c: F.when(F.col("__form") != "plain", c)
    names = [F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)]
    results = [F.col("__c.n"), F.col("__form"), chars(F.col("__c.from")), chars(F.col("__c.to") - F.col("__c.from")), output]
    return rows.select(*names, *[r.alias(c) for r, c in zip(results, free(OUTPUTS, kept), strict=True)])


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: what lies before and after the two inner markers. Each marker stands once, for a text with
    one is plain, and no marker can be made of the end of a part and the beginning of another marker."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    last = F.instr(output, MIDDLE)
    first, then, middle = F.substr(output, F.lit(4), second - 4), F.substr(output, second + 3, last - second - 3), F.substr(output, last + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, then)).otherwise(F.concat(then, middle, first))
