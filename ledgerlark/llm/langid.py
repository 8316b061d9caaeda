"""Language identification by Bayesian fusion of evidence.

For each page: the text's likelihood by language (words hashed to BUCKETS, add-ALPHA frequencies counted over all labelled texts), the
language that its markup declares, the suffix of its address, and a prior of its host. What a declaration or a suffix is worth and the
priors come from the other pages by grouped aggregation of what their texts alone say: P(declared | language) and P(suffix | language)
smoothed towards the whole, and host priors smoothed towards the domain's, the domain's towards all pages'. Each page's own text is
taken out of the counts that judge it. The log terms are added; the posterior is their softmax.

Scale: texts are read once, then narrow rows; the grouped counts are joined back on their keys, those of frequent hosts, domains, suffixes and
declarations over salts. On the driver and in each task: a number for each language and bucket, for all languages that occur (codes of
two or three letters).

Defined results: a null or empty page has no text evidence and is judged by the rest; a null address has the host ''; a page without
declaration has the declaration ''; without labelled texts the result is empty of languages (null lang); repeated rows each get theirs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, folded, free, spread, tidy, written

BUCKETS, ALPHA = 1 << 15, 0.1
TEMPER = 0.3  # words of a text are not independent: their log-likelihood counts by this share
SMOOTH = 5.0


def bucket(word: str) -> int:
    w = folded(word)
    return xxhash.xxh32_intdigest(w) % BUCKETS if w else -1


def word_buckets(text: str, memo: Memo) -> np.ndarray:
    tokens = text.split()
    b = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
    return b[b >= 0]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities by language and bucket, from all labelled texts. A label is a code of two or three letters; case and
    what follows a hyphen do not count; other labels are none."""
    code = F.lower(F.regexp_extract(F.col(lang).cast("string"), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    labelled = labelled.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), code.alias("x")).where("x != ''")
    langs = sorted(r[0] for r in labelled.select("x").distinct().collect())  # codes, some thousands at most
    index = {x: i for i, x in enumerate(langs)}
    rows = labelled
    counts = np.full((len(langs), BUCKETS), ALPHA)

    def run(batches):
        memo, got = Memo(bucket), np.zeros((len(index), BUCKETS), np.int32)
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[index[x]] += np.bincount(word_buckets(t, memo), minlength=BUCKETS)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(got.ravel()[at].astype(np.int64))], ["cell", "n"])

    if langs:
        got = rows.mapInArrow(tidy(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS
        counts.ravel()[got.cell.to_numpy()] += got.n.to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


_drop = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def text_evidence(pages: DataFrame, logs: np.ndarray, key: str, url: str, html: str, langs: list[str]) -> DataFrame:
    """Per page: key, host, domain, suffix, declared, log-likelihoods by language."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    inner = pages.select(
        body.alias("__html"),
        F.col(key).alias("__key"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"),
        F.lower(F.regexp_extract(body, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-zA-Z]{2,3})""", 1)).alias("declared"),
    )
    schema = T.StructType(inner.schema.fields[1:] + [T.StructField("like", T.ArrayType(T.DoubleType()))])
    shared = pages.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        memo, table = Memo(bucket), shared.value
        for batch in batches:
            like = [(TEMPER * table[:, word_buckets(_drop.sub(" ", t), memo)].sum(1)).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(like, pa.list_(pa.float64()))], schema.names)

    return inner.mapInArrow(tidy(run), schema)


def plus(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def normal(z: Column) -> Column:
    """Softmax of an array of logs."""
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def identify(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per page: key, host, declared, text_lang (by text alone; null without any word known to no language more than another),
    lang, prob. A result that has the key's name gets an underscore behind it."""
    names_out = [key, *free(["host", "declared", "text_lang", "lang", "prob"], [key])]
    langs, logs = learn(labelled, text, lang)
    rows = written(text_evidence(pages, logs, key, url, html, langs), "pages")
    if not langs:
        return rows.select("__key", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob")).toDF(*names_out)
    names = F.array(*map(F.lit, langs))
    size = len(langs)
    rows = rows.withColumn("soft", normal(F.col("like")))

    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(size)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]
    narrow = written(rows.groupBy("host", "domain", "suffix", "declared").agg(*sums, F.count(F.lit(1)).alias("n")), "evidence")

    def counts(by: str) -> DataFrame:
        """Soft counts of languages and pages: an array by value of `by`."""
        return written(narrow.groupBy(by).agg(*again, F.sum("n").alias("n")).select(by, F.array(*[f"s{i}" for i in range(size)]).alias(f"n_{by}"), "n"), "counts")

    whole = narrow.agg(*again).first()
    total = sum(x or 0.0 for x in whole)
    share = F.array(*[F.lit(((x or 0.0) + 1.0) / (total + size)) for x in whole])
    mass = F.array(*[F.lit(float(x or 0.0)) for x in whole])
    others = lambda n: F.zip_with(n, F.col("soft"), lambda x, own: F.greatest(x - own, F.lit(0.0)))

    def smoothed(n: Column, prior: Column) -> Column:
        of = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(n, prior, lambda x, p: (x + SMOOTH * p) / (of + SMOOTH))

    def worth(n: Column) -> Column:
        """log P(value | language), towards the value's share of all pages."""
        of = F.aggregate(n, F.lit(0.0), lambda s, x: s + x) / F.lit(max(total, 1.0))
        return F.zip_with(n, mass, lambda x, m: F.log((x + SMOOTH * of + 1e-9) / (m + SMOOTH)))

    all_of = rows
    for by in ("host", "domain", "suffix", "declared"):
        all_of = spread(all_of, counts(by), by, "n", "__key").drop("n")
    all_of = all_of.withColumns({f"n_{by}": others(F.col(f"n_{by}")) for by in ("host", "domain", "suffix", "declared")})
    prior = smoothed(F.col("n_host"), smoothed(F.col("n_domain"), share))
    z = plus(F.col("like"), F.transform(prior, lambda p: F.log(p)), F.when(F.col("declared") == "", F.array(*[F.lit(0.0)] * size)).otherwise(worth(F.col("n_declared"))), worth(F.col("n_suffix")))
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    flatly = F.array_max("like") == F.array_min("like")
    out = all_of.withColumn("post", normal(z))
    return out.select("__key", "host", "declared", F.when(~flatly | F.lit(size == 1), best(F.col("like"))).alias("text_lang"), best(F.col("post")).alias("lang"), F.array_max("post").alias("prob")).toDF(*names_out)
