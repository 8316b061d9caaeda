"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Expressions find candidates in every text; each candidate's value is hashed, and hashes are aggregated by distinct repositories and
owners. A value with at most FEW owners and FEW_REPOS repositories is owner-specific and counts as live; one that more share is a copied
example. Where the table names no repository, a document stands for one. Kinds assign, access and hex are the base and stay whatever the verdict; kind owned (long mixed-case tokens) is kept only
where the corpus says that it is owner-specific.

Scale: candidates leave the scan as narrow rows; (hash, owner, repository) is made distinct by partial aggregation before it is
counted, so a value in a third of all rows is a few rows by the time it meets others. The counts are joined back on the hash and a
salt of SALTS values, over which the counts are repeated, so such a value is spread over SALTS tasks.

Defined results: a null text counts as empty; a null owner or repository is one more owner or repository; repeated rows each get
their result; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, free, written

# The kinds' expressions.
KEYS = r"(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
LEAD = KEYS + r"""["']?\x20*+[:=]\x20*+["']?"""
ASSIGN = LEAD + r"[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
# not after a key and its colon, whose value is an assign span; looked for only where all else fits
OWNED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z0-9+/_-]{32})(?<!" + KEYS + r"""["']?\x20{0,8}[:=]\x20{0,8}["']?)[A-Za-z0-9+/_-]{32,}+={0,2}+"""
ORDER = ("assign", "access", "hex", "owned")
BASE = ORDER[:3]
LEAST_VALUE = 6
FEW, FEW_REPOS, SALTS = 2, 8, 16

CANDIDATES = "array<struct<start:int,rank:int,kind:string,end:int,hash:string>>"


def candidates(text: Column) -> Column:
    """All spans of a text that isn't null, with a digest of the value."""
    found = {
        "assign": find_spans(text, ASSIGN, F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))),
        "access": find_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": find_spans(text, HEX),
        "owned": find_spans(text, OWNED),
    }
    return F.concat(*[hashed(found[k], k) for k in ORDER])


def hashed(spans: Column, kind: str) -> Column:
    def value(s):
        return F.regexp_replace(s["hit"], "^" + LEAD, "") if kind == "assign" else s["hit"]

    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(value(s)) >= LEAST_VALUE)
    return F.transform(spans, lambda s: F.struct(s["start"], F.lit(ORDER.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"], F.sha2(value(s), 256).alias("hash"))).cast(CANDIDATES)


def ownership(hits: DataFrame) -> DataFrame:
    """hash → distinct owners and repositories. Distinct triples first, then counts: two partial aggregations."""
    triples = hits.select("hash", "owner", "repo").distinct()
    return triples.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", few: int = FEW, few_repos: int = FEW_REPOS) -> DataFrame:
    """One row per input row: key, spans (array of start, kind, end, verdict, n_owners, n_repos; by start, then kind as listed). A key named
    spans keeps its name, and the result gets an underscore behind its own."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("__key"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), t.alias("t"))
    rows = rows.select("__key", "owner", "repo", candidates(F.col("t")).alias("found")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "secrets")  # row numbers are fixed from here on
    hits = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    counts = ownership(hits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = hits.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(counts, ["hash", "salt"])
    known = known.withColumn("verdict", F.when((F.col("n_owners") <= few) & (F.col("n_repos") <= few_repos), "live").otherwise("copied"))
    known = known.where((F.col("kind") != "owned") | (F.col("verdict") == "live"))
    by_row = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "verdict", "n_owners", "n_repos"))).alias("spans"))
    none = F.array().cast(by_row.schema["spans"].dataType)
    return rows.join(by_row, "row", "left").select("__key", F.coalesce("spans", none).alias("spans")).toDF(key, *free(["spans"], [key]))


def verdicts(spans: Column) -> Column:
    """kind:start:end:verdict:owners:repositories, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["verdict"], s["n_owners"].cast("string"), s["n_repos"].cast("string"))), ",")


def label(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
