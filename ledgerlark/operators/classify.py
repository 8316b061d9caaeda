"""Ordered rules with provenance; labels with aliases; what an enrichment may change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.genre_words import COARSE, FORMAT, MUSIC_HINT, NON_MUSIC, SITE_RULES, SPELLINGS, STYLE, TEXT_RULES
from ..functions.text import folded, let, squeeze


def by_rules(text: Column, rules: list[tuple[str, str]], most: int = 3) -> Column:
    """Tags of the rules that match, in rule order, distinct, at most `most`."""
    hits = F.array(*[F.when(text.rlike(p), F.lit(tag)) for tag, p in rules])
    return F.slice(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())), 1, most)


def cascade(*steps: tuple[str, Column]) -> Column:
    """struct(tags, source) of the first step with a tag; null if none has one."""
    step = lambda source, tags: let(tags, lambda t: F.when(F.size(t) > 0, F.struct(t.alias("tags"), F.lit(source).alias("source"))))
    return F.coalesce(*[step(source, tags) for source, tags in steps])


def vetoed(flag: Column, text: Column, against: str, hint: str) -> Column:
    """A true flag falls if `against` matches and `hint` does not; a false one never rises."""
    return flag & ~(text.rlike(against) & ~text.rlike(hint))


def labels(text: Column, aliases: dict[str, str], drop: list[str], most: int = 4, longest: int = 32) -> Column:
    """Parts at commas and slashes, aliased, coarse and overlong ones dropped, distinct without regard to spaces, at most `most`."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    parts = F.transform(F.split(F.lower(text), r"\s*[,/;]\s*"), lambda p: F.coalesce(F.try_element_at(table, F.trim(p)), F.try_element_at(table, F.replace(F.trim(p), F.lit(" "), F.lit(""))), F.trim(p)))
    kept = F.filter(parts, lambda p: (F.length(p) > 1) & (F.length(p) <= longest) & ~p.isin(drop))
    return F.slice(squashed(kept), 1, most)


def squashed(parts: Column) -> Column:
    """Labels, the first of those that differ only in what is no letter or digit."""

    def first_ones(both):
        return F.transform(F.filter(both, lambda x, i: F.array_position(both["key"], x["key"]) == i + 1), lambda x: x["label"])

    return let(F.transform(parts, lambda p: F.struct(p.alias("label"), F.regexp_replace(folded(p), r"[^a-z0-9]", "").alias("key"))), first_ones)


def merged_labels(*lists: Column, most: int = 4) -> Column:
    """Labels of several lists in one spelling, earlier lists first; null lists count as empty."""
    none = F.array().cast("array<string>")
    return canonical_labels(F.concat(*[F.coalesce(x, none) for x in lists]), most)


def plain(c: Column) -> Column:
    """What rules look at: lower case, no accents, straight apostrophes and hyphens; null counts as empty."""
    return F.regexp_replace(F.replace(folded(F.coalesce(c, F.lit(""))), F.lit("’"), F.lit("'")), "[‐‑–—]", "-")


def genres(existing: Column, source_label: Column, title: Column, description: Column, venue_default: Column) -> Column:
    """struct(tags, source): what the event has, else by the source's label, else by title, else by description (two at most), else the
    venue's own; null where none has a tag."""
    by_title = let(plain(title), lambda t: by_rules(t, TEXT_RULES))
    by_text = let(by_title, lambda t: F.when(F.size(t) > 0, t).otherwise(let(plain(description), lambda x: by_rules(x, TEXT_RULES, 2))))
    return cascade(("site", existing), ("site", by_rules(plain(source_label), SITE_RULES)), ("rules", by_text), ("venue", venue_default))


def is_concert(flag: Column, text: Column, venue: Column) -> Column:
    """A true flag falls for texts that name another kind of date and nothing of music, the venue's own name left out."""
    name = plain(venue)
    rest = F.when(name == "", plain(text)).otherwise(F.replace(plain(text), name, F.lit(" ")))
    return vetoed(flag, rest, NON_MUSIC, MUSIC_HINT)


WEAK = ("", "rules", "venue")


def enriched(genres: Column, source: Column, is_music: Column, subgenres: Column, found_genres: Column, found_music: Column, found_subgenres: Column, by: str = "llm") -> Column:
    """struct(genres, genre_source, is_music, subgenres) after an enrichment: its genres replace weak ones only, it takes the music flag
    away only there, and its sub-genres come after the event's own. Nulls found change nothing."""
    weak = F.coalesce(source, F.lit("")).isin(*WEAK)
    take = weak & (F.size(F.coalesce(found_genres, F.array().cast("array<string>"))) > 0)
    return F.struct(
        F.when(take, found_genres).otherwise(genres).alias("genres"),
        F.when(take, F.lit(by)).otherwise(source).alias("genre_source"),
        (is_music & ~(weak & ~F.coalesce(found_music, F.lit(True)))).alias("is_music"),
        merged_labels(subgenres, found_subgenres).alias("subgenres"),
    )


def needs_tags(is_music: Column, source: Column, subgenres: Column, strong=("site", "llm")) -> Column:
    """Concerts whose genres are weak or that have no sub-genre."""
    return is_music & (~F.coalesce(source, F.lit("")).isin(*strong) | (F.coalesce(F.size(subgenres), F.lit(0)) <= 0))


def tag_noise(tags: Column, title: Column, venue: Column, noise: list[str]) -> Column:
    """Distinct tags without noise words, those that hold the venue's name and those that the title says already, whatever their case."""
    said, house = F.lower(title), F.lower(venue)
    return F.array_distinct(F.filter(tags, lambda t: (t != "") & ~F.lower(t).isin(noise) & ~F.contains(F.lower(t), house) & ~F.contains(said, F.lower(t))))


# Fixed value: what separates labels.
BETWEEN = r"(?iU)\s*(?:,|/|;|\||•|\+|\bet\b|\band\b(?! (?:bass|roll)))\s*"


def label_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(plain(c), r"[^a-z0-9&']+", " "))


def light(c: Column) -> Column:
    """Without what stands in brackets, hashes and marks at the edges."""
    return squeeze(F.regexp_replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(.*?\)", " "), F.lit("#"), F.lit(" ")), r"^[ .\-–—:*]+|[ .\-–—:*]+$", ""))


def canonical_labels(labels: Column, most: int = 4, longest: int = 32) -> Column:
    """Sub-genres in one spelling: coarse, short, long and format labels out, one of those that differ in blanks and hyphens only."""
    spell = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    tight = lambda k: F.replace(F.replace(k, F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    coarse = F.array(*map(F.lit, sorted({w for c in COARSE for w in (c, c.replace(" ", ""))} | {w.replace("-", " ").replace("/", " ") for w in COARSE})))

    def spelt(x):
        clean = light(x)
        key = F.regexp_replace(label_key(clean), r"\s+et assimiles$", "")
        return F.coalesce(F.try_element_at(spell, key), F.try_element_at(spell, F.replace(key, F.lit(" "), F.lit(""))), F.lower(clean))

    def good(x):
        key = label_key(x)
        return (F.length(key) >= 3) & (F.length(x) <= longest) & ~F.array_contains(coarse, key) & ~F.array_contains(coarse, F.replace(key, F.lit(" "), F.lit(""))) & ~key.rlike(FORMAT)

    kept = F.filter(F.transform(F.filter(labels, lambda x: x.isNotNull()), spelt), good)
    both = F.transform(kept, lambda x: F.struct(x.alias("label"), tight(label_key(x)).alias("key")))
    return F.slice(let(both, lambda b: F.transform(F.filter(b, lambda x, i: F.array_position(b["key"], x["key"]) == i + 1), lambda x: x["label"])), 1, most)


def sub_genres(source_label: Column) -> Column:
    """Sub-genres that a source's own label names: its parts that look like a style, in one spelling."""
    parts = F.filter(F.split(light(source_label), BETWEEN), lambda p: (p != "") & plain(p).rlike(STYLE))
    return canonical_labels(parts)
