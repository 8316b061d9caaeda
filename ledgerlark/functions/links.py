"""Calendar, map and share links, and how times and ages are shown. Column expressions; the reference date is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link formats.
CALENDAR = "https://calendar.google.com/calendar/render?"
MESSAGE = "https://api.whatsapp.com/send?text="
MAP = "https://www.google.com/maps/search/?api=1&query="
ROUTE = "https://www.google.com/maps/dir/?api=1&travelmode=transit&destination="
ZONE, MINUTES = "Europe/Paris", 150
# Characters that form encoding escapes and a URI component keeps; a blank is %20 there.
PLAIN = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
CLOCK = r"^([0-9]{1,2})\s*[:h]\s*([0-9]{2})?"


def component(c: Column) -> Column:
    """Percent-encoded as a component of a URI."""
    out = F.url_encode(c)
    for a, b in PLAIN.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def acts(headliner: Column, support: Column) -> Column:
    """'A with B, C'; a null or empty support adds nothing."""
    return F.when(F.size(support) > 0, F.concat(headliner, F.lit(" with "), F.array_join(support, ", "))).otherwise(headliner)


def agenda_dates(date: Column, time: Column, minutes: int = MINUTES) -> Column:
    """start/end in local time, or the day and the next where there is no time. Hours past 23 run on into the next day."""
    hour, minute = F.regexp_extract(time, CLOCK, 1), F.coalesce(filled(F.regexp_extract(time, CLOCK, 2)), F.lit("00"))
    after = F.when(time.rlike(CLOCK), hour.cast("int") * 60 + minute.cast("int"))
    start = date.cast("timestamp_ntz") + F.make_dt_interval(mins=F.coalesce(after, F.lit(0)))
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmm'00'")
    timed = F.concat_ws("/", stamp(start), stamp(start + F.make_dt_interval(mins=F.lit(minutes))))
    whole = F.concat_ws("/", F.date_format(date, "yyyyMMdd"), F.date_format(F.date_add(date, 1), "yyyyMMdd"))
    return F.when(after.isNotNull(), timed).otherwise(whole)


def place(venue: Column, *rest: Column) -> Column:
    """The venue and the first filled of the rest."""
    return F.concat_ws(", ", filled(venue), F.coalesce(*map(filled, rest)))


def calendar_url(share: Column, headliner: Column, support: Column, date: Column, time: Column, venue: Column, address: Column, area: Column, link: Column, price: Column) -> Column:
    """A link that fills in a calendar entry. Details are the share link, the ticket or page link and the price, those that there are."""
    fields = {
        "action": F.lit("TEMPLATE"),
        "text": F.concat(acts(headliner, support), F.lit(" @ "), venue),
        "dates": agenda_dates(date, time),
        "details": F.concat_ws("\n", filled(share), filled(link), filled(price)),
        "location": place(venue, address, area),
        "ctz": F.lit(ZONE),
    }
    return F.concat(F.lit(CALENDAR), F.concat_ws("&", *[F.concat(F.lit(k + "="), component(v)) for k, v in fields.items()]))


def map_query(venue: Column, address: Column, lat: Column, lon: Column) -> Column:
    """Name and address, encoded; the coordinates where both lack; else empty."""
    named = F.concat_ws(", ", filled(venue), filled(address))
    point = F.concat_ws(",", lat.cast("string"), lon.cast("string"))
    return F.when(named != "", component(named)).when(lat.isNotNull() & lon.isNotNull(), point).otherwise("")


def map_url(query: Column) -> Column:
    return F.concat(F.lit(MAP), query)


def route_url(query: Column) -> Column:
    return F.concat(F.lit(ROUTE), query)


def share_url(page: str, id: Column) -> Column:
    return F.concat(F.lit(page + "?e="), id)


def message_url(lines: Column) -> Column:
    """An array of lines, nulls and empty ones left out, as a message to send."""
    return F.concat(F.lit(MESSAGE), component(F.array_join(F.filter(lines, lambda x: x != ""), "\n")))


def clock(time: Column) -> Column:
    """H:MM; other text as it is; a dash where there is none."""
    hour, minute = F.regexp_extract(time, CLOCK, 1), F.coalesce(filled(F.regexp_extract(time, CLOCK, 2)), F.lit("00"))
    shown = F.when(time.rlike(CLOCK), F.concat_ws(":", F.regexp_replace(hour, "^0(?=.)", ""), minute)).otherwise(time)
    return F.coalesce(filled(shown), F.lit("—"))


def age(first_seen: Column, today: Column) -> Column:
    """'today', 'yesterday' or 'n days ago'; null for what has no date, such as a source's first run."""
    n = F.date_diff(today, F.try_to_date(first_seen, "yyyy-MM-dd"))
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n > 1, F.concat(n.cast("string"), F.lit(" days ago")))


def blurb(c: Column, limit: int = 260, cut: int = 240) -> Column:
    """Text over `limit` characters cut at a word before `cut`, with an ellipsis."""
    t = F.trim(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, cut), r"\s+\S*$", ""), F.lit("…")))
