"""Time, value, distance and score of offers, as Column expressions.

Weekdays are ISO (1 Monday .. 7 Sunday); times of day are minutes, 1440 is midnight at the end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
#: Fixed values of the ranking.
LIVE, SOON, LATER, UPCOMING, UNREACHABLE, UNKNOWN = range(6)
LOOKAHEAD = 180
GROUP_WEIGHT = 100_000
FAR_MILES = 999
ENOUGH_MINUTES = 120
TIME_WEIGHT, DRIVE_WEIGHT = 10, 12
PENALTY = {"verified": 0, "likely": 3, "unconfirmed": 9, "disputed": 99}
OTHER_PENALTY = 9
UNCONFIRM_DAYS, HIDE_DAYS = 45, 120
DRINKS = ("draft", "bottle_can", "wine", "well", "call", "cocktail", "shot")
DAY_SHORT = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
DAY_LONG = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def when_text(live: Column, day_ahead: Column, start: Column, end: Column, starts_in: Column, until: Column) -> Column:
    """What a card says of the time: when it ends, when it starts and how soon, or from when to when."""
    return (
        F.when(live, F.concat(F.lit("Ends in "), duration(until)))
        .when(day_ahead == 0, F.concat(clock(start), F.lit(" · in "), duration(starts_in)))
        .otherwise(F.concat(clock(start), F.lit("–"), clock(end)))
    )


def fine_text(group: Column, live: Column, until: Column, drive: Column, fine_print: Column, has_items: Column) -> Column:
    """The fine print, or a word on missing prices, behind a warning where the drive takes the most of it."""
    said = F.when(F.coalesce(fine_print, F.lit("")) != "", fine_print).when(has_items, "").otherwise("Window published without prices.")
    usable = usable_minutes(until, drive)
    warning = (
        F.when(group == UNREACHABLE, F.concat(F.lit("It ends in "), duration(until), F.lit(" and you're about "), drive.cast("string"), F.lit(" minutes away. ")))
        .when(live & drive.isNotNull() & (usable < 30), F.concat(F.lit("About "), duration(usable), F.lit(" of it left by the time you arrive. ")))
        .otherwise("")
    )
    return F.trim(F.concat(warning, said))


def trust_text(confidence: Column, age_days: Column) -> Column:
    age = F.when(age_days == 0, "today").otherwise(F.concat(age_days.cast("string"), F.lit("d ago")))
    return F.when(confidence == "unconfirmed", F.concat(F.lit("Unconfirmed — call ahead · "), age)).otherwise(F.concat(F.lit("Checked "), age))


def iso_dow(date: Column) -> Column:
    return F.weekday(date) + 1


def minutes(clock: Column) -> Column:
    """Minutes of `HH:MM`, 24:00 included; null if it isn't one."""
    parts = F.split(clock, ":")
    return F.when(clock.rlike(r"^\d{2}:\d{2}$"), parts[0].cast("int") * 60 + parts[1].cast("int"))


def clock(minute: Column) -> Column:
    """`4pm`, `4:30pm`, `midnight`."""
    hour = F.floor(minute / 60)
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    suffix = F.when(hour >= 12, "pm").otherwise("am")
    left = minute % 60
    text = F.concat(twelve.cast("string"), F.when(left > 0, F.concat(F.lit(":"), F.lpad(left.cast("string"), 2, "0"))).otherwise(""), suffix)
    return F.when(minute >= 1440, "midnight").otherwise(text)


def duration(n: Column) -> Column:
    """`42 min`, `1h`, `1h 35m`."""
    hours, left = F.floor(n / 60).cast("string"), n % 60
    return F.when(n < 60, F.concat(n.cast("string"), F.lit(" min"))).when(left > 0, F.concat(hours, F.lit("h "), left.cast("string"), F.lit("m"))).otherwise(F.concat(hours, F.lit("h")))


def money(x: Column) -> Column:
    whole = x == F.floor(x)
    return F.concat(F.lit("$"), F.when(whole, F.floor(x).cast("string")).otherwise(F.format_string("%.2f", x)))


def item_amount(price: Column, pct: Column, off: Column) -> Column:
    """What stands before an item's label: price first, then percentage, then amount off."""
    percent = F.when(pct == F.floor(pct), F.floor(pct).cast("string")).otherwise(pct.cast("string"))
    return (
        F.when(price.isNotNull(), money(price)).when(pct.isNotNull(), F.concat(percent, F.lit("% off"))).when(off.isNotNull(), F.concat(money(off), F.lit(" off"))).otherwise("")
    )


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    lat, lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    s = F.pow(F.sin(lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(lng), F.lit(2))
    return 2 * EARTH_MILES * F.asin(F.sqrt(s))


def tenths(x: Column) -> Column:
    """x (below 9e14) to one decimal, by its exact value and half to even: what a double holds is seldom the decimal that it is written as (0.35 is less, 2.675 as well).

    What is behind the point is exact, and is held against the halves between tenths. Of these a double can be 0.25 and 0.75 alone; of
    the others the nearest double lies on one side, which is known beforehand.
    """
    whole, rest = F.floor(F.abs(x)), F.abs(x) - F.floor(F.abs(x))
    over = F.lit(0)
    for i in range(10):
        half = (2 * i + 1) / 20
        side = Decimal(half) - Decimal(2 * i + 1) / 20
        above = side > 0 if side else i % 2 == 1  # a tie goes to the even tenth
        over = over + F.when(rest >= half if above else rest > half, 1).otherwise(0)
    return F.when(x.isNotNull() & ~F.isnan(x), F.signum(x) * (whole * 10 + over) / 10)


def drive_minutes(miles: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(miles * 1.35 * 60 / 26 + 3 + 0.5))


def miles_text(miles: Column, precise: Column) -> Column:
    whole = F.floor(miles + 0.5).cast("string")
    return (
        F.when(miles < 0.1, "here")
        .when(~precise, F.concat(F.lit("~"), whole, F.lit(" mi")))
        .when(miles < 10, F.concat(F.format_string("%.1f", miles), F.lit(" mi")))
        .otherwise(F.concat(whole, F.lit(" mi")))
    )


def item_value(category: Column, price: Column, pct: Column, off: Column) -> Column:
    """How good an item is, for ordering alone."""
    by_price = F.when(category == "food", F.greatest(F.lit(0.0), 60 - price * 4)).otherwise(F.greatest(F.lit(0.0), 70 - price * 7))
    return F.when(pct.isNotNull(), pct).when(off.isNotNull(), off * 12).when(price.isNotNull(), by_price).otherwise(F.lit(0.0))


def age_days(at_date: Column, seen: Column) -> Column:
    return F.when(seen.isNotNull(), F.greatest(F.lit(0), F.datediff(at_date, seen)))


def effective_confidence(stated: Column, age: Column) -> Column:
    """Verified and disputed stay; older offers step down to unconfirmed and then out of sight."""
    return (
        F.when(stated.isin("verified", "disputed") | age.isNull(), stated)
        .when(age > HIDE_DAYS, "hidden")
        .when((age > UNCONFIRM_DAYS) & (stated == "likely"), "unconfirmed")
        .otherwise(stated)
    )


def occurrence(dow: Column, start: Column, end: Column, today: int, now: int) -> Column:
    """struct(day_ahead, waits, starts_in, start, end, until): the next time a window runs, least first.

    A window of today that is over runs again in seven days. `waits` is 0 for one that is on now.
    """
    ahead = F.when((dow == today) & (F.lit(now) >= end), F.lit(7)).otherwise(F.pmod(dow - today, F.lit(7)))
    live = (ahead == 0) & (start <= now)
    starts_in = F.when(live, F.lit(0)).otherwise(ahead * 1440 + start - now)
    until = F.when(live, end - now).otherwise(starts_in)
    return F.struct(
        ahead.alias("day_ahead"), F.when(live, 0).otherwise(1).alias("waits"), starts_in.alias("starts_in"), start.alias("start"), end.alias("end"), until.alias("until")
    )


def group_of(live: Column, until: Column, day_ahead: Column, starts_in: Column, drive: Column) -> Column:
    return (
        F.when(live & drive.isNotNull() & (until <= drive), UNREACHABLE)
        .when(live, LIVE)
        .when(day_ahead > 0, UPCOMING)
        .when(starts_in <= LOOKAHEAD, SOON)
        .otherwise(LATER)
    )


def usable_minutes(until: Column, drive: Column) -> Column:
    return F.greatest(F.lit(0), until - F.coalesce(drive, F.lit(0)))


def penalty(confidence: Column) -> Column:
    out = F.lit(OTHER_PENALTY)
    for name, n in PENALTY.items():
        out = F.when(confidence == name, n).otherwise(out)
    return out


def score(sort: str, group: Column, live: Column, until: Column, starts_in: Column, miles: Column, drive: Column, value: Column, confidence: Column) -> Column:
    """Lower is better: the group decides, then what `sort` names."""
    base = group * float(GROUP_WEIGHT)
    far = F.coalesce(miles, F.lit(float(FAR_MILES))) * 100
    worth = 100 - F.least(F.coalesce(value, F.lit(0.0)), F.lit(100.0))
    way, doubt = F.coalesce(drive, F.lit(0)), penalty(confidence)
    if sort == "nearest":
        known = base + far + doubt
    elif sort == "value":
        known = base + worth * 100 + way + doubt
    else:
        short = F.when(live, ENOUGH_MINUTES - F.least(usable_minutes(until, drive), F.lit(ENOUGH_MINUTES))).otherwise(starts_in)
        known = base + short * TIME_WEIGHT + way * DRIVE_WEIGHT + worth + doubt
    return F.when(group == UNKNOWN, F.lit(float(UNKNOWN * GROUP_WEIGHT)) + F.least(far, F.lit(99999.0))).otherwise(known)


def section(group: Column, day_ahead: Column, dow_ahead: Column) -> Column:
    day = F.element_at(F.array(*map(F.lit, DAY_LONG)), dow_ahead.cast("int"))
    return (
        F.when(group == LIVE, "Live now").when(group == SOON, "Starting soon").when(group == LATER, "Later today")
        .when(group == UNREACHABLE, "Ends before you'd get there").when(group == UNKNOWN, "Hours not published")
        .when(day_ahead == 1, "Tomorrow").otherwise(day)
    )
