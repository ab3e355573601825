"""Business calendar (CAL-*).

The calendar is generated with ``sequence`` + ``explode`` for a date range;
its size is one row per day (bounded by the range, never by the facts); the
planner picks its join to a fact table from the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def federal_holiday_name(d: Column) -> Column:
    """US federal holidays by rule (observed-date shifts are not applied,
    matching the reference's holiday table).

    Fixed values: New Year's Day Jan 1; Martin Luther King Jr. Day third
    Monday of January; Presidents' Day third Monday of February; Memorial
    Day last Monday of May; Independence Day Jul 4; Labor Day first Monday
    of September; Thanksgiving Day fourth Thursday of November; Christmas
    Day Dec 25.
    """
    m, day, dow = F.month(d), F.dayofmonth(d), F.dayofweek(d)  # dayofweek: 1 = Sunday
    monday, thursday = dow == 2, dow == 5
    return (
        F.when((m == 1) & (day == 1), "New Year's Day")
        .when((m == 1) & monday & day.between(15, 21), "Martin Luther King Jr. Day")
        .when((m == 2) & monday & day.between(15, 21), "Presidents' Day")
        .when((m == 5) & monday & (day >= 25), "Memorial Day")
        .when((m == 7) & (day == 4), "Independence Day")
        .when((m == 9) & monday & (day <= 7), "Labor Day")
        .when((m == 11) & thursday & day.between(22, 28), "Thanksgiving Day")
        .when((m == 12) & (day == 25), "Christmas Day")
    )


def date_range_frame(spark: SparkSession, start: Column | str, end: Column | str) -> DataFrame:
    s = F.lit(start).cast("date") if isinstance(start, str) else start
    e = F.lit(end).cast("date") if isinstance(end, str) else end
    return spark.range(1).select(F.explode(F.sequence(s, e)).alias("calendar_date"))


def holidays_in(days: DataFrame, col: str = "calendar_date") -> DataFrame:
    """The rule-based holidays among a frame of dates."""
    return days.select(F.col(col).alias("holiday_date"), federal_holiday_name(F.col(col)).alias("holiday_name")).filter(
        F.col("holiday_name").isNotNull()
    )


def business_calendar(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """CAL-01: day name, day number (0 = Sunday), holiday flag, business day
    (Mon-Fri and not a holiday) and the previous business date.

    ``holidays`` (holiday_date, holiday_name) is a small table; without one the
    rule-based holidays count, found in each day's own row.  ``days`` is read once:
    the previous business date is a window over the calendar, which has
    one row a day however many facts there are.
    """
    if holidays is None:
        c = days.select("calendar_date", federal_holiday_name(F.col("calendar_date")).alias("holiday_name"))
        holiday = F.col("holiday_name").isNotNull()
    else:
        h = holidays.select("holiday_date", "holiday_name").dropDuplicates(["holiday_date"])
        c = days.join(h, F.col("calendar_date") == F.col("holiday_date"), "left")
        holiday = F.col("holiday_date").isNotNull()
    c = c.select(
        "calendar_date",
        F.date_format("calendar_date", "EEEE").alias("day_name"),
        (F.dayofweek("calendar_date") - 1).alias("day_number"),
        holiday.alias("is_holiday"),
        "holiday_name",
    ).withColumn("is_business_day", (F.col("day_number").between(1, 5)) & ~F.col("is_holiday"))
    earlier = W.partitionBy(F.lit(0)).orderBy("calendar_date").rowsBetween(W.unboundedPreceding, -1)
    business = F.when(F.col("is_business_day"), F.col("calendar_date"))
    return c.withColumn("previous_business_date", F.max(business).over(earlier))


def attach_calendar(fact: DataFrame, date_col: Column, calendar: DataFrame) -> DataFrame:
    """CAL-02: add the calendar columns to any fact table (one row a
    day; the planner picks the join from the sizes)."""
    cal = calendar
    return fact.join(cal, date_col.cast("date") == F.col("calendar_date"), "left")


def holiday_load(batch: DataFrame, existing: DataFrame, id_col: str, date_text: str, name: str) -> DataFrame:
    """CAL-03: split a holiday batch into accepted / rejected rows.

    Rejections: missing date, unparseable date, already present in
    ``existing``, or a repeat of an earlier row (by ``id_col``) of the same
    date in the batch; a name is not required.  The first row per date is found
    with a partial aggregate (min id per date), not a per-date sort, and
    broadcast: one row per calendar day, so a common date is no join key.
    """
    b = batch.select(
        id_col,
        F.col(date_text).alias("date_text"),
        F.col(name).alias("holiday_name"),
        F.try_to_timestamp(F.nullif(F.trim(date_text), F.lit("")), F.lit("yyyy-MM-dd")).cast("date").alias("holiday_date"),
    )
    first = b.filter(F.col("holiday_date").isNotNull()).groupBy("holiday_date").agg(F.min(id_col).alias("_first"))
    ex = existing.select(F.col("holiday_date").alias("_ex")).distinct()
    j = b.join(F.broadcast(first), "holiday_date", "left").join(F.broadcast(ex), F.col("holiday_date") == F.col("_ex"), "left")
    reason = (
        F.when(F.col("date_text").isNull() | (F.trim("date_text") == ""), "missing date")
        .when(F.col("holiday_date").isNull(), F.concat(F.lit("invalid date: "), F.col("date_text")))
        .when(F.col("_ex").isNotNull(), F.concat(F.lit("already exists: "), F.col("date_text")))
        .when(F.col(id_col) != F.col("_first"), F.concat(F.lit("duplicate in batch: "), F.col("date_text")))
    )
    return j.select(
        id_col, "holiday_date", "holiday_name",
        F.when(reason.isNull(), "accepted").otherwise("rejected").alias("load_status"),
        reason.alias("reason"),
    )


def holiday_stats(holidays: DataFrame, as_of: str) -> DataFrame:
    """AGG-17: total / upcoming / past relative to ``as_of``."""
    d = F.lit(as_of).cast("date")
    return holidays.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("holiday_date") >= d).alias("upcoming"),
        F.count_if(F.col("holiday_date") < d).alias("past"),
    )


def upcoming(holidays: DataFrame, as_of: str, n: int) -> DataFrame:
    """CAL-04: the next ``n`` holidays from ``as_of`` (a top-k)."""
    return holidays.filter(F.col("holiday_date") >= F.lit(as_of).cast("date")).orderBy("holiday_date").limit(n)
