"""Clock and calendar expressions, as SQL text.

Timestamps are TIMESTAMP_NTZ throughout: ``ts``/``time_bucket`` hold UTC wall time and
``local_ts`` Pacific wall time. ``convert_timezone`` on NTZ applies the zone rules
(including DST) independently of the session time zone.
"""

from __future__ import annotations

from .. import constants as K


def local_to_utc(local_ts: str, zone: str = K.LOCAL_TZ) -> str:
    """H1: wall-clock time in ``zone`` -> UTC wall time."""
    return f"convert_timezone('{zone}', 'UTC', {local_ts})"


def utc_to_local(ts: str, zone: str = K.LOCAL_TZ) -> str:
    """H1: UTC wall time -> wall-clock time in ``zone``."""
    return f"convert_timezone('UTC', '{zone}', {ts})"


def floor_to_minutes(ts: str, minutes: int = K.FRAME_MINUTES) -> str:
    """H2: truncate to the minute, then back to the start of the ``minutes`` bucket."""
    # date_trunc returns a session-zone TIMESTAMP; cast back so NTZ wall time is kept
    return f"timestampadd(MINUTE, -(minute({ts}) % {minutes}), CAST(date_trunc('MINUTE', {ts}) AS TIMESTAMP_NTZ))"


def bucket_idx(local_ts: str) -> str:
    """H3: 0..95 local 15-minute bucket = hour*4 + minute DIV 15."""
    return f"CAST(hour({local_ts}) * 4 + minute({local_ts}) DIV 15 AS INT)"


def bucket_label(bucket: str) -> str:
    """H4: bucket index -> 'HH:MM' (wraps modulo 96, negative-safe)."""
    b = f"pmod(CAST({bucket} AS INT), {K.BUCKETS_PER_DAY})"
    return f"format_string('%02d:%02d', {b} DIV 4, ({b} % 4) * 15)"


def bucket_hour(bucket: str) -> str:
    return f"(pmod(CAST({bucket} AS INT), {K.BUCKETS_PER_DAY}) DIV 4)"


def reading_date(local_ts: str) -> str:
    """H5: local calendar date."""
    return f"to_date({local_ts})"


def day_of_week(x: str) -> str:
    """H5: 1 = Sunday .. 7 = Saturday."""
    return f"dayofweek({x})"


def is_weekend(dow: str) -> str:
    return f"({dow} IN (1, 7))"


def day_name(date: str) -> str:
    """H5: 'Mon', 'Tue', ..."""
    return f"date_format({date}, 'EEE')"


def add_minutes(start: str, minutes: str) -> str:
    """H6: start + minutes."""
    return f"timestampadd(MINUTE, {minutes}, {start})"


def hour_frac(local_ts: str) -> str:
    """H7: hour + minute / 60."""
    return f"(hour({local_ts}) + minute({local_ts}) / 6e1)"


def snap_to_slot(day_start: str, hour_frac_expr: str) -> str:
    """H8: day start + floor(hour) hours + floor(fraction * 12) * 5 minutes."""
    h = f"({hour_frac_expr})"
    return (f"timestampadd(MINUTE, CAST(FLOOR({h}) AS INT) * 60"
            f" + CAST(FLOOR(({h} - FLOOR({h})) * 12) AS INT) * 5, {day_start})")


def peak_period(dow: str, hour: str) -> str:
    """B26 (a): WEEKEND / AM_PEAK (6-9) / PM_PEAK (15-18) / OFF_PEAK."""
    (a0, a1), (p0, p1) = K.AM_PEAK_HOURS, K.PM_PEAK_HOURS
    return (f"(CASE WHEN {is_weekend(dow)} THEN 'WEEKEND' WHEN {hour} BETWEEN {a0} AND {a1} THEN 'AM_PEAK'"
            f" WHEN {hour} BETWEEN {p0} AND {p1} THEN 'PM_PEAK' ELSE 'OFF_PEAK' END)")


def period_label(hour: str) -> str:
    """B26 (b): five-way operational period used in snapshot briefs."""
    return (f"(CASE WHEN {hour} >= 6 AND {hour} < 10 THEN 'AM peak'"
            f" WHEN {hour} >= 15 AND {hour} < 19 THEN 'PM peak'"
            f" WHEN {hour} >= 10 AND {hour} < 15 THEN 'midday off-peak'"
            f" WHEN {hour} >= 19 AND {hour} < 23 THEN 'evening' ELSE 'overnight' END)")
