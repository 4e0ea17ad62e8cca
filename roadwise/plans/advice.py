"""Advice parsing over a table of model responses (SURVEY: H17-H20, H23, F7, D11, E20).

The reference parses one response at a time; here every response row is parsed with
column expressions (regexp, from_json, posexplode), so the job scales with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..functions import clock
from ..functions.numeric import E
from ..sources import tables as S
from .memo import plan

OPEN_TAG, CLOSE_TAG = K.ADVICE_TAGS
ITEM_SCHEMA = "struct<" + ", ".join(f"{f}: string" for f in K.ADVICE_FIELDS) + ">"


def _q(s: str) -> str:
    """SQL string literal of text whose backslashes are already SQL-escaped."""
    return "'" + s.replace("'", "\\'") + "'"


def _pattern(p: str) -> str:
    """A regular expression as a SQL literal."""
    return "'" + p.replace("\\", "\\\\") + "'"


def _re(s: str) -> str:
    return "".join("\\\\" + c if c in "[]()/.*+?{}|^$" else c for c in s)


@plan
def advice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H17 + H18: the fenced block of each response (an unclosed fence runs to the end),
    the prose without it, and the block parsed leniently: strict, then without trailing
    commas, then cut back to the last complete object and closed; NULL if all fail."""
    r = S.responses(spark, sf_dir)
    open_re = f"{_re(OPEN_TAG)}[ \\\\t]*\\\\r?\\\\n"
    b = r.selectExpr(
        "conv_id", "turn", "response",
        f"regexp_instr(response, {_q(open_re)}) AS o")
    b = b.selectExpr("*", f"CASE WHEN o > 0 THEN o + length(regexp_extract(response, {_q(open_re)}, 0)) END AS body_start")
    b = b.selectExpr("*", f"CASE WHEN body_start IS NOT NULL THEN locate({_q(CLOSE_TAG)}, response, body_start) END AS c")
    b = b.selectExpr(
        "conv_id", "turn",
        "CASE WHEN o > 0 THEN trim(CASE WHEN c > 0 THEN substring(response, body_start, c - body_start)"
        " ELSE substring(response, body_start) END) END AS block",
        "CASE WHEN o > 0 THEN trim(concat(substring(response, 1, o - 1), CASE WHEN c > 0 THEN"
        f" substring(response, c + {len(CLOSE_TAG)}) ELSE '' END)) ELSE trim(response) END AS prose")
    nocomma = "regexp_replace(block, ',(\\\\s*[}\\\\]])', '$1')"
    b = b.selectExpr("*", f"{nocomma} AS block_nc")
    cut = ("CASE WHEN startswith(ltrim(block_nc), '[') AND instr(block_nc, '}') > 0 THEN concat(regexp_replace("
           "substring(block_nc, 1, length(block_nc) - instr(reverse(block_nc), '}') + 1), ',\\\\s*$', ''), ']') END")
    # items stay text at first, so that fields without a name here are not lost
    b = b.selectExpr("*", f"COALESCE(from_json(block, 'array<string>'), from_json(block_nc, 'array<string>'), from_json({cut}, 'array<string>')) AS raws")
    return b.selectExpr("conv_id", "turn", "prose", "block", f"transform(raws, r -> struct(r AS raw, from_json(r, '{ITEM_SCHEMA}') AS it)) AS items",
                        "block IS NOT NULL AND raws IS NULL AS malformed")


def _str(x: str) -> str:
    """H23-style cleaning: trimmed, '' and 'null' become NULL."""
    return f"(CASE WHEN lower(trim({x})) IN ('', 'null') THEN NULL ELSE trim({x}) END)"


@plan
def advice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H19 + H20 + F7: normalised recommendations, at most five per response, with the
    item's ordinal; unknown actions become 'other' and keep the raw value."""
    b = advice_blocks(spark, sf_dir).filter("items IS NOT NULL")
    x = b.selectExpr("conv_id", "turn", "posexplode(items) AS (pos, item)").selectExpr("conv_id", "turn", "pos", "item.raw AS raw", "item.it AS it")
    target = f"COALESCE({_str('it.target')}, {_str('it.target_label')}, {_str('it.corridor')})"
    expected = f"COALESCE({_str('it.expected_effect')}, {_str('it.effect')}, {_str('it.expected')})"
    act_raw = _str("COALESCE(it.action_type, it.action)")
    act_key = f"lower(regexp_replace({act_raw}, '[\\\\s-]+', '_'))"
    actions = ", ".join(f"'{a}'" for a in K.ACTION_TYPES)
    x = x.selectExpr("conv_id", "turn", "pos", "raw", "it", f"{target} AS target", f"{expected} AS expected",
                     f"{act_raw} AS action_raw", f"{act_key} AS action_key").filter("target IS NOT NULL OR expected IS NOT NULL")
    compass = f"regexp_extract(upper(target), {_pattern(K.COMPASS_PATTERN)}, 1)"
    word = f"regexp_extract(lower(target), {_pattern(K.BOUND_PATTERN)}, 1)"
    explicit = f"upper({_str('it.direction')})"
    dirs = ", ".join(f"'{d}'" for d in K.COMPASS)
    x = x.selectExpr(
        "conv_id", "turn", "pos",
        f"CASE WHEN action_key IN ({actions}) THEN action_key ELSE 'other' END AS action_type",
        f"CASE WHEN action_key IN ({actions}) THEN NULL ELSE action_raw END AS action_type_raw",
        "COALESCE(target, 'unspecified') AS target_label",
        f"COALESCE(upper({_str('it.corridor')}), NULLIF(upper(regexp_extract(target, {_pattern(K.ROUTE_PATTERN)}, 1)), '')) AS target_corridor",
        f"CASE WHEN {explicit} IN ({dirs}) THEN {explicit} WHEN {compass} IN ({dirs}) THEN {compass}"
        f" WHEN {word} <> '' THEN upper(substring({word}, 1, 1)) END AS target_direction",
        "COALESCE(expected, 'unspecified') AS expected_effect",
        f"CASE WHEN lower({_str('it.effect_direction')}) IN ({', '.join(repr(e) for e in K.EFFECT_DIRECTIONS)})"
        f" THEN lower({_str('it.effect_direction')}) END AS effect_direction",
        "CASE WHEN NOT isnan(try_cast(trim(it.magnitude) AS DOUBLE)) THEN try_cast(trim(it.magnitude) AS DOUBLE) END AS magnitude",
        f"{_str('it.magnitude_unit')} AS magnitude_unit",
        f"CASE WHEN lower({_str('it.confidence')}) IN ({', '.join(repr(c) for c in K.CONFIDENCES)})"
        f" THEN lower({_str('it.confidence')}) END AS confidence",
        f"{_str('it.rationale')} AS rationale", "raw")
    x = x.selectExpr("*", "CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INT) AS seq")
    return x.filter(f"seq < {K.MAX_RECOMMENDATIONS}").drop("pos")


@plan
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its count of non-system messages (0 when none)."""
    conv = S.read_table(spark, sf_dir, "conversations", ["conv_id", "role"])
    sessions = conv.select("conv_id").distinct()
    counts = conv.filter("role <> 'system'").groupBy("conv_id").agg(E("count(1)").alias("message_count"))
    return sessions.join(counts, "conv_id", "left").selectExpr("conv_id", "COALESCE(message_count, 0) AS message_count")


@plan
def advice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations per action type, corridor and peak period of the snapshot they answer,
    and those that no scenario run was built from (an anti-join by the advice's turn)."""
    items = advice_items(spark, sf_dir)
    when = S.responses(spark, sf_dir).selectExpr("conv_id", "turn", f"{clock.period_label('CAST(bucket_idx DIV 4 AS INT)')} AS period")
    items = items.join(when, ["conv_id", "turn"]).withColumn("open", E("0L"))
    idle = items.join(S.advice_runs(spark, sf_dir), ["conv_id", "turn"], "left_anti").withColumn("open", E("1L"))
    each = items.selectExpr("action_type", "target_corridor", "period", "1L AS n", "open").unionByName(
        idle.selectExpr("action_type", "target_corridor", "period", "0L AS n", "open"))
    return each.groupBy("action_type", "target_corridor", "period").agg(E("sum(n)").alias("recommendations"), E("sum(open)").alias("unconverted"))
