"""DuckDB twin of the advice parsing jobs."""

from __future__ import annotations

from .. import constants as K

RESPONSES = """responses AS (
SELECT conv_id, turn, role,
       concat(text, chr(10), '[advice]', chr(10),
         '[{"action":"', CASE conv_id % 3 WHEN 0 THEN 'Ramp Metering' WHEN 1 THEN 'shoulder-running' ELSE 'unknown thing' END,
         '","target":"', CASE turn % 2 WHEN 0 THEN 'I-405 S' ELSE 'US-101 northbound' END,
         '","magnitude":"', CAST(turn AS VARCHAR), '","lanes":', CAST(turn % 4 AS VARCHAR), '}', CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',]' ELSE ']' END,
         CASE conv_id % 4 WHEN 0 THEN '' ELSE concat(chr(10), '[/advice]') END) AS response
FROM conversations WHERE role = 'assistant')"""

_STRUCT = "{" + ", ".join(f'"{f}": "VARCHAR"' for f in K.ADVICE_FIELDS) + "}"


def _parse(x: str) -> str:
    return f"CASE WHEN json_valid({x}) AND starts_with(ltrim({x}), '[') THEN from_json({x}, '[\"JSON\"]') END"


def _str(x: str) -> str:
    return f"(CASE WHEN lower(trim({x})) IN ('', 'null') THEN NULL ELSE trim({x}) END)"


def items_sql() -> str:
    open_re = r"\[advice\][ \t]*\r?\n"
    actions = ", ".join(f"'{a}'" for a in K.ACTION_TYPES)
    dirs = ", ".join(f"'{d}'" for d in K.COMPASS)
    target = f"COALESCE({_str('it.target')}, {_str('it.target_label')}, {_str('it.corridor')})"
    expected = f"COALESCE({_str('it.expected_effect')}, {_str('it.effect')}, {_str('it.expected')})"
    act_raw = _str("COALESCE(it.action_type, it.action)")
    compass = r"regexp_extract(upper(target), '\b([NSEW])B?\b', 1)"
    word = r"regexp_extract(lower(target), '\b(north|south|east|west)bound\b', 1)"
    explicit = f"upper({_str('it.direction')})"
    return f"""WITH {RESPONSES},
b0 AS (SELECT conv_id, turn, response, regexp_extract(response, '{open_re}', 0) AS m FROM responses),
b1 AS (SELECT *, CASE WHEN m <> '' THEN strpos(response, m) END AS o FROM b0),
b2 AS (SELECT *, o + length(m) AS body_start FROM b1),
b3 AS (SELECT *, CASE WHEN body_start IS NOT NULL THEN
         CASE WHEN strpos(substring(response, body_start), '[/advice]') > 0
              THEN strpos(substring(response, body_start), '[/advice]') + body_start - 1 ELSE 0 END END AS c FROM b2),
b4 AS (SELECT conv_id, turn, CASE WHEN o > 0 THEN trim(CASE WHEN c > 0 THEN substring(response, body_start, c - body_start)
         ELSE substring(response, body_start) END) END AS block FROM b3),
b5 AS (SELECT *, regexp_replace(block, ',(\\s*[}}\\]])', '\\1', 'g') AS nc FROM b4),
b6 AS (SELECT *, CASE WHEN starts_with(ltrim(nc), '[') AND strpos(nc, '}}') > 0 THEN concat(regexp_replace(
         substring(nc, 1, length(nc) - strpos(reverse(nc), '}}') + 1), ',\\s*$', ''), ']') END AS cut FROM b5),
parsed AS (SELECT conv_id, turn, COALESCE({_parse('block')}, {_parse('nc')}, {_parse('cut')}) AS items FROM b6),
exploded AS (SELECT conv_id, turn, CAST(raw AS VARCHAR) AS raw, from_json(raw, '{_STRUCT}') AS it, pos FROM (
             SELECT conv_id, turn, unnest(items) AS raw, unnest(generate_series(0, len(items) - 1)) AS pos FROM parsed WHERE items IS NOT NULL)),
x0 AS (SELECT conv_id, turn, pos, raw, it, {target} AS target, {expected} AS expected, {act_raw} AS action_raw,
         lower(regexp_replace({act_raw}, '[\\s-]+', '_', 'g')) AS action_key FROM exploded),
x1 AS (SELECT * FROM x0 WHERE target IS NOT NULL OR expected IS NOT NULL),
x2 AS (SELECT conv_id, turn, pos,
  CASE WHEN action_key IN ({actions}) THEN action_key ELSE 'other' END AS action_type,
  CASE WHEN action_key IN ({actions}) THEN NULL ELSE action_raw END AS action_type_raw,
  COALESCE(target, 'unspecified') AS target_label,
  COALESCE(upper({_str('it.corridor')}), NULLIF(upper(regexp_extract(target, '(?i)\\b((?:I|US|SR|CA)-\\d+)\\b', 1)), ''))
    AS target_corridor,
  CASE WHEN {explicit} IN ({dirs}) THEN {explicit} WHEN {compass} IN ({dirs}) THEN {compass}
       WHEN {word} <> '' THEN upper(substring({word}, 1, 1)) END AS target_direction,
  COALESCE(expected, 'unspecified') AS expected_effect,
  CASE WHEN lower({_str('it.effect_direction')}) IN ('decrease', 'increase', 'unclear')
       THEN lower({_str('it.effect_direction')}) END AS effect_direction,
  CASE WHEN NOT isnan(TRY_CAST(trim(it.magnitude) AS DOUBLE)) THEN TRY_CAST(trim(it.magnitude) AS DOUBLE) END AS magnitude, {_str('it.magnitude_unit')} AS magnitude_unit,
  CASE WHEN lower({_str('it.confidence')}) IN ('low', 'medium', 'high') THEN lower({_str('it.confidence')}) END AS confidence,
  {_str('it.rationale')} AS rationale,
  raw
FROM x1),
x3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS INT) AS seq FROM x2)
SELECT * EXCLUDE (pos) FROM x3 WHERE seq < {K.MAX_RECOMMENDATIONS}"""


PERIOD = """CASE WHEN {h} BETWEEN 6 AND 9 THEN 'AM peak' WHEN {h} BETWEEN 10 AND 14 THEN 'midday off-peak'
  WHEN {h} BETWEEN 15 AND 18 THEN 'PM peak' WHEN {h} BETWEEN 19 AND 22 THEN 'evening' ELSE 'overnight' END"""


def summary_sql() -> str:
    body = items_sql()
    head, tail = body.rsplit("\nSELECT * EXCLUDE (pos) FROM x3", 1)
    hour = "(conv_id * 7 + turn * 13) % 96 // 4"
    return (head + ",\nitems AS (SELECT * EXCLUDE (pos) FROM x3" + tail + f"""),
runs AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'user' AND (conv_id + turn) % 3 = 0)
SELECT action_type, target_corridor, {PERIOD.format(h=hour)} AS period, count(*) AS recommendations,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.conv_id = i.conv_id AND r.turn = i.turn)) AS unconverted
FROM items i GROUP BY ALL""")
