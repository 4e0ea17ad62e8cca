"""Ordered packing of matrix cells into comma strings, and the reverse.

Packing is two-level so no group holds more than one bucket of stations at first: cells are
packed per (group keys, bucket) in index order, then the bucket strings of a group are
joined in bucket order. ``collect_list`` has no order, so each level sorts explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import E


def pack_ordered(cells: DataFrame, keys: list[str], bucket: str, index: str, values: list[str],
                 max_of: str | None = None) -> DataFrame:
    """One row per ``keys`` with n, first/last bucket, distinct index count and one comma
    string per value column, laid out bucket-major, index-minor (plus ``max_<col>`` of
    ``max_of`` when given)."""
    fields = ", ".join([index] + values)
    lvl1 = cells.groupBy(*keys, bucket).agg(
        E("count(1)").alias("_n"),
        E(f"max({max_of or index})").alias("_mx"),
        E(f"array_sort(collect_list(struct({fields})))").alias("_cells"))
    lvl1 = lvl1.selectExpr(
        *keys, bucket, "_n", "_mx", f"transform(_cells, x -> x.{index}) AS _idx",
        *[f"array_join(transform(_cells, x -> CAST(x.{v} AS STRING)), ',') AS _s_{v}" for v in values])
    sv = ", ".join(f"_s_{v}" for v in values)
    out = lvl1.groupBy(*keys).agg(
        E("CAST(sum(_n) AS INT)").alias("n"),
        E(f"CAST(min({bucket}) AS INT)").alias("first_bucket"),
        E(f"CAST(max({bucket}) AS INT)").alias("last_bucket"),
        E("CAST(size(array_distinct(flatten(collect_list(_idx)))) AS INT)").alias("stations"),
        E("CAST(max(_mx) AS INT)").alias(f"max_{max_of or index}"),
        E(f"array_sort(collect_list(struct({bucket}, {sv})))").alias("_rows"))
    extra = [f"max_{max_of}"] if max_of else []
    return out.selectExpr(*keys, "n", "first_bucket", "last_bucket", "stations", *extra,
                          *[f"array_join(transform(_rows, x -> x._s_{v}), ',') AS {v}" for v in values])


CHUNK = 1024


def pack_dense(cells: DataFrame, widths: DataFrame, keys: list[str], bucket: str, index: str, values: dict[str, int],
               buckets: int, window: int, first: int = 0) -> DataFrame:
    """``pack_ordered`` of the dense grid of the buckets from ``first`` to before ``buckets`` times ``width`` positions that ``widths`` (``keys``,
    ``width``) gives, from the cells seen alone: those missing take the default in ``values``. Cells meet in
    chunks of ``CHUNK`` positions of a bucket, where gaps are filled in place, so neither the grid nor any
    cell it lacks is joined or shuffled, and no group holds more than a chunk of cells."""
    entry = f"struct({index}, {', '.join(values)})"
    seen = cells.selectExpr(*keys, f"CAST({bucket} AS INT) AS bucket", f"CAST({index} DIV {CHUNK} AS INT) AS chunk", "CAST(NULL AS INT) AS width", f"{entry} AS cell")
    slots = widths.selectExpr(*keys, "width", f"explode(sequence({first}, {buckets - 1})) AS bucket").selectExpr(
        "*", f"explode(sequence(0, CAST((width - 1) DIV {CHUNK} AS INT))) AS chunk")
    rows = seen.unionByName(slots.select(*keys, "bucket", "chunk", "width").withColumn("cell", F.lit(None).cast(seen.schema["cell"].dataType)))
    g = rows.groupBy(*keys, "bucket", "chunk").agg(E("max(width) AS width"), E("collect_list(cell) AS cells"))
    blank = ", ".join(["'" + index + "', i", *[f"'{v}', CAST({d} AS INT)" for v, d in values.items()]])
    gaps = f"array_except(sequence(chunk * {CHUNK}, LEAST(width, chunk * {CHUNK} + {CHUNK}) - 1), transform(cells, x -> x.{index}))"
    g = g.selectExpr(*keys, "bucket", "chunk", "width", f"array_sort(concat(cells, transform({gaps}, i -> named_struct({blank})))) AS cells")
    g = g.selectExpr(*keys, f"CAST(bucket DIV {window} * {window} AS INT) AS from_bucket", "bucket", "chunk", "width", "size(cells) AS n",
                     *[f"array_join(transform(cells, x -> CAST(x.{v} AS STRING)), ',') AS {v}" for v in values])
    out = g.groupBy(*keys, "from_bucket").agg(
        E("CAST(sum(n) AS INT) AS n"), E("CAST(min(bucket) AS INT) AS first_bucket"), E("CAST(max(bucket) AS INT) AS last_bucket"),
        E("CAST(max(width) AS INT) AS stations"), E(f"array_sort(collect_list(struct(bucket, chunk, {', '.join(values)}))) AS r"))
    return out.selectExpr(*keys, "from_bucket", "n", "first_bucket", "last_bucket", "stations", *[f"array_join(transform(r, x -> x.{v}), ',') AS {v}" for v in values])


def unpack_all(packed: DataFrame, keep: list[str], columns: list[str], width: str, index: str) -> DataFrame:
    """One row per packed position with every column's value, bucket and index recovered from
    the position (dense layout: bucket = first + pos DIV width, index = pos MOD width). All columns
    are split side by side, so nothing is joined."""
    zipped = "arrays_zip(" + ", ".join(f"split({c}, ',')" for c in columns) + ")"
    rows = packed.selectExpr(*keep, "first_bucket", width, f"posexplode({zipped}) AS (_pos, _v)")
    return rows.selectExpr(*keep, f"CAST(first_bucket + _pos DIV {width} AS INT) AS bucket_idx", f"CAST(_pos % {width} AS INT) AS {index}",
                           *[f"CAST(_v.`{i}` AS INT) AS {c}" for i, c in enumerate(columns)])
