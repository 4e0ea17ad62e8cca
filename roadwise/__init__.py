"""roadwise: freeway-detector analytics and what-if scenarios as Spark DataFrame jobs.

Sub-packages
------------
functions  Column -> Column expressions (traffic measures, clock, geometry, text)
sources    table readers, the derived fixture tables, sinks
operators  reusable DataFrame operators (quality rules, bucketed range/spatial joins,
           ordered packing, dense indexes, checked broadcast)
plans      the jobs: medallion tables, dashboard queries, network geometry,
           scenario engine, snapshots, advice parsing
streaming  Structured Streaming variant of the 5 -> 15 minute frame rollup
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
