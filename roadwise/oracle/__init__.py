"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each query is plain SQL over the driver's base tables: the derived tables are written as
CTEs in DuckDB's dialect, independently of the Spark plans. Dialect-neutral numeric
builders (rounding, BPR, grades) are shared with the library.
"""
