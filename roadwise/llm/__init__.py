"""Training-data operators on Spark: tokenizing, packing, joins, search, filters.

Every operator takes DataFrames and gives DataFrames; Spark partitions and shuffles the
work, and numpy or Arrow runs inside tasks only. Nothing else in the library imports this
package.
"""
