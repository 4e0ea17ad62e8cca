"""Shared by the test modules (not a conftest: pytest loads several modules of that name)."""

SMALL = "/root/testdata/sf0.001"


def scalar(spark, sql: str):
    return spark.sql(f"SELECT {sql} AS v").collect()[0][0]
