from conftest_rows import LONG, SCHEMA, TEXTS, rows_of  # noqa: F401

SF = "/root/testdata/sf0.01"


def documents_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
