"""Streams of a table that is a folder of files, as large tables are."""

import pytest

from credsieve.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["stream_scan", "stream_report"])
def test_folder_gives_the_rows_of_the_file(spark, folder, name):
    def rows(place):
        return sorted(map(repr, catalog.QUERIES[name](spark, place).collect()))

    assert rows(folder) == rows(SF) != []
