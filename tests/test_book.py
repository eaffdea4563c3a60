"""The derived tables of a book: made when they are asked for, documents laid out where their policies lie."""

import os

import pytest
from pyspark.sql import functions as F

from checks.views import DerivedBook, deriver, spark_view
from harborbook.operators.lineage import shared_folder

SF = "/root/testdata/sf0.001"


def test_only_tables_that_are_asked_for_are_derived(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    book = DerivedBook(deriver(spark, SF))
    assert book.submissions.count() > 0 and book.submissions is book.submissions
    assert book.addresses.count() > 0
    (made,) = set(os.listdir(folder)) - before
    assert set(os.listdir(f"{folder}/{made}")) == {"policy_keys", "submissions", "addresses"}
    with pytest.raises(AttributeError):
        book.policy_keys


@pytest.mark.parametrize("name", ["rating", "quotes"])
def test_policies_are_dealt_out_and_not_their_documents(spark, tmp_path, name):
    path = str(tmp_path / "policy_keys")
    spark_view(spark, SF, "policy_keys").write.parquet(path)
    view = spark_view(spark, SF, name, {"policy_keys": path}, 3)
    plan = view._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = [i for i, x in enumerate(plan) if "Repartition" in x]
    laid_out = [i for i, x in enumerate(plan) if "replace(" in x]
    assert len(dealt) == 1 and laid_out and dealt[0] > laid_out[-1]
    assert view.select(F.spark_partition_id()).distinct().count() == 3
    assert view.exceptAll(spark_view(spark, SF, name)).count() == 0
