"""Lookups in token files read the row groups that can hold the ids, and no others."""

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import token_orc
from tarnflow.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tokens')}/t"
    docs = spark.range(12_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text of number "), F.col("id").cast("string")).alias("text"))
    token_orc.write_token_files(docs.coalesce(1), path, tokenizer_path("byte_bpe_50k.json"))
    return path


def rows_read(df):
    """Rows that the scan handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_lookup_reads_few_row_groups(spark, files):
    all_rows = rows_read(token_orc.read_token_files(spark, files))
    one = token_orc.lookup(spark, files, [7_000])
    assert [r.doc_id for r in one.collect()] == [7_000] and all_rows == 12_000
    assert rows_read(one) <= token_orc.ROW_INDEX_STRIDE
    assert rows_read(token_orc.lookup(spark, files, [2_000, 22_000])) <= 2 * token_orc.ROW_INDEX_STRIDE
    # an odd id lies inside the ranges of the row index: only the Bloom filter can tell that it is not there
    some = [rows_read(token_orc.lookup(spark, files, [i])) for i in range(5_001, 5_061, 2)]
    assert sum(x > 0 for x in some) <= 3
    assert rows_read(token_orc.lookup(spark, files, [10**9])) == 0


def test_lookup_of_many_and_odd_ids(spark, files):
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(token_orc.lookup(spark, files, range(0, 1000))) == list(range(0, 1000, 2))
    asked = spark.createDataFrame([(4,), (4,), (None,), (5,)], "wanted long")
    assert ids(token_orc.lookup(spark, files, asked, "wanted")) == [4]
    assert ids(token_orc.lookup(spark, files, [])) == [] and ids(token_orc.lookup(spark, files, [4, 4, -1])) == [4]
    whole = token_orc.lookup(spark, files, [10]).first()
    assert whole.ids[-1] == token_orc.END_ID and len(whole.ids) > 3
