"""Plans of the operators that use DataFrame functions only, and what their scans read."""

import re

import pytest

from tessera.llm import mixing, order_minhash, quality_rules, secret_scan
from tessera.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_sharding", "op3_secret_scan", "op8_order_minhash", "op9_mixing"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin|LocalCheckpoint", text)


def test_scans_read_only_what_is_needed(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    read = lambda df: set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)))
    assert read(quality_rules.score(docs)) == {"doc_id:bigint,text:string,lang:string"}
    assert read(secret_scan.scan(docs, [0.0] * secret_scan.SPAN**2)) == {"doc_id:bigint,text:string"}
    assert read(order_minhash.fingerprints(docs)) == {"doc_id:bigint,text:string"}
    assert all("text" not in r for r in read(mixing.mix(docs)))  # sizes are in a slim table by then
