"""Joining groups back to rows, in its broadcast and its shuffled half."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm.shared import attach_groups


@pytest.mark.parametrize("total", [0, 500, 5_000, 10**9])
def test_attach_groups_whatever_counts_as_hot(spark, total):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i % 40}", "clash") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, n string")
    groups = df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 10")
    got = attach_groups(df, groups, "k", "size", total).collect()
    counts = {}
    for i, k, _ in rows:
        counts.setdefault(k, []).append(i)
    assert sorted(r["id"] for r in got) == list(range(600))
    for r in got:
        own = counts[r["k"]]
        want = (len(own), own[0]) if r["k"] is not None and len(own) > 10 else None
        assert (want is None) == (r["_group"] is None)
        assert want is None or (r["_group"]["size"], r["_group"]["least"]) == want
