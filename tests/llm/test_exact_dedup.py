from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup
from lectern.llm.common import with_groups
from lectern.llm.exact_dedup import duplicate_groups
from tests.llm.conftest import rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups(docs, keep):
    got = [(r["keep_id"], -1 if r["doc_id"] is None else r["doc_id"], r["group_size"], r["kept"]) for r in duplicate_groups(docs, keep=keep).collect()]
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        k = (min if keep == "smallest" else max)(known) if known else None
        seen = False
        for i in ids:
            stays = i == k and not seen
            seen |= stays
            want.append((k, -1 if i is None else i, len(ids), stays))
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_drop(docs, empty):
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r["text"] or "") for r in out.collect()) == sorted({r[1] or "" for r in rows()})
    assert exact_dedup.drop_duplicates(empty).count() == 0
    assert duplicate_groups(empty).count() == 0


def test_hot_group(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text").repartition(16)
    out = duplicate_groups(df, fan_in=2)
    assert out.filter("kept").count() == 1 + 5000 - 1667
    assert out.filter("keep_id = 0").count() == 1667


def test_hot_group_meets_no_task(spark):
    """Rows of a group with a third of the table are spread over the join's partitions like others."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('t', id % 1000)) AS digest", "id")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_groups(rows, groups, ["digest"], F.col("id"), 3000, 4)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 1.3 * 3000 / 4
        assert out.join(groups.withColumnRenamed("n", "m"), "digest").filter("n <=> m").count() == out.count() == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_row_that_repeats_often(spark):
    df = spark.range(2501).selectExpr("7L AS doc_id", "'same' AS text")
    out = duplicate_groups(df)
    assert out.count() == 2501 and out.filter("kept").count() == 1 and out.filter("group_size = 2501").count() == 2501


def test_bad_keep(docs):
    with pytest.raises(ValueError):
        duplicate_groups(docs, keep="any")
