"""Tables written to the shared folder."""

import pytest
from pyspark.sql import functions as F

from glossaria.shared import bucketed, frozen, scratch


def _shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(found.size()) if (f := found.apply(k).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 500)
    before = _shuffle_files(spark)
    sums = frozen(rows.groupBy("k").agg(F.sum("id").alias("s")), "sums")
    joined = rows.hint("merge").join(sums, "k").groupBy("s").count()
    tables = frozen(joined, "joined"), bucketed(joined, "joined", "s", 4), bucketed(joined, "joined", "s", 4)
    assert [t.count() for t in tables] == [500] * 3 and [t.agg(F.sum("count")).first()[0] for t in tables] == [20_000] * 3
    left = {f.split("_")[1] for f in _shuffle_files(spark) - before}
    assert len(left) <= 6  # what the counts and sums here leave, one shuffle each
    assert joined.count() == 500 and sums.agg(F.sum("s")).first()[0] == 20_000 * 19_999 // 2


def test_other_queries_keep_their_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    frozen(spark.range(10), "ten")
    assert spark.conf.get(name) == before


def test_near_duplicates_keep_only_the_tables_of_their_result(spark):
    neardup, common = (pytest.importorskip(f"glossaria.llm.{m}") for m in ("neardup", "common"))
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(words + [f"own{k % 7}"])) for k in range(60)], "doc_id long, text string")
    fs, path = common.file_system(spark, common.shared_dir(spark))
    tables = lambda: {s.getPath().getName() for s in fs.listStatus(path)}
    with scratch(spark) as made:
        before = tables()
        found = neardup.near_duplicates(docs)
        assert sorted(t.rsplit("-", 1)[0] for t in tables() - before) == ["classified", "least", "numbered"]
        assert len(made) == 3
        assert [r.component_id for r in found.collect()] == [0] * 60
    assert tables() == before
