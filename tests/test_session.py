"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.session import CLEANUP, scratch_dir, written


def fake(master, folder=None):
    """Just the parts of a session that name the scratch folder."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_the_configured_folder_is_used():
    path = scratch_dir(fake("yarn", "hdfs:///shared/"), "x")
    assert path.startswith("hdfs:///shared/app-1/x-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(fake("spark://host:7077"))


def test_a_local_run_falls_back_to_one_temporary_folder():
    first, second = scratch_dir(fake("local[4]")), scratch_dir(fake("local[4]"))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_written_tables_keep_rows_and_types(spark):
    df = spark.range(10).selectExpr("id", "cast(id AS string) AS s", "timestamp_ntz'2024-01-01 00:00:00' AS t")
    back = written(df)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(back.collect()) == sorted(df.collect())


def test_scratch_tables_are_released_but_for_those_still_read(spark):
    from tidemark import session

    held = session.scratch_tables()
    one, two = session.written(spark.range(3), "one"), session.written(spark.range(4), "two")
    own = [p for p in session.scratch_tables() if p not in held]
    session.release(spark, own, two.where("id > 1"))
    assert two.count() == 4 and not session.path_exists(spark, own[0]) and session.path_exists(spark, own[1])
    session.release(spark, own)
    assert not session.path_exists(spark, own[1]) and session.scratch_tables() == held
    del one


def test_written_keeps_the_cleanup_setting_and_its_tables_can_be_read_again(spark):
    before = spark.conf.get(CLEANUP, None)
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert sorted(r.n for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert spark.conf.get(CLEANUP, None) == before
    again = written(table.join(table.withColumnRenamed("n", "m"), "k"), "joined")
    assert again.count() == 7 and again.where("n = m").count() == 7
