import os

from quillon.runtime import clear_scratch, remove, scratch_dir, ship_package, stash


def test_scratch(spark):
    df = stash(spark.range(5))
    where = scratch_dir(spark)
    kept = stash(spark.range(3), where)
    assert df.count() == 5 and kept.count() == 3 and where.startswith(spark.conf.get("spark.checkpoint.dir"))
    remove(spark, where)
    assert not os.path.exists(where.removeprefix("file:"))
    files = [f.removeprefix("file:").removeprefix("//") for f in df.inputFiles()]
    assert all(map(os.path.exists, files))
    clear_scratch(spark)
    assert not any(map(os.path.exists, files))


def test_package_reaches_workers(spark):
    ship_package(spark)
    ship_package(spark)
    from quillon.functions import stats

    assert spark.sparkContext.parallelize([1.0], 1).map(lambda z: stats.normal_two_sided(z)).collect()[0] < 0.32
