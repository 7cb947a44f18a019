import os

from tidemark.storage import discard, release, shared_dir, stage


def test_staged_tables_are_in_the_shared_folder_until_released(spark):
    where = shared_dir(spark).removeprefix("file://")
    release(spark)
    os.makedirs(where, exist_ok=True)
    before = set(os.listdir(where))
    a, b = stage(spark.range(5), "a"), stage(spark.range(3), "b")
    assert a.count() == 5 and len(set(os.listdir(where)) - before) == 2
    discard(a)
    assert len(set(os.listdir(where)) - before) == 1
    release(spark)
    assert set(os.listdir(where)) <= before
    discard(b)
