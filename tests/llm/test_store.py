import pytest

from pulseloom.llm import store


def test_stored_and_cleared(spark):
    kept = store.stored(spark.range(5).withColumnRenamed("id", "x"), "kept")
    assert sorted(r["x"] for r in kept.collect()) == list(range(5))
    assert store.stored(kept.where("x > 9"), "none").collect() == []
    store.clear(spark)
    with pytest.raises(Exception):
        kept.count()
    system, path = store.local_or_fs(store.shared_dir(spark))
    assert system.type_name == "local" and path.startswith("/")


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        store.shared_dir(Session)
