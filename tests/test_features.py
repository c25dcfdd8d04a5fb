"""Nested feature files as a table: pushed conditions, errors as rows, whole or no results."""

import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.sources import features as fe


def written(folder, name, found):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(found if isinstance(found, bytes) else fe.encode(found))


@pytest.fixture
def stored(tmp_path):
    signal = lambda k: np.arange(4) + k
    for c, split in (("real", "train"), ("deepfake", "train"), ("real", "test")):
        base = f"data/{c}/{split}/rgb/mask"
        written(tmp_path, f"{base}/pulse_a.npy", {"face": [{"POS": signal(1), "R": signal(2)}, {"POS": signal(3)}], "nose": [{"POS": signal(4)}]})
        written(tmp_path, f"{base}/pulse_b.npy", [{"face": [{"POS": [1, 2]}]}, {"face": [{"POS": signal(9)}], "chin": []}, "else"])
    written(tmp_path, "data/real/train/rgb/mask/pulse_bad.npy", b"not an array")
    evil = np.empty((), object)
    evil[()] = {"face": [{"POS": _Evil()}]}
    np.save(tmp_path / "data/real/train/rgb/mask/pulse_evil.npy", evil, allow_pickle=True)
    written(tmp_path, "data/real/train/rgb/mask/other.npy", {"face": [{"POS": signal(0)}]})
    return tmp_path / "data"


class _Evil:
    def __reduce__(self):
        return os.system, ("touch /tmp/never-made-by-a-feature-file",)


def test_every_signal_is_a_row_and_every_error_too(spark, stored):
    rows = fe.scan_features(spark, str(stored), pattern="pulse_*.npy").collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 3 * 6 and {(r["class"], r["split"], r["method"], r["roi_type"]) for r in rows} == {("real", "train", "rgb", "mask"), ("deepfake", "train", "rgb", "mask"), ("real", "test", "rgb", "mask")}
    assert sorted((r["file"].rsplit("/", 1)[1], r["region"], r["entry"], r["signal_type"], r["values"][0]) for r in good if r["class"] == "deepfake") == [
        ("pulse_a.npy", "face", 0, "POS", 1.0), ("pulse_a.npy", "face", 0, "R", 2.0), ("pulse_a.npy", "face", 1, "POS", 3.0), ("pulse_a.npy", "nose", 0, "POS", 4.0), ("pulse_b.npy", "face", 0, "POS", 1.0), ("pulse_b.npy", "face", 1, "POS", 9.0)]
    bad = {r["file"].rsplit("/", 1)[1]: r["error"] for r in rows if r["error"]}
    assert set(bad) == {"pulse_bad.npy", "pulse_evil.npy"} and "isn't allowed" in bad["pulse_evil.npy"] and not os.path.exists("/tmp/never-made-by-a-feature-file")


def test_conditions_reach_the_reader(spark, stored):
    df = fe.scan_features(spark, str(stored), ["file", "class", "region", "signal_type"])
    chosen = df.where((F.col("class") == "real") & F.col("region").isin("nose", "chin") & (F.col("signal_type") == "POS"))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan pulse_features" in plan and "Filter (" not in plan and "values" not in plan, plan  # all conditions are the source's
    assert [(r["class"], r["region"]) for r in chosen.collect()] == [("real", "nose")] * 2
    assert df.where("class = 'none'").collect() == [] and df.where("region = 'face' AND region = 'nose'").collect() == []
    assert fe.scan_features(spark, str(stored)).where("class = 'deepfake' AND size(values) = 2").count() == 1


def test_pushed_filters_and_partitions(stored):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith
    from pyspark.sql.types import StructType

    reader = fe.FeatureReader({"path": str(stored), "partitionbytes": "1"}, StructType.fromDDL(fe.SCHEMA))
    left = list(reader.pushFilters([EqualTo(("class",), "real"), In(("region",), ("face", "nose")), StringStartsWith(("split",), "te"), IsNotNull(("values",)), EqualTo(("entry",), 1)]))
    assert left == [EqualTo(("entry",), 1), IsNotNull(("values",))]
    paths = [p for part in reader.partitions() for p in part.paths]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["pulse_a.npy", "pulse_b.npy"] and len(reader.partitions()) == 2
    assert all(row[5] in ("face", "nose") for part in reader.partitions() for row in reader.read(part))


def test_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("real/train/rgb/mask/f"), (F.col("id") % 7).cast("string"), F.lit(".npy")).alias("file"), F.lit("face").alias("region"), F.floor(F.col("id") / 7).cast("int").alias("entry"), F.lit("POS").alias("signal_type"), F.array(F.col("id").cast("double")).alias("values"))
    folder = str(tmp_path / "out")
    fe.save_features(rows, folder)
    back = fe.scan_features(spark, folder)
    assert sorted(r["values"][0] for r in back.collect()) == list(map(float, range(40)))
    broken = rows.withColumn("entry", F.when(F.col("values")[0] == 39, -1).otherwise(F.col("entry")))
    with pytest.raises(Exception):
        fe.save_features(broken, folder)
    assert back.count() == 40 and not any(files for _, _, files in os.walk(folder + "-staged"))
    fe.save_features(rows.where("values[0] < 7"), folder)
    assert fe.scan_features(spark, folder).count() == 7


def test_plain_arrays_and_unknown_shapes():
    import io

    out = io.BytesIO()
    np.save(out, np.arange(3.0))
    assert fe.decode(out.getvalue()).tolist() == [0, 1, 2] and list(fe.signals_of(fe.decode(out.getvalue()))) == []
    assert list(fe.signals_of(5)) == [] and pickle.loads(pickle.dumps(fe.Files(["a"]))).paths == ["a"]
