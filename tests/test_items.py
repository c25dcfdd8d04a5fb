"""Rows by number: only their row groups are read."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pulseloom.sources import items as it


def test_slices_read_their_row_groups_alone(spark, tmp_path):
    for k in range(3):
        table = pa.table({"v": pa.array(range(100 * k, 100 * k + 100), pa.int64()), "s": [f"text{j}" for j in range(100)]})
        pq.write_table(table, tmp_path / f"part-{k}.parquet", row_group_size=30, compression="none", use_dictionary=False)
    folder = str(tmp_path)
    index = it.item_index(spark, folder)
    found = index.orderBy("first").collect()
    assert [(r["rows"], r["first"]) for r in found] == [(n, 100 * k + f) for k in range(3) for n, f in ((30, 0), (30, 30), (30, 60), (10, 90))]
    # all row groups but one become rubbish: a slice of that one is still read
    meta = pq.read_metadata(tmp_path / "part-1.parquet")
    content = bytearray((tmp_path / "part-1.parquet").read_bytes())
    for g in (0, 2, 3):
        for c in range(2):
            column = meta.row_group(g).column(c)
            content[column.data_page_offset : column.data_page_offset + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    (tmp_path / "part-1.parquet").write_bytes(content)
    assert sorted((r["item"], r["v"], r["s"]) for r in it.item_slice(spark, folder, index, 135, 150).collect()) == [(k, k, f"text{k - 100}") for k in range(135, 150)]
    with pytest.raises(Exception):
        it.item_slice(spark, folder, index, 100, 110).collect()
    numbers = spark.createDataFrame([(n,) for n in (0, 29, 30, 99, 140, 140, 200, 299, 300, -1, None)], "item long")
    assert sorted((r["item"], r["v"]) for r in it.items(spark, folder, index, numbers, ["v"]).collect()) == [(n, n) for n in (0, 29, 30, 99, 140, 200, 299)]
    assert it.item_slice(spark, folder, index, 10, 10).collect() == []
