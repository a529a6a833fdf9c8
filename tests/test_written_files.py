"""Tables written in row order: files, and with them the rows of a task, are bounded."""

import glob

import catalog.files
from limpid.storage import scratch_root


def test_written_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog.files, "FILE_ROWS", 100)
    spark.range(2000).selectExpr("id as o_orderkey", "if(id % 3 = 0, 'F', if(id % 3 = 1, 'O', null)) as o_orderstatus", "'p' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    before = set(glob.glob(f"{scratch_root(spark)}/*"))
    from catalog import QUERIES
    found = QUERIES["load_parquet"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == [("F", 0, 667), ("O", 1, 667), (None, 2, 666)]
    (folder,) = set(glob.glob(f"{scratch_root(spark)}/*")) - before
    assert len(glob.glob(f"{folder}/part-*")) >= 15
    assert "SortAggregate(key=[estado_final" not in found._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
