"""Status files as users have them."""

import pytest
from pyspark.sql import functions as F

from parcelflow.sources import readers as R


def statuses(spark, path, count):
    lots = spark.range(count).select(F.col("id").alias("i"))
    return [r.s for r in R.status_from_csv(R.read_status_csv(spark, str(path)), lots).orderBy("i").collect()]


def test_two_columns_by_header(spark, tmp_path):
    file = tmp_path / "status.csv"
    file.write_text("index,status\n0,vendido\n1, Reservado \nx,vendido\n2,disponivel\n3,\"bloqueado\"\n4,unknown\n5\n,vendido\n0,bloqueado\n", encoding="utf-8")
    assert statuses(spark, file, 8) == [3, 2, 0, 3, 0, 0, 0, 0]


def test_other_columns_and_order(spark, tmp_path):
    file = tmp_path / "status.csv"
    file.write_text("note,status,index\nfirst,vendido,1\n\"a, b\",reservado,0\n", encoding="utf-8")
    assert statuses(spark, file, 3) == [2, 1, 0]
    (tmp_path / "none.csv").write_text("position,status\n0,vendido\n", encoding="utf-8")
    assert statuses(spark, tmp_path / "none.csv", 2) == [0, 0]


def test_last_row_wins_across_splits_and_files(spark, tmp_path):
    """A file in many splits, then another file by name."""
    names = R.STATUS_NAMES_PT
    rows = [(i % 50, (i * 7 + i // 50) % 4) for i in range(5000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("index,status\n" + "".join(f"{i},{names[s]}\n" for i, s in rows), encoding="utf-8")
    want = dict(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert statuses(spark, tmp_path / "in", 50) == [want[i] for i in range(50)]
        (tmp_path / "in/b.csv").write_text("index,status\n3,bloqueado\n", encoding="utf-8")
        assert statuses(spark, tmp_path / "in", 50)[3] == 3
        (tmp_path / "in/c.csv").write_text("status,index\nvendido,3\n", encoding="utf-8")
        with pytest.raises(Exception):
            statuses(spark, tmp_path / "in", 50)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
