from types import SimpleNamespace

import pytest
from evalspark.llm import common


def session(master, **conf):
    settings = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)), sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_folder_is_the_applications_and_shared():
    assert common.shared_folder(session("yarn", spark_checkpoint_dir="hdfs://n/tmp/")) == "hdfs://n/tmp/evalspark/app"
    assert common.shared_folder(session("local[2]", spark_sql_warehouse_dir="/w")) == "/w/_evalspark/evalspark/app"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session("yarn", spark_sql_warehouse_dir="file:/w"))


def test_a_table_replaced_is_deleted(spark):
    first = common.written(spark.range(3), "numbers")
    second = common.written(first.where("id > 0"), "numbers", instead_of=first)
    assert second.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(first._written_path)
