from unittest.mock import MagicMock

from pyspark.sql import functions as F

from millrace.shared import Folder, materialize, shared_folder


def session(settings):
    spark = MagicMock()
    spark.conf.get.side_effect = lambda key, default=None: settings.get(key, default)
    return spark


def test_folders_are_new_and_below_the_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    folders = {shared_folder(spark) for _ in range(10)}
    assert len(folders) == 10
    assert all(folder.startswith(f"{base}/") for folder in folders)


def test_without_the_setting_the_warehouse_holds_it():
    warehouse = {"spark.sql.warehouse.dir": "hdfs:///warehouse/"}
    assert shared_folder(session(warehouse)).startswith("hdfs:///warehouse/_shared/")
    both = warehouse | {"spark.checkpoint.dir": "hdfs:///shared/"}
    assert shared_folder(session(both)).startswith("hdfs:///shared/")


def test_a_checkpoint_folder_that_was_set_is_seen():
    spark = session({"spark.sql.warehouse.dir": "hdfs:///warehouse/"})
    spark.sparkContext.getCheckpointDir.return_value = "hdfs:///checkpoints/1-2-3"
    assert shared_folder(spark).startswith("hdfs:///checkpoints/1-2-3/")


def test_small_files_of_a_folder(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/state")
    assert folder.names() == [] and folder.read("a") is None
    folder.write("a", "one ü")
    folder.write("a", "two")
    folder.below("b").write("c", "")
    assert folder.read("a") == "two" and folder.below("b").read("c") == ""
    assert sorted(n for n in folder.names() if not n.startswith(".")) == ["a", "b"]
    folder.below("b").move_all(f"{tmp_path}/moved")
    assert (tmp_path / "moved" / "c").exists() and "b" not in folder.names()
    folder.delete("a")
    assert folder.read("a") is None


def test_materialized_rows_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    stored = materialize(spark.range(10).mapInPandas(count, "id bigint"))
    assert stored.count() == stored.select(F.sum("id")).count() * 10 == 10
    assert calls.value == 10
    assert stored.schema.simpleString() == "struct<id:bigint>"
    assert "Python" not in stored._jdf.queryExecution().executedPlan().toString()


def test_an_empty_result_keeps_its_columns(spark):
    stored = materialize(spark.range(0).withColumn("text", F.lit("x")))
    assert stored.columns == ["id", "text"]
    assert stored.count() == 0
