import os

import pytest

from spoorline import session
from spoorline.sources import files


def test_a_job_releases_its_tables(spark, tmp_path):
    with session.releasing(spark):
        kept = session.stored(spark.range(5), "numbers")
        folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder) and kept.count() == 5
    assert not os.path.exists(folder)
    assert session.stored(spark.range(3), "numbers").count() == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch_dir(Cluster, "x")


def test_an_inventory_serves_as_a_listing(spark, tmp_path):
    (tmp_path / "inventory.csv").write_text("path,length\n/a/b.jpg,10\n")
    found = files.read_inventory(spark, str(tmp_path / "inventory.csv"), "csv").collect()
    assert [tuple(r) for r in found] == [("/a/b.jpg", 10)]
