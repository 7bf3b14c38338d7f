import os

import pytest

from factline.llm import storage


class Unset:
    """A session that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        applicationId, master = "app-1", "local[2]"


class Cluster(Unset):
    class sparkContext:
        applicationId, master = "app-2", "spark://host:7077"


def test_the_cluster_names_the_folder(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    own = storage.shared_dir(Unset)
    assert own.startswith("file://") and storage.shared_dir(Unset) == own
    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)


def test_tables_of_a_scope_go(spark):
    df = spark.range(3)
    with storage.scope() as keep:
        gone, stays = storage.cut(df, "t"), storage.cut(df, "t")
        keep.append(stays)
        places = [x.inputFiles()[0].removeprefix("file://") for x in (gone, stays)]
    assert [os.path.exists(x) for x in places] == [False, True]
    storage.discard(stays)
    assert not os.path.exists(places[1])


def test_cut_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    back = storage.cut(df, "t")
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == [(1, None), (2, "x")]
    assert storage.shared_dir(spark).split("://")[-1] in back.inputFiles()[0]


def test_known_rows_go_to_few_files_without_checksum_files(spark):
    df = spark.range(0, 400, 1, 40).toDF("u")
    back = storage.cut(df, "t", 400)
    files = [x.removeprefix("file://") for x in back.inputFiles()]
    assert sorted(r.u for r in back.collect()) == list(range(400))
    assert len(files) <= spark.sparkContext.defaultParallelism
    assert not [x for x in os.listdir(os.path.dirname(files[0])) if x.endswith(".crc")]
