"""Extraction is dealt over tasks by rows, not by the bytes of its table."""

from factline import catalog

catalog.load()


def test_a_small_file_is_many_tasks(spark):
    got = catalog.QUERIES["extracted_symbols"](spark, "/root/testdata/sf0.01")
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 6000 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 2 * 6000 / len(sizes)
