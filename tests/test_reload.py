"""Partition maps read again per micro-batch."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.session import scratch_folder
from ledgerloom.streaming import reload

VERSIONS = "version bigint, value string"


@pytest.mark.parametrize(
    "rows, polled, ranges, problem",
    [
        ([], None, None, reload.NO_VERSION),
        ([(None, '{"a": {"count": 1}}')], None, None, reload.NO_VERSION),
        ([(1, '{"a": {"start": 0, "count": 2}, "b": {"count": 1}}')], 1, {"a": 2, "b": 1}, None),
        ([(1, '{"a": {"count": 2}}'), (3, '{"a": {"count": 3'), (2, "{}")], 3, None, reload.NO_MAP),
        ([(1, '{"a": {"count": 2}}'), (2, '{"a": {"count": 0}, "b": {"count": 1}}')], 2, {"a": 0, "b": 1}, reload.TOO_FEW),
        ([(1, '{"a": {"start": 2}}')], 1, {"a": 0}, reload.TOO_FEW),
        ([(1, "{}")], 1, {}, None),
        ([(1, "null")], 1, {}, None),
        ([(1, None)], 1, None, reload.NO_MAP),
    ],
)
def test_newest_version(spark, rows, polled, ranges, problem):
    found = reload.newest_map(spark.createDataFrame(rows, VERSIONS)).collect()
    assert [(r.polled, r.problem) for r in found] == [(polled, problem)]
    assert found[0].ranges == ranges


def test_the_last_good_map_stays_and_a_replayed_batch_keeps_its_own(spark):
    folders = reload.Folders(scratch_folder(spark, "reload"))
    published = []

    def versions():
        return spark.createDataFrame(published, VERSIONS)

    def unreadable():
        return spark.read.schema(VERSIONS).json(f"{folders.root}/nowhere")

    def told(batch_id, source=versions):
        polled = reload.poll(spark, source, folders, batch_id)
        row = polled.first()
        return row.polled, row.version, row.problem, {r.tenant_id: r.size for r in reload.reservations(polled).collect()}

    assert told(0) == (None, None, reload.NO_VERSION, {})
    published.append((1, '{"a": {"count": 2}}'))
    assert told(1) == (1, 1, None, {"a": 2})
    published.append((2, '{"a": {"count": 0}}'))
    assert told(2) == (2, 1, reload.TOO_FEW, {"a": 2})
    assert told(3, unreadable) == (None, 1, "PATH_NOT_FOUND", {"a": 2})
    published.append((4, '{"b": {"count": 5}}'))
    # The third batch again: what was published since does not move its rows.
    assert told(3) == (None, 1, "PATH_NOT_FOUND", {"a": 2})
    assert told(4) == (4, 4, None, {"b": 5})
    counted = reload.read_polls(spark, folders).orderBy("batch").collect()
    assert [r.reload_errors for r in counted] == [1, 1, 2, 3, 3]


def test_rows_go_by_the_map_of_their_batch(spark):
    root = scratch_folder(spark, "reload-stream")
    folders = reload.Folders(root)
    schema = "tenant_id string, instrument string"
    maps = {0: '{"a": {"count": 3}}', 1: "spoiled", 2: '{"a": {"count": 1}}'}
    for n, text in maps.items():
        spark.createDataFrame([("a", f"I{i}") for i in range(40)] + [("z", "I")], schema).coalesce(1).write.mode(
            "append"
        ).parquet(f"{root}/rows")
        stream = reload.start_placing(
            spark.readStream.schema(schema).parquet(f"{root}/rows"),
            lambda text=text, n=n: spark.createDataFrame([(n, text)], VERSIONS), folders, 1, 8,
        )
        stream.awaitTermination()
        assert stream.exception() is None
    placed = reload.read_placed(spark, folders, f"{schema}, partition bigint")
    own = placed.where("tenant_id = 'a'").groupBy("batch").agg(F.collect_set("partition").alias("p")).collect()
    assert {r.batch: set(r.p) for r in own} == {0: {0, 1, 2}, 1: {0, 1, 2}, 2: {0}}
    pool = placed.where("tenant_id = 'z'").collect()
    assert len(pool) == 3 and all(r.partition >= (3 if r.batch < 2 else 1) for r in pool)
