"""Sources and sinks: options of topics, files read back."""

from datetime import datetime

import pytest

from ledgerloom.schemas import DLQ, TYPED_EVENT
from ledgerloom.session import scratch_folder
from ledgerloom.sources import letters, topic

AT = datetime(2026, 1, 2, 3, 4, 5)


def test_topic_options():
    assert topic.topic_options("b:1", "trades", "g", 500) == {
        "kafka.bootstrap.servers": "b:1", "subscribe": "trades", "startingOffsets": "earliest",
        "kafka.group.id": "g", "maxOffsetsPerTrigger": "500",
    }
    assert topic.topic_options("b:1", "trades", partitions=[0, 7], start="latest") == {
        "kafka.bootstrap.servers": "b:1", "assign": '{"trades":[0,7]}', "startingOffsets": "latest",
    }
    assert letters.topic_options("b:1", "dead") == {
        "kafka.bootstrap.servers": "b:1", "topic": "dead", "kafka.acks": "all",
    }


def test_letters_come_back_from_files_and_a_replay_replaces_its_own(spark):
    folder = scratch_folder(spark, "letters")
    rows = [
        ("trades", 1, 5, '{"a":\n"\x00é"}', "bad json", 1, AT, "t:I"),
        ("trades", None, 6, None, None, 4, None, None),
    ]
    first, second = (spark.createDataFrame([r], DLQ) for r in rows)
    letters.write_letter_files(first, folder, 0)
    letters.write_letter_files(second, folder, 1)
    letters.write_letter_files(first, folder, 0)
    read = letters.read_letter_files(spark, folder)
    assert sorted(map(tuple, read.collect()), key=lambda r: r[2]) == rows
    letters.write_letter_files(spark.createDataFrame([], DLQ), folder, 1)
    assert letters.read_letter_files(spark, folder).count() == 1


@pytest.mark.parametrize("streaming", [False, True])
def test_typed_events_with_columns_beside_them(spark, streaming):
    folder = scratch_folder(spark, "typed") + "/rows"
    row = ("e", "t", "I", 1, 2, 3, "USD", AT, 9)
    spark.createDataFrame([row], f"{TYPED_EVENT}, id bigint").write.parquet(folder)
    assert topic.read_typed_events(spark, folder, streaming).columns[-1] == "occurred_at"
    read = topic.read_typed_events(spark, folder, streaming, extra="id bigint")
    assert read.isStreaming == streaming and read.columns[-1] == "id"
    if not streaming:
        assert [tuple(r) for r in read.collect()] == [row]
