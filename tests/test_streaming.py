"""New files, growing answers and silent leases as streams, against their batch twins."""

import json

import pytest
from test_batch import drawing, statuses

from veristrand.operators import leases
from veristrand.plans.batch import Tables
from veristrand.sources import answers
from veristrand.sources.generator import stream_answer
from veristrand.streaming.leases import silence_stream
from veristrand.streaming.papers import paper_stream


def test_new_files(spark, tmp_path):
    """Two triggers take each file once, also after a restart; copies of a paper are asked about once."""
    folder, log = tmp_path / "in", tmp_path / "calls.txt"
    folder.mkdir()
    page = lambda i: "\f".join(f"A page of paper {i}, number {n}, says something." for n in range(1, 4))
    (folder / "one.txt").write_text(page(1))
    (folder / "copy.txt").write_text(page(1))
    (folder / "note.md").write_text("not asked for")
    t, got = Tables(spark, f"file://{tmp_path}/tables"), []

    def run():
        told: list = []
        q = paper_stream(t, str(folder), drawing(log), lambda: 1000.0, f"file://{tmp_path}/ckpt", told=lambda df: told.extend(statuses(df))).trigger(availableNow=True).start()
        q.awaitTermination(300)
        got.append(told)

    run()
    (folder / "two.txt").write_text(page(2))
    run()
    first = log.read_text().split()
    run()  # a restart with nothing new
    assert got == [["COMPLETE"], ["COMPLETE"], []] and log.read_text().split() == first
    assert first.count("Quote") == 2 and t.papers.read().count() == 2


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def test_silence(spark, tmp_path, rocks):
    """A lease is lost when its timer says so, without a later event of its own."""
    ddl = "key long, event_id long, ts double"
    batches = [[(1, 1, 1000.0), (2, 2, 1010.0), (3, 3, 1005.0)], [(1, 4, 1060.0), (2, 5, 1110.0)], [(3, 6, 1070.0), (4, 7, 1400.0)]]
    told: list = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        q = silence_stream(source, 100).writeStream.foreachBatch(lambda df, _: told.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination(200)
        if i == 0:
            assert told == []
    events = spark.createDataFrame([r for b in batches for r in b], ddl)
    want = {r["key"]: r["lost_at"] for r in leases.lost_by_silence(events, 100, until=1400.0).collect()}
    assert dict(told) == want == {1: 1050.0, 2: 1060.0, 3: 1055.0} and len(told) == 3


def test_growing_answers(spark, tmp_path):
    """Lines are read once, whole ones only, after a restart too; the last state is the batch's."""
    answers.register(spark)
    folder = tmp_path / "answers"
    folder.mkdir()
    say = lambda text, **more: json.dumps({"response": text} | more, ensure_ascii=False) + "\n"
    a, b, many = folder / "a.ndjson", folder / "sub.ndjson", folder / "many.ndjson"
    a.write_text(say("Hel") + say("lo ä") + '{"response": " cut')
    many.write_text(say("x", request="r1") + say("y", request="r2", thinking="hmm"))
    seen: list = []

    def run():
        texts: dict = {}
        lines = spark.readStream.format("answers").load(str(folder))
        q = stream_answer(lines).writeStream.foreachBatch(lambda df, _: texts.update((r["request"], (r["text"], r["done"])) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination(200)
        seen.append(texts)

    run()
    with open(a, "a") as f:
        f.write(' off"}\n' + say("!", done=True) + say("late"))
    with open(many, "a") as f:
        f.write(say("z" * 3_000_000, request="r1") + "\n")
    b.write_text("no JSON\n" + say("other"))
    run()
    run()
    assert seen[0] == {"a": ("Hello ä", False), "r1": ("x", False), "r2": ("y", False)}
    assert seen[1] == {"a": ("Hello ä cut off!", True), "r1": ("x" + "z" * 3_000_000, False), "sub": ("other", False)} and seen[2] == {}
    batch = {r["request"]: (r["text"], r["done"]) for r in stream_answer(spark.read.format("answers").load(str(folder))).collect()}
    assert batch == seen[0] | seen[1]
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("answers").load(str(empty)).count() == 0
