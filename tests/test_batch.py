"""Folders of text files through the batch: first run, resume, fencing, reports."""

import pytest
from test_paper_run import answer

from veristrand.__main__ import main
from veristrand.plans.batch import Heartbeat, LeaseLost, Ocr, Tables, claim, run_batch, status_of, still_held

CALLS = "calls.txt"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("papers")
    (root / "one.txt").write_text("\f".join(f"A page of paper 1, number {n}, says something." for n in range(1, 6)))
    (root / "copy.txt").write_text((root / "one.txt").read_text())
    (root / "bad.txt").write_text("UNREADABLE")
    return root


def counted(log):
    def generator(model, prompt):
        with open(log, "a") as f:
            f.write(prompt.split(" ", 1)[0] + "\n")
        return answer(model, prompt)

    return generator


def no_diagrams(log):
    inner = counted(log)

    def generator(model, prompt):
        return "no picture" if prompt.startswith("Draw") else inner(model, prompt)

    return generator


def drawing(log):
    inner = counted(log)

    def generator(model, prompt):
        return "===DIAGRAM_START: One===\ngraph A { a -- b }" if prompt.startswith("Draw") else inner(model, prompt)

    return generator


def statuses(df):
    return sorted(r["status"] for r in df.collect())


def test_batch(spark, folder, tmp_path, capsys):
    t = Tables(spark, f"file://{tmp_path}/tables")
    log = tmp_path / CALLS
    scanned = Ocr(lambda raw, at: "A page of paper 1 as it was read." if b"paper 1" in raw else "", "profile-a", budget=2)
    assert statuses(run_batch(t, str(folder), no_diagrams(log), lambda: 1000.0, ocr=scanned)) == ["FAILED", "PARTIAL"]
    assert sorted((r["page_idx"], r["ocr_profile"], r["text"][:6]) for r in t.ocr_cache.read().collect()) == [(0, "profile-a", ""), (0, "profile-a", "A page"), (1, "profile-a", "A page")]
    first = log.read_text().split()
    assert first.count("Quote") >= 1
    assert statuses(run_batch(t, str(folder), drawing(log), lambda: 2000.0, render=lambda dot: f"<svg>{len(dot)}</svg>")) == ["COMPLETE", "FAILED"]
    assert t.diagrams.read().first()["svg_content"].startswith("<svg>")
    later = log.read_text().split()[len(first) :]
    assert later.count("Quote") == 2  # those of the failed paper: the evidence of the first run is used again
    assert statuses(run_batch(t, str(folder), drawing(log), lambda: 3000.0)) == ["ALREADY_COMPLETE", "FAILED"]
    paper = t.papers.read().where("paper_name = 'copy'").first()
    assert paper["strategy"].startswith("hierarchical-evidence-v1 (1 chunks, 0 reduce levels") and t.papers.read().count() == 1  # nothing of a failed paper
    assert paper["page_count"] == 5 and paper["source_corpus"] and len(paper["sections_completed"]) == 5 and t.diagrams.read().count() == 1
    got = {r["pdf_path"].rsplit("/", 1)[1]: r["status"] for r in status_of(t, str(folder), 4000.0).collect()}
    assert got["copy.txt"] == "complete" and got["one.txt"] == "not started"  # the same bytes, known by their first path
    for command in (["list", str(folder)], ["entities"], ["graph", str(tmp_path / "graph")]):
        assert main(["--tables", f"file://{tmp_path}/tables", *command]) == 0
    out = capsys.readouterr().out
    assert "+   " in out and "processing_leases" in out
    assert spark.read.parquet(str(tmp_path / "graph" / "edges")).count() >= 5
    assert main(["--tables", f"file://{tmp_path}/tables", "clear", "diagrams"]) == 0
    assert t.diagrams.read().count() == 0 and "diagrams" not in t.papers.read().first()["sections_completed"]


def test_claims(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/tables")
    keys = spark.createDataFrame([("sha256:a",), ("sha256:b",)], "resource_key string")
    mine = claim(t, keys, "me", 0.0, stale=100)
    assert {r["generation"] for r in mine.collect()} == {1}
    assert claim(t, keys, "you", 50.0, stale=100).count() == 0
    yours = claim(t, keys.limit(1), "you", 150.0, stale=100)
    assert [r["generation"] for r in yours.collect()] == [2]
    held = still_held(t, mine, 90.0, stale=100)
    assert [r["paper_hash"] for r in held.collect()] == ["b"]
    assert still_held(t, mine, 190.0, stale=100).count() == 0


def test_unknown_section(spark, tmp_path):
    with pytest.raises(ValueError):
        run_batch(Tables(spark, f"file://{tmp_path}"), str(tmp_path), answer, lambda: 0.0, reprocess="poem")


def test_racing_claims(spark, tmp_path):
    """Of claimants at once one wins each key."""
    from concurrent.futures import ThreadPoolExecutor

    t = Tables(spark, f"file://{tmp_path}/tables")
    keys = spark.createDataFrame([("sha256:a",), ("sha256:b",)], "resource_key string")
    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda who: [tuple(r) for r in claim(t, keys, who, 0.0, stale=100).select("resource_key", "owner_id").collect()], ["x", "y", "z"]))
    assert sorted(k for w in won for k, _ in w) == ["sha256:a", "sha256:b"] and t.leases.read().count() == 2


def test_heartbeat(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/tables")
    now = [0.0]
    mine = claim(t, spark.createDataFrame([("sha256:a",), ("sha256:b",)], "resource_key string"), "me", 0.0, stale=100)
    for interval in (0, 50, 100):
        with pytest.raises(ValueError):
            Heartbeat(t, mine, lambda: 0.0, interval, 100)
    beat = Heartbeat(t, mine, lambda: now[0], 10, 100)
    now[0] = 90.0
    assert beat.held().count() == 2
    now[0] = 180.0  # without the renewal at 90 another could have it
    assert claim(t, spark.createDataFrame([("sha256:a",)], "resource_key string"), "you", 180.0, stale=100).count() == 0
    assert claim(t, spark.createDataFrame([("sha256:a",)], "resource_key string"), "you", 195.0, stale=100).count() == 1
    now[0] = 185.0
    with pytest.raises(LeaseLost):
        now[0] = 195.0
        beat.held()


def test_commit_survives_other_heartbeats(spark, tmp_path, monkeypatch):
    """Each time a batch has staged its papers another batch renews and claims: the papers are still staged once."""
    from pyspark.sql import functions as F

    from veristrand.plans import batch
    from veristrand.sources import tables

    t = Tables(spark, f"file://{tmp_path}/tables")
    key = lambda c: spark.createDataFrame([("sha256:" + c * 64,)], "resource_key string")
    mine, yours = claim(t, key("a"), "me", 0.0), claim(t, key("b"), "you", 0.0)
    paper = spark.createDataFrame([("a" * 64, "a" * 64, "/p/one.txt", 3, "m", None)], "paper string, paper_hash string, path string, page_count int, model string, code_model string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    args = (paper, none("paper_hash string, source_corpus string"), none("paper_hash string, section string, answer string, error string"), none("paper_hash string, page_idx int, ocr_profile string, text string"), "t1")
    staged, publish = [], tables.Root._publish

    def crowded(self, state, number):
        if "papers" in state["wrote"]:
            staged.append(state["wrote"]["papers"]["at"])
            if len(staged) < 4:
                batch.renew(t, yours, float(len(staged)))
        publish(self, state, number)

    monkeypatch.setattr(tables.Root, "_publish", crowded)
    own, state = batch._commit(t, mine, *args, lambda: 5.0, 100.0, None)
    assert len(staged) == 4 and len(set(staged)) == 1 and state.count() == own.count() == 1
    assert t.papers.read().first()["paper_name"] == "one" and t.leases.read().where(F.col("renewed_at") == 3.0).count() == 1
    # a lease that is lost before the commit is no longer written under
    batch.release(t, mine)
    own, state = batch._commit(t, mine, *args, lambda: 5.0, 100.0, None)
    assert own.count() == 0 and t.papers.read().count() == 1


def test_interrupted(spark, folder, tmp_path):
    """A batch that is asked to stop stores nothing and gives its leases back."""
    t = Tables(spark, f"file://{tmp_path}/tables")
    asked = []
    got = run_batch(t, str(folder), drawing(tmp_path / CALLS), lambda: 1.0, stop=lambda: asked.append(1) or len(asked) > 2)
    assert statuses(got) == ["INTERRUPTED"] * 2 and t.papers.read().count() == 0
    assert t.leases.read().where("active").count() == 0


def test_lost_leases_stop_before_sections(spark, folder, tmp_path):
    """A batch whose papers another claims while it reads evidence writes no section and no row."""
    t = Tables(spark, f"file://{tmp_path}/tables")
    log, now = tmp_path / CALLS, [0.0]

    def clock():
        now[0] += 60.0  # each look at the clock is later than a lease lives
        return now[0]

    assert statuses(run_batch(t, str(folder), drawing(log), clock, interval=20, stale=50)) == ["CLAIMED_ELSEWHERE"] * 2
    assert t.papers.read().count() == 0 and t.diagrams.read().count() == 0
    assert "Draw" not in (log.read_text() if log.exists() else "")
