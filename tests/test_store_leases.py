import pytest
from pyspark.sql import functions as F

from veristrand.constants import SECTIONS
from veristrand.operators import leases, reports, store
from veristrand.schemas import DIAGRAMS, PAPERS
from veristrand.sources import tables

H = [c * 64 for c in "abcd"]


def papers(spark, *rows):
    base = {f.name: None for f in PAPERS}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], PAPERS)


def by_hash(df):
    return {r["paper_hash"]: r for r in df.collect()}


def test_upsert_keeps_what_was_built(spark):
    table = papers(spark, {"paper_hash": H[0], "paper_name": "old", "sections_completed": ["summary"], "source_corpus": "kept", "created_at": "t0", "updated_at": "t0"}, {"paper_hash": H[1], "paper_name": "same", "sections_completed": [], "updated_at": "t0"})
    new = papers(spark, {"paper_hash": H[0], "paper_name": "new", "source_corpus": "lost"}, {"paper_hash": H[2], "paper_name": "added", "source_corpus": "first"})
    got = by_hash(store.upsert_meta(table, new, "t1"))
    assert (got[H[0]]["paper_name"], got[H[0]]["sections_completed"], got[H[0]]["source_corpus"], got[H[0]]["created_at"], got[H[0]]["updated_at"]) == ("new", ["summary"], "kept", "t0", "t1")
    assert (got[H[1]]["paper_name"], got[H[1]]["updated_at"]) == ("same", "t0")
    assert (got[H[2]]["sections_completed"], got[H[2]]["created_at"], got[H[2]]["source_corpus"]) == ([], "t1", "first")


def test_sections(spark):
    table = papers(spark, {"paper_hash": H[0], "sections_completed": ["summary"], "updated_at": "t0"}, {"paper_hash": H[1], "sections_completed": [], "updated_at": "t0"})
    content = spark.createDataFrame([(H[0], "new text"), (H[3], "no such paper")], "paper_hash string, content string")
    got = by_hash(store.write_sections(table, content, "summary", "t1"))
    assert (got[H[0]]["summary_md"], got[H[0]]["sections_completed"]) == ("new text", ["summary"]) and len(got) == 2
    got = by_hash(store.mark_complete(table, content, "diagrams", "t1"))
    assert got[H[0]]["sections_completed"] == ["summary", "diagrams"]
    with pytest.raises(ValueError):
        store.write_sections(table, content, "diagrams", "t1")
    corpus = spark.createDataFrame([(H[0], "c")], "paper_hash string, source_corpus string")
    assert by_hash(store.write_corpus(table, corpus, "t1"))[H[0]]["source_corpus"] == "c"
    done = papers(spark, {"paper_hash": H[0], "sections_completed": SECTIONS}, {"paper_hash": H[1], "sections_completed": ["cpp"]})
    assert [(r["paper_hash"], r["section"]) for r in store.pending_sections(done).orderBy("ord").collect()] == [(H[1], s) for s in SECTIONS if s != "cpp"]
    assert store.pending_sections(done, "all").count() == 10 and store.pending_sections(done, "cpp").count() == 6
    assert [r[0] for r in done.orderBy("paper_hash").select(F.array_join(store.missing_sections(F.col("sections_completed")), ",")).collect()] == ["", "diagrams,extras,logic,summary"]


def test_clear(spark):
    table = papers(spark, {"paper_hash": H[0], "sections_completed": ["summary", "diagrams"], "summary_md": "s", "extras_md": "e", "diagrams_raw": "r", "source_corpus": "c"})
    drawn = spark.createDataFrame([(H[0], 1, "t", "dot", None), (H[1], 1, "t", "dot", "svg")], DIAGRAMS)
    p, d = store.clear_section(table, drawn, "diagrams", "t1")
    assert p.first()["sections_completed"] == ["summary"] and p.first()["diagrams_raw"] is None and d.count() == 1
    p, d = store.clear_section(table, drawn, "all", "t1")
    r = p.first()
    assert (r["summary_md"], r["extras_md"], r["diagrams_raw"], r["sections_completed"], r["source_corpus"]) == (None, None, None, [], "c") and d.count() == 1
    with pytest.raises(ValueError):
        store.clear_section(table, drawn, "poem", "t1")


def test_diagrams_and_cache(spark):
    old = spark.createDataFrame([(H[0], 1, "a", "d", None), (H[0], 2, "b", "d", None), (H[1], 1, "c", "d", None)], DIAGRAMS)
    new = spark.createDataFrame([(H[0], [("x", "dx", "svg"), ("y", "dy", None), ("z", "dz", None)])], "paper_hash string, items array<struct<title:string,dot:string,svg:string>>")
    got = [(r["paper_hash"], r["idx"], r["title"]) for r in store.replace_diagrams(old, new).orderBy("paper_hash", "idx").collect()]
    assert got == [(H[0], 1, "x"), (H[0], 2, "y"), (H[0], 3, "z"), (H[1], 1, "c")]
    cache = spark.createDataFrame([(H[0], 0, "p", "")], "paper_hash string, page_idx int, ocr_profile string, text string")
    more = spark.createDataFrame([(H[0], 0, "p", "late", 1), (H[0], 0, "q", "second", 2), (H[0], 0, "q", "first", 1)], "paper_hash string, page_idx int, ocr_profile string, text string, seq int")
    got = store.put_first(cache, more, ["paper_hash", "page_idx", "ocr_profile"], "seq")
    assert {(r["ocr_profile"], r["text"]) for r in got.collect()} == {("p", ""), ("q", "first")}


def test_versioned_table(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}", "papers", PAPERS)
    assert t.version() == 0 and t.read().count() == 0
    t.write(papers(spark, {"paper_hash": H[0], "paper_name": "one"}))
    t.write(store.upsert_meta(t.read(), papers(spark, {"paper_hash": H[1], "paper_name": "two"}), "t1"))
    assert t.version() == 2 and t.read().count() == 2 and t.read(1).count() == 1
    other = tables.Table(spark, f"file://{tmp_path}", "more", PAPERS)
    assert tables.update([t, other], lambda v: [t.read(v).limit(1), t.read(v)], whole=True) == 3  # both in one step
    assert t.read().count() == 1 and other.read().count() == 2 and other.read(2).count() == 0
    late = t.stage(t.read())
    with pytest.raises(tables.Conflict):
        t.commits.commit(late, 2)
    (tmp_path / "_commits" / "00000004.json").write_text('{"schema_version": 9, "identity_scheme": "sha256-full-v1", "tables": {}}')
    with pytest.raises(ValueError, match="newer"):
        t.read()


def test_upgrade_of_older_layouts(spark, tmp_path):
    from veristrand.sources import migrations

    old = {
        "papers": spark.createDataFrame([(H[0], "one")], "paper_hash string, paper_name string"),
        "processing_locks": spark.createDataFrame([("p", 1.0, "me"), ("q", 2.0, None)], "pdf_path string, claimed_at double, claimed_by string"),
        "ocr_cache": spark.createDataFrame([(H[0], 0, "text")], "paper_hash string, page_idx int, text string"),
    }
    assert migrations.adopt(spark, f"file://{tmp_path}", old, 0) == 1
    read = {k: tables.Table(spark, f"file://{tmp_path}", k, s).read() for k, s in migrations.SCHEMAS.items()}
    assert read["papers"].first()["paper_name"] == "one" and read["papers"].columns == PAPERS.names
    assert {(r["resource_key"], r["owner_id"], r["active"]) for r in read["processing_leases"].collect()} == {("p", "me", True), ("q", "legacy-null-owner", False)}
    assert read["ocr_cache"].count() == 0 and read["ocr_cache"].columns[2] == "ocr_profile"  # texts of unknown readers go
    short = {"papers": spark.createDataFrame([("abc", "x")], "paper_hash string, paper_name string")}
    for version, marker in ((0, None), (4, "sha256-full-v1"), (2, "other"), (9, None)):
        with pytest.raises(ValueError):
            migrations.upgrade(spark, short, version, marker)


def test_migrations(spark):
    tables.check_version(3, None)
    tables.check_version(4, "sha256-full-v1")
    for version, marker in ((5, "sha256-full-v1"), (4, None), (3, "other")):
        with pytest.raises(ValueError):
            tables.check_version(version, marker)
    with pytest.raises(ValueError, match="short"):
        tables.check_identities(papers(spark, {"paper_hash": H[0]}, {"paper_hash": "short"}))
    locks = spark.createDataFrame([("p", 1.0, "me"), ("q", 2.0, None)], "pdf_path string, claimed_at double, claimed_by string")
    assert {(r["owner_id"], r["active"]) for r in tables.locks_to_leases(locks).collect()} == {("me", True), ("legacy-null-owner", False)}
    with pytest.raises(ValueError):
        tables.migrate(locks, 1, {3: lambda d: d})


EVENTS = "key long, event_id long, ts double, kind string, owner string, generation long"
LOG = [
    (1, 1, 0.0, "claim", "a", None), (1, 2, 10.0, "claim", "b", None), (1, 3, 20.0, "renew", "a", 1), (1, 4, 130.0, "renew", "a", 1),
    (1, 5, 140.0, "claim", "b", None), (1, 6, 150.0, "renew", "a", 1), (1, 7, 160.0, "release", "a", 1), (1, 8, 170.0, "release", "b", 2), (1, 9, 180.0, "claim", "a", None),
]
#: accepted, reclaimed, generation after it
WANT = [(True, False, 1), (False, False, 1), (True, False, 1), (False, False, 1), (True, True, 2), (False, False, 2), (False, False, 2), (True, False, 2), (True, False, 3)]


def test_leases(spark):
    log = leases.replay(spark.createDataFrame(LOG, EVENTS), stale=100)
    rows = log.orderBy("event_id").collect()
    assert [(r["accepted"], r["reclaimed"], r["now_generation"]) for r in rows] == WANT
    assert rows[1]["renewed_at"] == 0.0  # a refused claim renews nothing
    writes = spark.createDataFrame([(1, 1, 25.0, "a", 1), (1, 2, 121.0, "a", 1), (1, 3, 145.0, "a", 1), (1, 4, 145.0, "b", 2), (1, 5, 175.0, "b", 2), (2, 6, 1.0, "a", 1)], "key long, write_id long, ts double, owner string, generation long")
    got = {r["write_id"]: r["accepted"] for r in leases.fenced_writes(writes, log, stale=100).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    with pytest.raises(ValueError):
        leases.replay(log, 0)


def test_lease_reports(spark):
    rows = spark.createDataFrame([("k", "o", 1, 100.0, True), ("old", "o", 1, -100000.0, True), ("off", "o", 1, 100.0, False)], "resource_key string, owner_id string, generation long, renewed_at double, active boolean")
    assert [r["resource_key"] for r in leases.in_progress(rows, 200.0).collect()] == ["k"]
    assert [r["resource_key"] for r in rows.where(leases.is_current(F.lit("o"), F.lit(1), F.lit(200.0))).collect()] == ["k"]
    beats = spark.createDataFrame([(1, 1, 0.0), (1, 2, 60.0), (1, 3, 8000.0), (2, 4, 0.0)], "key long, event_id long, ts double")
    assert [tuple(r) for r in leases.lost_by_silence(beats).collect()] == [(1, 60.0 + 7200)]


def test_streams(spark, tmp_path):
    from veristrand.streaming.leases import LeaseProcessor, lease_stream, sessions

    events = spark.createDataFrame([(k, i + 100 * k, *rest) for k in (1, 2, 3) for _, i, *rest in LOG], EVENTS)
    events.write.parquet(str(tmp_path / "in"))
    want = sorted(map(str, leases.replay(events, 100).collect()))
    source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    for name, out in (("fold", lease_stream(source, 100)), ("state", None)):
        if out is None:
            old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
            schema = leases.replay(events, 100).schema
            out = source.groupBy("key").transformWithStateInPandas(LeaseProcessor(100), schema, "Append", "None")
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == want, name
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    timed = source.select("key", F.timestamp_seconds("ts").alias("at"))
    q = sessions(timed, 100).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "gaps")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("gaps").columns == ["key", "start", "end", "events"]


def test_status(spark):
    files = spark.createDataFrame([("a.pdf", None), ("b.pdf", None), ("c.pdf", H[2]), ("d.pdf", H[3])], "pdf_path string, content_hash string")
    known = spark.createDataFrame([("a.pdf", H[0], SECTIONS, "t1"), ("b.pdf", H[3], SECTIONS, "t0"), ("b.pdf", H[1], ["cpp"], "t1")], "pdf_path string, paper_hash string, sections_completed array<string>, updated_at string")
    live = spark.createDataFrame([("sha256:" + H[1],), ("sha256:" + H[2],)], "resource_key string")
    status = reports.paper_status(files, known, live)
    got = {r["pdf_path"]: (r["status"], len(r["missing"]), r["in_progress"]) for r in status.collect()}
    assert got == {"a.pdf": ("complete", 0, False), "b.pdf": ("partial", 4, True), "c.pdf": ("not started", 0, True), "d.pdf": ("not started", 0, False)}
    assert tuple(reports.batch_progress(status).first()) == (4, 1, 1, 2)
    empty = reports.batch_progress(status.where("false")).first()
    assert tuple(empty) == (0, 0, 0, 0)


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("part-*.parquet")}


def test_deltas(spark, tmp_path):
    """An upsert writes the rows it touches and no others; reading merges, compaction rewrites touched buckets only."""
    t = tables.Table(spark, f"file://{tmp_path}", "papers", PAPERS, ("paper_hash",))
    many = [{"paper_hash": f"{i:064x}", "paper_name": f"old {i}", "created_at": "t0", "sections_completed": []} for i in range(400)]
    t.write(papers(spark, *many))
    base = files(tmp_path)
    new = papers(spark, *({"paper_hash": f"{i:064x}", "paper_name": f"new {i}"} for i in range(395, 405)))
    want = by_hash(store.upsert_meta(t.read(), new, "t1"))
    assert tables.update([t], lambda v: [store.upsert_meta(t.rows_of(new, v), new, "t1")]) == 2
    added = files(tmp_path) - base
    assert spark.read.parquet(*(f"{tmp_path}/{p}" for p in added)).count() == 10 and base <= files(tmp_path)
    assert by_hash(t.read()) == want and len(want) == 405 and t.read(1).count() == 400
    gone = papers(spark, {"paper_hash": f"{3:064x}"}).withColumn(store.GONE, F.lit(True))
    assert tables.update([t], lambda v: [gone]) == 3
    before = t.commits.entry(3, "papers")
    assert t.compact(least=3) is None and t.compact(least=2) == 4
    after = t.commits.entry(4, "papers")
    kept = [b for b in before["base"] if after["base"].get(b) == before["base"][b]]
    assert not after["deltas"] and 0 < len(kept) < len(before["base"])  # untouched buckets stay where they were
    assert by_hash(t.read()) == {k: v for k, v in want.items() if k != f"{3:064x}"}
    with pytest.raises(ValueError):
        tables.Table(spark, f"file://{tmp_path}", "papers", PAPERS).stage_delta(new)


def test_commits_conflict_by_what_they_touch(spark, tmp_path):
    row = lambda i, name="x": papers(spark, {"paper_hash": H[i], "paper_name": name})
    t, other = (tables.Table(spark, f"file://{tmp_path}", n, PAPERS, ("paper_hash",)) for n in ("papers", "more"))
    t.write(row(0))
    first, second, same = t.stage_delta(row(1)), t.stage_delta(row(2)), t.stage_delta(row(1, "late"))
    assert t.commits.commit(first, 1) == 2 and t.commits.commit(second, 1) == 3  # other keys: laid on top
    with pytest.raises(tables.Conflict):
        t.commits.commit(same, 1)
    many = t.stage_delta(papers(spark, *({"paper_hash": f"{i:064x}"} for i in range(1200))))
    assert many["papers"].keys is None and t.commits.commit(many, 3) == 4  # too many keys to list: compared by a join
    assert t.commits.commit(t.stage_delta(row(3)), 3) == 5
    with pytest.raises(tables.Conflict):
        t.commits.commit(t.stage_delta(papers(spark, {"paper_hash": f"{7:064x}"})), 3)
    rests = lambda i, again: (tables.Reads(t, row(i).select("paper_hash"), again),)
    assert other.commits.commit(other.stage_delta(row(0)), 4, rests(0, lambda v: False)) == 6  # version 5 wrote another key
    with pytest.raises(tables.Conflict):
        other.commits.commit(other.stage_delta(row(0)), 4, rests(3, lambda v: False))
    assert other.commits.commit(other.stage_delta(row(1)), 4, rests(3, lambda v: True)) == 7  # written, and it holds again
    with pytest.raises(tables.Conflict):
        t.commits.commit(t.stage(t.read(5)), 4)
    tries = []
    assert tables.update([t], lambda v: tries.append(v) or t.commits.commit(t.stage_delta(row(2, "between")), v) and [row(2, "mine")] if not tries else tries.append(v) or [row(2, "mine")]) == 9
    assert tries == [7, 8] and by_hash(t.read())[H[2]]["paper_name"] == "mine"


def test_migration_of_a_root_in_use(spark, tmp_path):
    """Two migrators race and one state results; a writer in between is not lost; short identities change nothing."""
    import json
    from concurrent.futures import ThreadPoolExecutor

    from veristrand.sources import migrations

    def older(root, names):
        spark.createDataFrame([(h, "one") for h in names], "paper_hash string, paper_name string").write.parquet(f"{root}/papers/a")
        spark.createDataFrame([("p", 1.0, "me")], "pdf_path string, claimed_at double, claimed_by string").write.parquet(f"{root}/processing_locks/a")
        (root / "_commits").mkdir()
        (root / "_commits" / "00000001.json").write_text(json.dumps({"schema_version": 1, "identity_scheme": None, "tables": {"papers": "papers/a", "processing_locks": "processing_locks/a"}}))

    root = tmp_path / "one"
    older(root, H[:2])
    t = tables.Table(spark, f"file://{root}", "papers", PAPERS, ("paper_hash",))
    with pytest.raises(ValueError, match="migrate"):
        t.commits.commit(t.stage_delta(papers(spark, {"paper_hash": H[2]})), 1)
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda _: migrations.migrate_root(spark, f"file://{root}"), range(2))) == [2, 2]
    assert t.commits.commit_at(2)["schema_version"] == 4 and t.read().count() == 2 and t.version() == 2
    leases_ = tables.Table(spark, f"file://{root}", "processing_leases", migrations.SCHEMAS["processing_leases"], migrations.KEYS["processing_leases"])
    assert [(r["resource_key"], r["active"]) for r in leases_.read().collect()] == [("p", True)]
    assert t.commits.commit(t.stage_delta(papers(spark, {"paper_hash": H[2]})), 2) == 3 and t.read().count() == 3
    short = tmp_path / "two"
    older(short, ["abc"])
    with pytest.raises(ValueError, match="SHA-256"):
        migrations.migrate_root(spark, f"file://{short}")
    assert tables.Root(spark, f"file://{short}").version() == 1


def test_no_table_takes_short_identities(spark, tmp_path):
    """Whole states and deltas are read before they can be committed, whichever way they come."""
    from veristrand.plans.batch import Tables

    t = Tables(spark, f"file://{tmp_path}")
    bad, drawn = papers(spark, {"paper_hash": "abc"}), spark.createDataFrame([("A" * 64, 1, "t", "d", None)], DIAGRAMS)
    for f in (lambda: t.papers.write(bad), lambda: t.papers.stage_delta(bad), lambda: t.diagrams.write(drawn), lambda: tables.update([t.papers], lambda v: [bad])):
        with pytest.raises(ValueError, match="SHA-256"):
            f()
    assert t.papers.version() == 0
    t.papers.write(papers(spark, {"paper_hash": H[0]}))
    assert t.papers.read().count() == 1
