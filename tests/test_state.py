"""The commit log, snapshots and the keyed state: races, retention, restart and expiry."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from newsloom.operators.feeds import merge_country_feed
from newsloom.sources import tables as st
from newsloom.sources.commits import CommitLog
from newsloom.streaming import ingest
from newsloom.streaming.state import CountryState

SCHEMA = "id string, url string, title string, country_name string, published_at timestamp"


def rows(spark, data):
    return spark.createDataFrame(data, "id string, url string, title string, country_name string, published_at string").withColumn("published_at", F.to_timestamp("published_at"))


def test_versions_are_claimed_once(tmp_path):
    log, taken = CommitLog(str(tmp_path)), []

    def work(name):
        own = CommitLog(str(tmp_path))
        for k in range(25):
            taken.append((own.append(lambda entry: {"runs": [*entry.get("runs", []), f"{name}{k}"]}), name))

    threads = [threading.Thread(target=work, args=(n,)) for n in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version, entry = log.latest()
    assert version == 100 and sorted(v for v, _ in taken) == list(range(1, 101))
    assert sorted(entry["runs"]) == sorted(f"{n}{k}" for n in "abcd" for k in range(25))
    assert not log.commit(100, {"runs": []}) and log.commit(101, {"runs": []})


def test_snapshots_keep_the_last_versions(spark, tmp_path):
    root = str(tmp_path)
    schema = "id string, country_name string"
    assert st.read_snapshot(spark, root, schema).count() == 0
    runs = [st.write_snapshot(spark.createDataFrame([(f"x{k}", "A")], schema), root, keep=2) for k in range(4)]
    assert [r.id for r in st.read_snapshot(spark, root, schema).collect()] == ["x3"]
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == sorted(runs[-2:])


def test_world_feed_is_never_missing(spark, tmp_path):
    """A reader beside a writer always finds one whole feed."""
    root, seen, stop = str(tmp_path), [], threading.Event()
    st.publish_world_feed(spark.range(5).select(F.lit("0").alias("n")), root)

    def read():
        while not stop.is_set():
            seen.append({r.n for r in st.read_world_feed(spark, root, "n string").collect()})

    t = threading.Thread(target=read)
    t.start()
    for k in range(1, 6):
        st.publish_world_feed(spark.range(5).select(F.lit(str(k)).alias("n")), root, keep=6)
    stop.set()
    t.join()
    assert seen and all(len(s) == 1 for s in seen)
    with pytest.raises(FileNotFoundError):
        st.read_world_feed(spark, str(tmp_path / "none"), "n string")


def test_state_equals_a_fold_of_all_batches(spark, tmp_path):
    """Random batches with repeated keys, stale and future rows: the same as merging one after the other."""
    rng = random.Random(4)
    state = CountryState(spark, str(tmp_path), SCHEMA, compact_after=3)
    plain, written = rows(spark, []), []
    for day in range(1, 9):
        at = f"2024-01-{10 + day} 00:00:00"
        data = [
            (f"i{rng.randint(0, 99)}", f"u{rng.randint(0, 12)}", rng.choice(["Flood in town", "Talks resume", "Vote held"]), rng.choice("ABC"), f"2024-01-{rng.randint(1, 20):02d} {rng.randint(0, 23):02d}:00:00")
            for _ in range(rng.choice([0, 5, 30]))
        ]
        batch = rows(spark, data)
        before = {p.name for p in (tmp_path / "runs").iterdir()} if (tmp_path / "runs").exists() else set()
        version = state.upsert(batch, at)
        merged = merge_country_feed(batch, plain, at).select(*plain.columns)
        plain = spark.createDataFrame(merged.collect(), plain.schema)
        got = sorted(map(tuple, CountryState(spark, str(tmp_path), SCHEMA).read(at).collect()))
        assert got == sorted(map(tuple, plain.collect())), day
        written.append((version, {p.name for p in (tmp_path / "runs").iterdir()} - before))
    assert len(state.log.latest()[1]["runs"]) < 3
    assert CountryState(spark, str(tmp_path), SCHEMA).read("2024-03-01 00:00:00").count() == 0


def test_a_batch_writes_only_its_own_rows(spark, tmp_path):
    state = CountryState(spark, str(tmp_path), SCHEMA)
    state.upsert(rows(spark, [(f"i{k}", f"u{k}", "Vote held", "A", "2024-01-10 00:00:00") for k in range(500)]), "2024-01-10 00:00:00")
    state.upsert(rows(spark, [("new", "u1", "Vote held again", "B", "2024-01-10 01:00:00")]), "2024-01-10 02:00:00")
    runs = state.log.latest()[1]["runs"]
    assert [spark.read.parquet(state.log.run_path(r)).count() for r in runs] == [500, 1]
    assert state.upsert(rows(spark, []), "2024-01-10 03:00:00") == 2 and state.read("2024-01-10 03:00:00").count() == 501


def test_two_writers_lose_nothing(spark, tmp_path):
    def work(name):
        own = CountryState(spark, str(tmp_path), SCHEMA, compact_after=4, keep=100)
        for k in range(4):
            own.upsert(rows(spark, [(f"{name}{k}", f"{name}{k}", "Vote held", name, "2024-01-10 00:00:00")]), "2024-01-10 00:00:00")

    threads = [threading.Thread(target=work, args=(n,)) for n in "XY"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.id for r in CountryState(spark, str(tmp_path), SCHEMA).read("2024-01-11 00:00:00").collect()) == sorted(f"{n}{k}" for n in "XY" for k in range(4))


def test_restarted_stream_goes_on(spark, tmp_path):
    src, root, ckpt = (str(tmp_path / x) for x in ("src", "state", "ckpt"))
    fold = ingest.last_known_good(root, SCHEMA, lambda batch, batch_id: "2024-01-10 00:00:00")
    for k in range(3):
        rows(spark, [(f"i{k}", f"u{k // 2}", "Vote held", "A", f"2024-01-09 0{k}:00:00")]).write.mode("append").parquet(src)
        ingest.refresh(spark.readStream.schema(SCHEMA).parquet(src), fold, ckpt, once=True).awaitTermination()
    assert sorted(r.id for r in CountryState(spark, root, SCHEMA).read("2024-01-10 00:00:00").collect()) == ["i1", "i2"]


def test_dropped_rows_have_a_reason(spark):
    data = [("a", "u", "t", "A", "2024-01-10 00:00:00"), ("b", "u", "t", "A", "2024-01-01 23:59:59"), ("c", "u", "t", "A", "2024-01-10 06:00:01"), ("d", "u", "t", "A", None), ("e", "u", "t", "A", "2024-01-10 06:00:00")]
    kept, gone = ingest.with_dropped(rows(spark, data), "2024-01-10 00:00:00")
    assert sorted(r.id for r in kept.collect()) == ["a", "e"]
    assert sorted((r.id, r.reason) for r in gone.collect()) == [("b", "late"), ("c", "future"), ("d", "missing")]
