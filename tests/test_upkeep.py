"""Queue stream, file register, file order and archives."""

import datetime as dt
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewater.operators import state as Q
from tidewater.sources import files as IO
from tidewater.sources import positions as P
from tidewater.sources import register as G
from tidewater.streaming import queue as K

T = dt.datetime(2024, 1, 1)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("runs", [1, 3])
def test_stream_is_the_batch_log(spark, tmp_path, runs):
    """The same claims, failures and lapsed leases by timers and by sweeps, also over restarts."""
    keys = [f"h{i}" for i in range(24)]
    say = lambda name, minute, kind, owner=None, until=None: (name, at(minute), kind, owner, at(until) if until else None)
    steps = [[say(k, 0, "capture") for k in keys] + [say(None, 0, "tick")]]
    for start, owner in ((10, "a"), (60, "b"), (150, "c")):
        steps.append([say(k, start, "claim", owner, start + 15) for k in keys])
        steps.append([say(k, start + 5, ("done", "skip", "fail", "fail")[i % 7 if i % 7 < 4 else 3], owner if i % 5 else "z") for i, k in enumerate(keys) if i % 7 < 5])
    steps.append([say(None, 600, "tick")])

    log = spark.createDataFrame([], Q.LOG)
    add = lambda rows: spark.createDataFrame(log.unionByName(rows).collect(), Q.LOG)
    for rows in steps:
        now = F.lit(rows[0][1])
        log = add(Q.recover(log, now))
        log = add(Q.retry(log, now, 2))
        for kind in ("capture", "claim", "done", "skip", "fail"):
            for owner in sorted({r[3] or "" for r in rows if r[2] == kind}):
                of = spark.createDataFrame([(r[0],) for r in rows if r[2] == kind and (r[3] or "") == owner and r[0]], "content_hash string")
                if kind == "capture":
                    log = add(Q.capture(of, log, now))
                elif kind == "claim":
                    log = add(Q.claim(log, of.withColumn("captured_at", F.lit(T)), owner, now, 900, 100))
                elif kind == "fail":
                    log = add(Q.fail(log, of, now, 2, owner))
                else:
                    log = add(Q.finish(log, of, owner, now, "done" if kind == "done" else "skipped"))
    want = {r.content_hash: (r.status, r.attempts, r.owner, r.until) for r in Q.current(log).collect()}
    assert {x[0] for x in want.values()} >= {"done", "skipped", "dead", "pending"}

    for i in range(runs):
        for n, rows in enumerate(steps[i * len(steps) // runs : (i + 1) * len(steps) // runs]):
            spark.createDataFrame(rows, K.COMMAND).coalesce(1).write.parquet(str(tmp_path / f"in/{i}-{n:02d}"))
        stream = spark.readStream.schema(K.COMMAND).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        out = K.run_queue(stream, str(tmp_path / "state"), str(tmp_path / "log"), most=2, late="1 hour")
    got = {r.content_hash: (r.status, r.attempts, r.owner, r.until) for r in Q.current(out).collect()}
    assert got == want and out.groupBy("content_hash", "seq").count().where("count > 1").isEmpty()


class Store:
    """A slice's value and timers, and how often they were asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.remove(at)


@pytest.mark.parametrize("cuts", [1, 9])
def test_keys_share_a_slice(cuts):
    """Keys of one slice have their own logs, whatever the cut; what is asked of the store grows with the batches, not the keys."""
    rng, minute = random.Random(4), 60_000
    commands = [(f"h{i}", 0, "capture", None, None) for i in range(90)]
    for t in range(1, 400):
        for i in rng.sample(range(100), 9):
            kind = rng.choice(("claim", "claim", "claim", "done", "skip", "fail", "fail", "fail", "capture", "replay", "retry_dead", "other"))
            commands.append((f"h{i}", t * minute, kind, rng.choice(("a", "a", None)), rng.choice((None, (t + rng.randint(-3, 40)) * minute))))
    end, rows, want = 2000 * minute, {}, []
    for h, at_ms, kind, owner, until in [*sorted(commands, key=K.order), *((f"h{i}", end, "end", None, None) for i in range(100))]:
        for new in (lambda r, a=at_ms: K.lapse(r, a), lambda r, c=(kind, at_ms, owner, until): K.step(r, *c, 3)):
            if (row := new(rows.get(h))) is not None:
                rows[h] = row
                want.append((h, *(row[f] for f in K.FIELDS)))
    assert {r[2] for r in want} == {"pending", "processing", "done", "skipped", "failed", "dead"}

    store, machine, got, fired = Store(), K.QueueMachine(3), [], 0
    machine.init(store)
    size = -(-len(commands) // cuts)
    parts = [commands[i : i + size] for i in range(0, len(commands), size)]
    for n, part in enumerate(parts, 1):
        frame = pd.DataFrame(part + [(None, part[-1][1], "tick", None, None)], columns=["content_hash", "at_ms", "kind", "owner", "until_ms"])
        mark = end if n == len(parts) else part[-1][1] - minute
        got += machine.handleInputRows((5,), iter([frame[:100], frame[100:]]), TimerValues(0, 0))
        while due := [t for t in store.timers if t <= mark]:
            got += machine.handleExpiredTimer((5,), TimerValues(0, mark), ExpiredTimerInfo(min(due)))
            store.timers.remove(min(due))
            fired += 1
    logged = [(r[0], int(r[1]), r[2], int(r[3]), r[4], None if pd.isna(r[5]) else int(r[5]), int(r[6])) for d in got for r in d.itertuples(index=False, name=None)]
    by = lambda r: (r[0], r[1])
    assert sorted(logged, key=by) == sorted(want, key=by)
    assert fired <= cuts and store.asked <= 4 * cuts + 3 * fired


def test_lease_without_end_and_replay(spark):
    row = K.step(None, "capture", 0, None, None, 3)
    row = K.step(row, "claim", 5, "a", None, 3)
    assert K.due(row) == 6 and K.step(row, "done", 6, "b", None, 3) is None
    row = K.lapse(row, 6)
    assert row["status"] == "pending" and K.due(row) is None and K.lapse(row, 10**9) is None
    row = K.step(K.step(row, "claim", 7, "a", 9, 3), "done", 8, "a", None, 3)
    assert K.step(row, "replay", 9, None, None, 3)["attempts"] == 0 and K.step(row, "retry_dead", 9, None, None, 3) is None


@pytest.fixture(params=[1 << 27, 64])
def split_size(spark, request):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_and_records(spark, tmp_path, split_size):
    """The same for one split and for many."""
    for f in "ba":
        (tmp_path / f"{f}.txt").write_text("lost\n" + "".join(f"K{i}\ttext {f} {i}\n" + "  and on\n" * (i % 3) + "\n# no\n[x\n" * (i % 2) for i in range(40)))
    lines = P.numbered_lines(spark, str(tmp_path))
    want = [(f, n, t) for f in "ab" for n, t in enumerate((tmp_path / f"{f}.txt").read_text().split("\n")[:-1])]
    got = sorted((r.file[-5], r.line_no, r.value) for r in lines.collect())
    assert got == sorted(want) and (lines.select("file", "block").distinct().count() > 10) == (split_size == 64)
    assert [r.value for r in P.head(P.with_position(spark.read.text(str(tmp_path))), 3).collect()] == [t for _, _, t in want[:3]]
    assert [r.value for r in P.tail(P.with_position(spark.read.text(str(tmp_path))), 3).collect()] == [t for _, _, t in want[-3:]][::-1]
    book = {r.code: r.text for r in P.read_codebook(spark, str(tmp_path)).collect()}
    assert book == {f"K{i}": f"text b {i}" + " and on" * (i % 3) for i in range(40)}
    assert {r.text for r in P.read_codebook(spark, str(tmp_path), continued=False).collect()} == {f"text b {i}" for i in range(40)}


def test_sanctions_in_many_splits(spark, tmp_path, split_size):
    (tmp_path / "n").mkdir()
    (tmp_path / "a").mkdir()
    for part in range(3):
        (tmp_path / f"n/{part}.csv").write_text("".join(f"{part * 20 + i},name {part * 20 + i},individual,P" + ",-0-" * 8 + "\n" for i in range(20)))
        (tmp_path / f"a/{part}.csv").write_text("".join(f"{i},1,-,-,{'-0- ' if part == 0 else f'land {part}'},-\n" for i in range(60)))
    got = IO.read_sanctions(spark, str(tmp_path / "n"), str(tmp_path / "a"), 25).collect()
    assert [r.ent_num for r in got] == [str(i) for i in range(59, 34, -1)] and {r.country for r in got} == {"land 1"}


def test_register_names_and_point_reads(spark, tmp_path):
    root = tmp_path / "2024-01-02"
    root.mkdir()
    line = '{"v":1,"captured_at":"2024-01-02T00:00:00Z","cycle_id":"%s","episode":{"name":"n","source_type":"rss","content_hash":"%s"}}\n'
    (root / "rss-20240102T000000Z.jsonl").write_text("\n" + line % ("c1", "h1") + "broken\n" + line % ("c1", "h1") + line % ("c1", "h2"))
    (root / "cls-20240102T040000Z.jsonl").write_text("broken\n{}\n")
    (root / "half.tmp").write_text("x")
    lines = G.landed_lines(spark, str(tmp_path / "*/*.jsonl"))
    index, runs = G.register(lines, spark.createDataFrame([("h2", *[None] * 9)], G.INDEX), F.lit(T))
    assert [(r.content_hash, r.batch_file, r.line_no, r.status) for r in index.collect()] == [("h1", "2024-01-02/rss-20240102T000000Z.jsonl", 1, "pending")]
    assert sorted((r.cycle_id, r.source_type, r.total, r.new_rows, r.dup_rows) for r in runs.collect()) == [("20240102T040000Z", "cls", 2, 0, 2), ("c1", "rss", 4, 1, 3)]
    assert G.remove_leftovers(spark, str(tmp_path)) == 1 and not (root / "half.tmp").exists()
    first, second = (sorted(G.upsert_runs(spark, str(tmp_path / "runs"), runs).collect()) for _ in range(2))
    assert first == second and len(first) == 2
    gone = G.unreferenced(lines.select("batch_file").distinct(), index, F.lit(dt.datetime(2024, 1, 5)))
    assert [r.batch_file for r in gone.collect()] == ["2024-01-02/cls-20240102T040000Z.jsonl"]


def test_archives_of_a_manifest(spark, tmp_path):
    for kind, rows in (("export", ["1\tx", "2\ty"]), ("gkg", ["g"])):
        with zipfile.ZipFile(tmp_path / f"20240101.{kind}.CSV.zip", "w") as z:
            z.writestr("a.csv", "\n".join(rows))
    (tmp_path / "20240101.mentions.CSV.zip").write_bytes(b"PK broken")
    (tmp_path / "m.txt").write_text("".join(f"1 x http://e/20240101.{k}.CSV.zip\n" for k in ("export", "mentions", "gkg")))
    found = IO.read_manifest_archives(spark, str(tmp_path / "m.txt"), str(tmp_path))
    rows = {k: [r.value for r in d.where("error is null").orderBy("line_no").collect()] for k, d in found.items()}
    assert rows == {"export": ["1\tx", "2\ty"], "mentions": [], "gkg": ["g"]}
    report = IO.archive_report(IO.read_archives(spark, str(tmp_path / "*.zip"))).collect()
    assert sorted((r.n_lines, r.error) for r in report if r.error is None) == [(1, None), (2, None)] and [r.error for r in report if r.error] == ["BadZipFile"]
