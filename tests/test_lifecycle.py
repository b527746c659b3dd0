"""Incremental runs and published generations, with writers that stop at every step."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import incremental
from tessella.sources import files, generations

ITEMS = [(k, f"text {k % 30} abcdef", "n") for k in range(60)] + [(70, None, None), (71, "x", "n")]


def errors():
    return F.array_compact(F.array(F.when(~F.col("text").contains(F.col("output")), "not in the text"), F.when(F.length("output") < 3, "short")))


class Worker:
    """Gives upper-case quotes at first, which fail, and literal ones when it gets feedback. Stops before a call of choice."""

    def __init__(self, stop_at=None, how=RuntimeError):
        self.stop_at, self.how, self.calls, self.seen = stop_at, how, 0, []

    def __call__(self, rows):
        self.calls += 1
        if self.calls == self.stop_at:
            raise self.how("out")
        self.seen += [(r.input_hash, r.attempt) for r in rows.select("input_hash", "attempt").collect()]
        literal = F.substring("text", 1, 8)
        return rows.select("input_hash", F.when(F.size("feedback") == 0, F.upper(literal)).otherwise(literal).alias("output"))


def items(spark):
    return spark.createDataFrame(ITEMS, "k long, text string, note string")


def run(spark, path, work, **more):
    return incremental.run(items(spark), ["text"], work, path, {"version": "1"}, errors(), **({"retries": 1, "batches": 5} | more))


def rows(spark, path):
    return sorted(map(tuple, incremental.results(items(spark), ["text"], path, {"version": "1"}, errors()).select("k", "status", "output", "attempts", "errors").collect()), key=repr)


@pytest.mark.parametrize("stop_at", [1, 4])
@pytest.mark.parametrize("how", [RuntimeError, incremental.StopRun])
def test_a_broken_run_ends_like_an_unbroken_one(spark, tmp_path, stop_at, how):
    whole = Worker()
    report = run(spark, f"{tmp_path}/a", whole)
    assert (report.known, report.worked, report.started, report.unstarted, report.stopped) == (0, 32, 5, 0, None)
    first, second = Worker(stop_at, how), Worker()
    if how is RuntimeError:
        with pytest.raises(RuntimeError):
            run(spark, f"{tmp_path}/b", first)
    else:
        report = run(spark, f"{tmp_path}/b", first)
        assert report.stopped == "out" and report.started + report.unstarted == 5
    kept = {h for h, status in run_hashes(spark, f"{tmp_path}/b") if status == "ok"}
    report = run(spark, f"{tmp_path}/b", second)
    assert rows(spark, f"{tmp_path}/a") == rows(spark, f"{tmp_path}/b")
    assert report.known == len(kept) and not kept & {h for h, _ in second.seen}


def run_hashes(spark, path):
    return [(r.input_hash, r.status) for r in incremental.read_ledger(spark, path).collect()]


def test_results_retries_and_what_makes_work_again(spark, tmp_path):
    path, work = f"{tmp_path}/l", Worker()
    run(spark, path, work)
    got = {r[0]: r[1:] for r in rows(spark, path)}
    assert got[5] == ("ok", "text 5 a", 2, []) and got[35] == got[5]  # repeated input, worked on once
    assert got[70] == ("invalid", None, 2, ["no output"])
    assert got[71] == ("invalid", None, 2, ["short"])
    assert max(a for _, a in work.seen) == 2
    again = Worker()
    report = run(spark, path, again)
    assert (report.known, report.worked) == (30, 2) and rows(spark, path) == sorted(((k, *v) for k, v in got.items()), key=repr)
    # A batch that was cut short doesn't count; another config and stricter checks make work.
    files.create(spark, f"{path}/batch-cut/part-0.parquet", "half a file")
    assert run(spark, path, Worker()).known == 30
    assert incremental.run(items(spark), ["text"], Worker(), path, {"version": "2"}, errors(), batches=5).known == 0
    strict = F.when(F.col("output").startswith("text 1"), F.array(F.lit("no"))).otherwise(errors())
    assert incremental.run(items(spark), ["text"], Worker(), path, {"version": "1"}, strict, batches=5).known == 19
    before = rows(spark, path)
    assert incremental.compact(spark, path) > 1 and rows(spark, path) == before and len([n for n in files.names(spark, path) if n.startswith("batch-")]) == 1


def test_budget_and_no_items(spark, tmp_path):
    report = run(spark, f"{tmp_path}/l", Worker(), cost=F.lit(1.0), budget=30)
    assert report.stopped == "budget" and report.started and report.unstarted and report.worked <= 30
    assert {r[1] for r in rows(spark, f"{tmp_path}/l")} == {"ok", "pending"} | ({"invalid"} if any(r[1] == "invalid" for r in rows(spark, f"{tmp_path}/l")) else set())
    none = items(spark).where("false")
    report = incremental.run(none, ["text"], Worker(), f"{tmp_path}/none")
    assert (report.known, report.worked, report.started) == (0, 0, 0)
    assert incremental.results(none, ["text"], f"{tmp_path}/none").collect() == []


class Killed(RuntimeError):
    pass


def stop_before(name):
    def step(now):
        if now == name:
            raise Killed(name)

    return step


def made(spark, n):
    return {"a": spark.range(n).withColumn("text", F.concat(F.lit("é\n"), F.col("id").cast("string"))), "b": spark.range(n, 2 * n)}


def seen(spark, root):
    return tuple(generations.read(spark, root, t).count() for t in ("a", "b"))


STEPS = ["lease", "recover", "stage a", "stage b", "move", "manifest", "intent", "commit", "point", "release"]


@pytest.mark.parametrize("at", STEPS)
def test_a_reader_never_sees_half_a_generation(spark, tmp_path, at):
    root = str(tmp_path)
    first = generations.publish(spark, root, made(spark, 5), "one")
    with pytest.raises(Killed):
        generations.publish(spark, root, made(spark, 7), "two", step=stop_before(at))
    committed = at in ("point", "release")
    assert seen(spark, root) in ([(5, 5), (7, 7)] if committed else [(5, 5)])
    if at not in ("lease",):
        with pytest.raises(generations.LeaseHeld):  # the dead writer's lease holds until its time is up
            generations.publish(spark, root, made(spark, 9), "three")
    third = generations.publish(spark, root, made(spark, 9), "three", ttl=-1)
    assert seen(spark, root) == (9, 9) and third["number"] == (3 if committed else 2)
    assert third["parent"] == ("g00000002-two" if committed else first["generation_id"])
    assert [m["run_id"] for m in generations.committed(spark, root)] == (["one", "two", "three"] if committed else ["one", "three"])
    assert files.names(spark, f"{root}/staging") == [] and not files.exists(spark, f"{root}/writer.lease")
    assert generations.verify(spark, root) == {"a": True, "b": True}


def test_recovery_finishes_what_was_committed(spark, tmp_path):
    root = str(tmp_path)
    generations.publish(spark, root, made(spark, 5), "one")
    with pytest.raises(Killed):
        generations.publish(spark, root, made(spark, 7), "two", step=stop_before("point"))
    lease = generations.Lease(spark, root, "r", ttl=-1).acquire()
    assert generations.recover(spark, root, lease) == {"removed": [], "pointed": ["g00000002-two"]}
    lease.release()
    assert seen(spark, root) == (7, 7)


def test_promotion_checks_and_tampering(spark, tmp_path):
    root = str(tmp_path)
    assert generations.current(spark, root) is None
    one = generations.publish(spark, root, made(spark, 5), "one", facts={"state": "eligible"})
    generations.publish(spark, root, made(spark, 7), "two")
    with pytest.raises(ValueError):
        generations.promote(spark, root, "g00000002-two", "p", lambda m: m["facts"].get("state") == "eligible")
    generations.promote(spark, root, one["generation_id"], "p", lambda m: m["facts"].get("state") == "eligible")
    assert seen(spark, root) == (5, 5)
    lease = generations.Lease(spark, root, "r").acquire()
    assert generations.recover(spark, root, lease)["pointed"] == []  # a pointer that was put back stays
    lease.release()
    with pytest.raises(ValueError):
        generations.publish(spark, root, made(spark, 8), "bad", checks={"b": lambda df: df.count() > 100})
    assert seen(spark, root) == (5, 5) and not files.exists(spark, f"{root}/writer.lease")
    files.create(spark, f"{root}/CURRENT.json", "{ half", overwrite=True)
    assert seen(spark, root) == (7, 7)  # the last commit
    spark.range(5).write.mode("append").parquet(f"{root}/generations/g00000002-two/b")
    assert generations.verify(spark, root) == {"a": True, "b": False}
    files.create(spark, f"{root}/generations/g00000002-two/manifest.json", "{}", overwrite=True)
    assert seen(spark, root) == (5, 5)
    with pytest.raises(generations.NotCommitted):
        generations.read(spark, root, "a", "g00000002-two")


def test_leases(spark, tmp_path):
    root = str(tmp_path)
    a = generations.Lease(spark, root, "a", ttl=10, now=lambda: 100.0).acquire()
    with pytest.raises(generations.LeaseHeld):
        generations.Lease(spark, root, "b", ttl=10, now=lambda: 109.0).acquire()
    b = generations.Lease(spark, root, "b", ttl=10, now=lambda: 111.0).acquire()
    with pytest.raises(generations.LeaseHeld):
        a.renew()
    a.release()  # not its own any more
    b.check()
    b.renew()
    b.release()
    assert not files.exists(spark, b.path)


def test_digests_do_not_depend_on_order(spark):
    df = made(spark, 50)["a"]
    n, digest = generations.content_digest(df)
    assert n == 50 and generations.content_digest(df.repartition(7).select("text", "id")) == (n, digest)
    assert generations.content_digest(df.unionByName(df.limit(1)))[1] != digest
    assert generations.content_digest(df.withColumn("id", F.when(F.col("id") != 3, F.col("id"))))[1] != digest
    assert generations.content_digest(df.where("false"))[0] == 0
