"""The job loop as a stream against a plain loop; replays, restarts and folded versions."""

import datetime as dt
import os

from shelfsight.streaming.queries import budget_alerts, job_ticks, tick_tables
from shelfsight.streaming.versions import VersionedTables

JOBS = "job_id long, state string, pipeline_steps string, created_at timestamp_ntz, success_count long, failure_count long, processed_count long"
AT = dt.datetime(2024, 3, 1)


def _data():
    states = ["queued", "running", "paused", "queued", "draft", "queued", "running", "done"]
    steps = ["normalize_only", "full", "full", "discover_only", "full", "full", "normalize_only", "full"]
    jobs = [(i, s, p, AT - dt.timedelta(days=i % 3), 0, i, 0) for i, (s, p) in enumerate(zip(states, steps, strict=True))]
    pairs = [(j, p, not (j == 3 or (j + p) % 5 == 0)) for j in range(8) for p in range(j % 4 + 4)]
    results = [(j, p, "broke " * 2000 if (j * p) % 7 == 3 else None, p % 3, p % 2, p % 2 == 0, p % 4 == 0) for j, p, _ in pairs if (j, p) != (1, 2)]
    products = [(p, p % 3 > 0) for p in range(8)]
    usage = [[(AT + dt.timedelta(days=12 * b + i), "small", 1_000_000, 0, i) for i in range(4)] for b in range(5)]
    return jobs, pairs, results, products, usage


def _loop(jobs, pairs, results, products, usage, budget):
    """One tick per list of usage rows, as a user would write it down."""
    state = {j[0]: {"state": j[1], "steps": j[2], "at": j[3], "s": j[4], "f": j[5], "n": j[6], "w": 0, "r": 0, "paid": 0.0, "started": None, "done": None} for j in jobs}
    pending = sorted((j, p) for j, p, wait in pairs if wait)
    found = {(r[0], r[1]): r[2:] for r in results}
    image, seen, alerts, errors = dict(products), [], [], {}
    for rows in usage:
        seen += rows
        now = max(r[0] for r in rows)
        spent = sum(r[2] / 1e6 for r in seen if (r[0].year, r[0].month) == (now.year, now.month))
        runnable = [j for j, x in state.items() if x["state"] in ("queued", "running")]
        if spent >= budget:
            if runnable:
                alerts.append("exhausted")
            for j in runnable:
                state[j]["state"] = "paused"
            runnable = []
        elif spent >= 0.8 * budget:
            alerts.append("warning")
        for _, _, _, _, job in rows:
            state[job]["paid"] += 1.0
        for j in sorted(runnable, key=lambda j: (state[j]["at"], j))[:3]:
            x = state[j]
            if x["state"] == "queued":
                x["started"] = x["started"] or now
            x["state"] = "running"
            for key in [k for k in pending if k[0] == j][:5]:
                if key not in found:
                    continue
                error, white, removed, was, same = found[key]
                pending.remove(key)
                x["n"] += 1
                x["s" if error is None else "f"] += 1
                if error is not None:
                    errors[key[1]] = error[:5000]
                elif x["steps"] == "normalize_only":
                    x["w"] += image[key[1]] and was and not same
                    x["r"] += image[key[1]] and not (was and not same)
                else:
                    x["w"], x["r"] = x["w"] + white, x["r"] + removed
            if not [k for k in pending if k[0] == j]:
                x["state"], x["done"] = "done", now
    return state, pending, alerts, errors


def test_stream_equals_a_plain_loop_and_survives_replays(spark, rows, tmp_path):
    budget = 9.0
    jobs, pairs, results, products, usage = _data()
    log = "created_at timestamp_ntz, model string, input_tokens long, output_tokens long, job_id long"
    root, landed, checkpoint = (str(tmp_path / n) for n in ("tables", "landed", "state"))
    inputs = (
        rows("job_id long, product_id long, error string, white_bg int, rembg int, was_white_bg boolean, skipped_unchanged boolean", *results),
        rows("product_id long, has_main_image boolean", *products),
        rows("model string, p_in double, p_out double", ("small", 1.0, 5.0)),
    )

    def start():
        store = tick_tables(spark, root, rows(JOBS, *jobs), rows("job_id long, product_id long, pending boolean", *pairs), fold_after=2)
        arrived = spark.readStream.schema(log).parquet(landed)
        job_ticks(arrived, store, *inputs, budget, checkpoint, "a@b").awaitTermination()
        return store

    for number, batch in enumerate(usage):
        rows(log, *batch).coalesce(1).write.mode("append").parquet(landed)
        store = start()
        if number == 2:  # the process died after the tables were committed, before the stream knew
            for name in (f"{number}", f".{number}.crc"):
                os.remove(os.path.join(checkpoint, "commits", name))
            store = start()
    store.expire()
    state, pending, alerts, errors = _loop(jobs, pairs, results, products, usage, budget)
    columns = {"state": "state", "s": "success_count", "f": "failure_count", "n": "processed_count", "w": "white_bg_count",
               "r": "rembg_count", "paid": "actual_cost_usd", "started": "started_at", "done": "completed_at"}
    got = {r["job_id"]: r for r in store.current("jobs").collect()}
    assert {j: {k: r[c] for k, c in columns.items()} for j, r in got.items()} == {j: {k: x[k] for k in columns} for j, x in state.items()}
    assert sorted((r["job_id"], r["product_id"]) for r in store.current("job_products").filter("pending").collect()) == pending
    assert store.current("job_products").count() == len(pairs)
    assert {r["product_id"]: r["product_error"] for r in store.current("product_errors").collect()} == errors
    told = [r["subject"] for r in store.current("alerts").orderBy("tick").collect()]
    assert ["exhausted" if "exhausted" in x else "warning" for x in told] == alerts
    assert alerts == ["warning", "exhausted", "warning"]


def test_versions_hide_what_is_not_committed_and_fold(spark, rows, tmp_path):
    store = VersionedTables(spark, str(tmp_path), {"t": ["k"]}, fold_after=3)
    make = lambda *data: rows("k string, v int", *data)
    store.create({"t": make(("a", 1), (None, 2))})
    store.create({"t": make(("lost", 0))})
    store.commit(1, {"t": make(("a", 5), ("b", 6))})
    make(("torn", 9)).write.parquet(f"{tmp_path}/t/changes/version=2")
    read = lambda below=None: {r["k"]: r["v"] for r in store.current("t", below).collect()}
    assert read() == {"a": 5, None: 2, "b": 6} and read(1) == {"a": 1, None: 2}
    store.commit(2, {"t": make((None, 7))})
    for _ in range(2):
        store.commit(3, {"t": make(("b", 8))})
    assert read() == {"a": 5, None: 7, "b": 8} and read(3) == {"a": 5, None: 7, "b": 6}
    store.commit(4, {"t": make()})
    store.commit(6, {"t": make(("c", 1))})
    store.expire()
    assert read() == {"a": 5, None: 7, "b": 8, "c": 1} and read(6) == {"a": 5, None: 7, "b": 8}
    assert not os.path.exists(f"{tmp_path}/t/full/version=0")


def test_budget_alerts_are_told_once(spark, rows, tmp_path):
    """Each batch in a stream of its own; late rows, a jump over both levels, a replayed batch, a month that is over."""
    landed, target, checkpoint = (str(tmp_path / n) for n in ("landed", "alerts", "state"))
    log = "created_at timestamp_ntz, model string, input_tokens long, output_tokens long"
    prices = rows("model string, p_in double, p_out double", ("small", 1.0, 5.0))
    spend = lambda month, day, usd: (dt.datetime(2024, month, day), "small", int(usd * 1_000_000), None)
    batches = [
        [spend(1, 5, 3), spend(1, 6, 2)], [spend(1, 9, 3.5), spend(1, 8, 0)], [spend(1, 20, 1)], [spend(1, 31, 4), spend(2, 1, 15)],
        [spend(1, 30, 50), spend(2, 3, 1)], [spend(4, 1, 1)], [spend(1, 31, 99), spend(4, 2, 7.5)],
    ]
    for number, batch in enumerate(batches):
        rows(log, *batch).coalesce(1).write.mode("append").parquet(landed)
        for _ in range(2 if number == 3 else 1):
            arrived = spark.readStream.schema(log).parquet(landed)
            query = budget_alerts(arrived, prices, 10.0, target, checkpoint)
            query.awaitTermination()
            if number == 3:
                last = max(int(n) for n in os.listdir(os.path.join(checkpoint, "commits")) if n.isdigit())
                for name in (f"{last}", f".{last}.crc"):
                    os.remove(os.path.join(checkpoint, "commits", name))
    got = sorted((r.month.month, r.level, r.spent_usd) for r in spark.read.parquet(target).collect())
    assert got == [(1, "exhausted", 13.5), (1, "warning", 8.5), (2, "exhausted", 15.0), (2, "warning", 15.0), (4, "warning", 8.5)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
