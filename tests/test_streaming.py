"""Streams give what the batch operators give, whatever the order of arrival."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from carefold.operators import containment, masking, trends
from carefold.sources import knowledge
from carefold.streaming import expiring_tokens, intake, ordered_pages, running_trends

OBS = ("patient_id long, code string, entity_id string, document_id string, value double, "
       "unit string, ts timestamp, confidence double, low double, high double, ord int")


def _observations(seed=3, n=300):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        code = rng.choice(["2160-0", "718-7", "other"])
        rows.append((
            rng.randint(1, 4), code, f"e{k}", "d", round(rng.uniform(0, 20), 2), "u",
            start + timedelta(hours=rng.randint(0, 24 * 200), seconds=k), 0.9,
            5.0 if code != "other" else None, 12.0 if code == "2160-0" else None, 0,
        ))
    return rows


def test_running_trends_equal_batch_with_late_points(spark, tmp_path):
    rows = _observations()
    random.Random(1).shuffle(rows)
    source, updates = tmp_path / "in", tmp_path / "updates"
    for part in range(3):
        spark.createDataFrame(rows[part::3], OBS).coalesce(1).write.mode("append").parquet(str(source))
    # A point that arrives twice counts once.
    spark.createDataFrame(rows[:5], OBS).coalesce(1).write.mode("append").parquet(str(source))

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{updates}/batch_id={batch_id}")

    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = (
        running_trends.slice_updates(stream, days=30).writeStream.outputMode("update")
        .foreachBatch(save).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    metrics, as_of = knowledge.builtin_metrics(spark), F.lit("2025-01-01").cast("timestamp")
    slices = running_trends.latest_slices(spark.read.parquet(str(updates)))
    running = trends.finish_trends(trends.stitch_slices(slices), metrics, as_of)
    batch = trends.analyse_trends(spark.createDataFrame(rows, OBS), metrics, as_of)
    columns = [c for c in batch.columns if c not in ("max_gap_days", "days_since_last", "rate_of_change")]
    assert {tuple(r) for r in running.select(columns).collect()} == {
        tuple(r) for r in batch.select(columns).collect()
    }


def test_intake_quarantines_and_survives_a_rerun(spark, tmp_path):
    schema = "document_id string, span_pos int, text string, confidence double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(
        [("a", 0, "MRN: 1234567", 0.9), ("a", 1, "plain", 0.5), ("b", 0, None, 0.9), ("b", 1, "x", 0.9)],
        schema,
    ).write.parquet(source)

    def process(good):
        parts = masking.mask_document(good)
        return {"spans": parts["spans"], "token_map": parts["token_map"]}

    problem = F.when(F.col("text").isNull(), "span without text")
    for checkpoint in ("cp1", "cp2"):  # the second run repeats every file
        intake.run_intake(
            intake.read_spans(spark, source, schema), out, str(tmp_path / checkpoint), process, problem
        ).awaitTermination()
        status = {
            r.document_id: r.processing_status
            for r in intake.current_status(spark.read.parquet(f"{out}/status")).collect()
        }
        assert status == {"a": "complete", "b": "failed"}
        spans = intake.read_table(spark, out, "spans", ["document_id", "span_pos"])
        assert spans.count() == 2
        failed = intake.read_table(spark, out, "quarantine", ["document_id"]).collect()
        assert [(r.document_id, r.step, r.message) for r in failed] == [("b", "ocr", "span without text")]
        assert intake.read_table(spark, out, "token_map", ["document_id", "token"]).count() == 1


def test_a_new_checkpoint_writes_beside_what_is_there(spark, tmp_path):
    schema = "document_id string, span_pos int, text string, confidence double"
    out = str(tmp_path / "out")
    steps = {"ocr": lambda good: {"spans": good}, "ner": lambda good: {"words": good.select("document_id")}}
    for run in ("old", "new"):
        source = str(tmp_path / run)
        spark.createDataFrame([(run, 0, f"text of {run}", 0.9), ("both", 0, f"text of {run}", 0.9)], schema).coalesce(1).write.parquet(source)
        intake.run_intake(
            intake.read_spans(spark, source, schema), out, str(tmp_path / f"cp-{run}"), steps, F.lit(None).cast("string")
        ).awaitTermination()
    spans = intake.read_table(spark, out, "spans", ["document_id", "span_pos"]).collect()
    assert {r.document_id: r.text for r in spans} == {"old": "text of old", "new": "text of new", "both": "text of new"}
    log = spark.read.parquet(f"{out}/status")
    assert {r.status for r in log.collect()} == {"queued", "ocr", "ner", "complete"}
    assert {r.processing_status for r in intake.current_status(log).collect()} == {"complete"}


def test_tokens_expire_in_state(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("t1", "v1"), ("t2", None)], "token string, value string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("token string, value string").parquet(source)
    q = (
        expiring_tokens.live_values(stream, ttl_seconds=3600).writeStream.outputMode("update")
        .format("memory").queryName("live_tokens").option("checkpointLocation", str(tmp_path / "cp"))
        .start()
    )
    # Time-driven state keeps running batches, so the test stops it once it has answered.
    deadline = time.time() + 40
    while time.time() < deadline and spark.table("live_tokens").count() < 2:
        time.sleep(0.5)
    q.stop()
    assert {(r.token, r.value) for r in spark.table("live_tokens").collect()} == {("t1", "v1"), ("t2", None)}


# --------------------------------------------------------------------------- ordered pages
def _pages(store):
    return ordered_pages.OrderedPages(store.get, store.__setitem__, lambda number: store.pop(number, None))


def _point(ts, key, value=1.0):
    return ordered_pages.Point(ts, 0, key, value, 2.0, 8.0, "u", 0.5)


def _by_hand(points):
    ordered = sorted(points, key=lambda p: p.key)
    steps = list(zip(ordered, ordered[1:]))
    return (
        len(ordered), ordered[0], tuple(ordered[-3:]), max((b.ts - a.ts for a, b in steps), default=None),
        sum((2.0 <= a.value <= 8.0) != (2.0 <= b.value <= 8.0) for a, b in steps),
    )


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 60), st.floats(0, 10), st.booleans()), min_size=1, max_size=300), st.integers(1, 50))
def test_pages_hold_what_a_sorted_list_holds(changes, batch):
    store, there = {}, {}
    held = _pages(store)
    for k, (ts, name, value, gone) in enumerate(changes):
        if name in there:
            held.remove(there.pop(name).key)
        if not gone:
            there[name] = _point(ts, f"e{name}", value)
            held.put(there[name])
        if k % batch == 0:
            held.flush()
            held = _pages(store)
    held.flush()
    total = _pages(store).summary()
    if not there:
        assert total is None
        return
    assert (total.points, total.first, total.tail, total.gap, total.crossings) == _by_hand(there.values())
    assert abs(total.confidence - 0.5 * len(there)) < 1e-9


@pytest.mark.parametrize("same_time", [False, True])
def test_an_arrival_reads_few_pages_however_many_points_there_are(same_time):
    store, draw = {}, random.Random(7)
    reads = {}
    for n in range(1, 20_001):
        held = _pages(store)
        held.put(_point(5 if same_time else draw.randint(0, 10**9), f"e{draw.random()}"))
        held.flush()
        reads[n] = held.pages_read
    assert max(reads[n] for n in range(9_000, 20_001)) <= 5
    assert _pages(store).summary().points == 20_000
    assert all(len(text) < 400 * (ordered_pages.PAGE + 1) * 2 for text in store.values())


def _run_trends(spark, tmp_path, parts, lateness, days=30):
    source, updates = str(tmp_path / "points"), str(tmp_path / "slices")

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{updates}/batch_id={batch_id}")

    for rows in parts:
        spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OBS).parquet(source)
        running_trends.slice_updates(stream, days, lateness).writeStream.outputMode("update").foreachBatch(save).option(
            "checkpointLocation", str(tmp_path / "trends-cp")
        ).trigger(availableNow=True).start().awaitTermination()
    return running_trends.latest_slices(spark.read.schema(f"{running_trends.SLICE_ROW}, batch_id long").parquet(updates))


def test_slices_end_with_the_watermark_and_late_points_stay_out(spark, tmp_path):
    def row(day, key, value=1.0, patient=1):
        return (patient, "718-7", key, "d", value, "u", datetime(2024, 1, 1) + timedelta(days=day), 0.9, None, None, 0)

    parts = [
        [row(0, "a"), row(2, "b")],
        [row(1, "late but in time"), row(2, "b", 5.0), row(60, "c")],
        [row(3, "too late"), row(61, "d"), (None, "718-7", "no patient", "d", 1.0, "u", datetime(2024, 3, 2), 0.9, None, None, 0)],
        [row(62, "e"), row(2, "b", 7.0)],
    ]
    slices = {r["slice"]: r for r in _run_trends(spark, tmp_path, parts, "5 days").collect()}
    counts = sorted(r.points for r in slices.values())
    assert counts == [3, 3]
    first = slices[min(slices)]
    assert [p.entity_id for p in first.tail] == ["a", "late but in time", "b"] and first.tail[-1].value == 5.0
    assert first.max_gap == 1.0


# --------------------------------------------------------------------------- token values as of a time
def test_lookups_see_the_value_of_their_own_time(spark, tmp_path):
    start, rng = datetime(2024, 1, 1), random.Random(5)
    rows = []
    for k in range(400):
        token = rng.choice("abc")
        rows.append((rng.choice(["r1", "r2"]), token, k, start + timedelta(minutes=rng.randint(0, 3000)), f"v{k}" if rng.random() < 0.3 else None))
    rows += [("r1", "edge", 1000, start, "v"), ("r1", "edge", 1001, start, None), ("r1", "edge", 1002, start + timedelta(hours=1), None),
             ("r1", "edge", 1003, start + timedelta(minutes=59), None), ("r1", None, 1004, start, None), ("r1", "never saved", 1005, start, None)]

    def known(record, token, at):
        saved = [(t, k, v) for r, n, k, t, v in rows if (r, n) == (record, token) and v is not None and t <= at]
        last = max(saved, default=None)
        return last[2] if last and at - last[0] < timedelta(hours=1) else None

    wanted = {(r, n, k, known(r, n, t)) for r, n, k, t, v in rows if v is None and n is not None}
    schema = "record string, token string, event_id long, ts timestamp, value string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.sort(key=lambda r: r[3] + timedelta(minutes=rng.randint(0, 300)))
    parts = [rows[k : k + 70] for k in range(0, len(rows), 70)] + [[("", "", -1, start + timedelta(days=99), "end")]]
    answers = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        answers = expiring_tokens.values_as_of(spark.readStream.schema(schema).parquet(source), "6 hours", 3600, ("record",))
        answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True
        ).start().awaitTermination()
    found = [tuple(r) for r in spark.read.schema(answers.schema).parquet(out).select("record", "token", "event_id", "value").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_a_slice_of_many_patients_is_read_and_written_in_few_state_calls():
    calls = []

    class Held(dict):
        def getValue(self, key):
            calls.append("get")
            return self.get(key)

        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

        def removeKey(self, key):
            self.pop(key, None)

    class One:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("put")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return One()

        def getMapState(self, *_):
            return Held()

        def registerTimer(self, at):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    def arrivals(n, patients):
        return [Row(patient_id=p, entity_id=f"e{k}", micros=k * 1000 + 1, ord=0, value=float(k % 9), low=2.0, high=None, unit="u", confidence=0.5)
                for p in patients for k in range(n)]

    state = running_trends.SliceState(30, True)
    state.init(Handle())
    for again in range(2):
        found = list(state.handleInputRows((0, "c", 0), iter(arrivals(20, range(16))), Times()))
        assert {(r.patient_id, r.points) for r in found} == {(p, 20) for p in range(16)}
    assert calls.count("get") == calls.count("put") == 2 and calls.count("timer") == 1
    # one series grows beyond a page; points that come again still count once
    for again in range(2):
        found = list(state.handleInputRows((0, "c", 0), iter(arrivals(300, [5])), Times()))
        assert [(r.patient_id, r.points, r.tail[-1]["entity_id"]) for r in found] == [(5, 300, "e299")]


# --------------------------------------------------------------------------- containment
def test_a_row_that_raises_costs_only_itself(spark):
    def raises(rows):
        if rows["text"].isna().any():
            raise TypeError("no text")
        return rows.assign(n=rows["text"].str.len()).loc[lambda r: r["n"] > 0]

    rows = [(None if k == 7 else f"d{k}", None if k % 50 == 9 else "x" * (k % 4)) for k in range(500)]
    df = spark.createDataFrame(rows, "document_id string, text string").repartition(3)
    found = containment.run_extractors(df, {"a": raises, "b": lambda r: r.assign(n=1)}, "n long").collect()
    ok = sorted((str(r.document_id), r.n) for r in found if r.extractor == "a" and r.error is None)
    assert ok == sorted((str(k), len(t)) for k, t in rows if t)
    bad = {(r.document_id, r.n, *r.error) for r in found if r.error is not None}
    assert bad == {(k, None, "a", "TypeError", "no text") for k, t in rows if t is None}
    assert sum(r.extractor == "b" for r in found) == 500
    assert containment.contained(df.limit(0), "a", raises, "n long").collect() == []
    good, failed = containment.quarantine(containment.checked(df, "s", F.when(F.col("text") == "", "empty")))
    assert failed.count() == sum(t == "" for _, t in rows) and good.count() == sum(t != "" for _, t in rows)


def test_documents_that_break_a_job_are_found_by_halves(spark):
    docs = spark.range(300).select(F.concat(F.lit("d"), "id").alias("document_id"), "id")
    runs = []

    def run(part):
        runs.append(1)
        value = F.when(F.col("id").isin(17, 204), F.raise_error(F.concat(F.lit("bad "), "id"))).otherwise(F.col("id"))
        part.select(value.alias("v")).write.format("noop").mode("overwrite").save()

    found = containment.poisoned(docs, run, "ner")
    assert sorted(found) == [("d17", "ner", "USER_RAISED_EXCEPTION", "bad 17"), ("d204", "ner", "USER_RAISED_EXCEPTION", "bad 204")]
    assert len(runs) < 50

    def always(part):
        raise RuntimeError("no space left")

    with pytest.raises(RuntimeError):
        containment.poisoned(docs, always, "ner")


def test_documents_that_break_a_job_cost_runs_over_their_bucket_only(spark):
    docs = spark.range(600).select(F.concat(F.lit("d"), "id").alias("document_id"), "id")
    docs = docs.unionByName(docs.filter("id % 3 = 0")).unionByName(docs.limit(1).select(F.lit(None).cast("string").alias("document_id"), F.lit(40).alias("id")))
    bad, sizes = (17, 40, 204, 205, 206, 511), []

    def run(part):
        sizes.append(part.count())
        value = F.when(F.col("id").isin(*bad), F.raise_error(F.concat(F.lit("bad "), "id"))).otherwise(F.col("id"))
        part.select(value.alias("v")).write.format("noop").mode("overwrite").save()

    found = containment.poisoned(docs, run, "ner", bucket=100)
    wanted = [(f"d{k}", f"bad {k}") for k in bad] + [(None, "bad 40")]
    assert sorted(((r[0], r[3]) for r in found), key=str) == sorted(wanted, key=str)
    assert max(sizes) < 250 and len(sizes) < 150


@pytest.mark.parametrize("python", [False, True])
def test_a_step_that_fails_on_many_documents_is_planned_a_few_times(spark, tmp_path, python):
    docs = spark.range(900).select(F.concat(F.lit("d"), "id").alias("document_id"), "id")
    docs = docs.unionByName(docs.filter("id % 3 = 0")).unionByName(docs.limit(1).select(F.lit(None).cast("string").alias("document_id"), F.lit(45).alias("id")))
    bad, plans = set(range(5, 900, 40)), []

    def rows(batches):
        for batch in batches:
            for k in batch["id"]:
                if k in bad:
                    raise ValueError(f"bad {k}")
            yield batch[["document_id", "id"]]

    def work(good):
        plans.append(1)
        value = F.when(F.col("id").isin(*bad) & (F.col("id") % 3 > 0), F.raise_error(F.concat(F.lit("bad "), "id"))).otherwise(F.col("id"))
        other = F.when(F.col("id").isin(*bad), F.raise_error(F.concat(F.lit("odd "), "id"))).otherwise(F.col("id"))
        native = {"plain": good.filter("id >= 0"), "a": good.select("document_id", value.alias("v")), "b": good.select(other.alias("v"))}
        return {"p": good.mapInPandas(rows, "document_id string, id long")} if python else native

    write = lambda table, name: table.write.parquet(f"{tmp_path}/{len(plans)}-{name}")
    left, failed = intake.run_step(docs, "ner", work, write, None, str(tmp_path))
    found = sorted((r.document_id, r.error_type, r.message) for r in failed.filter("document_id IS NOT NULL").collect())
    kind = "ValueError" if python else "USER_RAISED_EXCEPTION"
    assert found == sorted((f"d{k}", kind, f"{'bad' if python or k % 3 else 'odd'} {k}") for k in bad)
    assert [(r.document_id, r.message[4:]) for r in failed.filter("document_id IS NULL").collect()] == [(None, "45")]
    assert left.count() == 1_201 - sum(2 - (k % 3 > 0) for k in bad) - 1
    assert len(plans) < 20


def test_only_tables_of_single_partitions_are_searched_by_parts(spark):
    docs = spark.range(50).select(F.concat(F.lit("d"), "id").alias("document_id"), "id")
    raising = F.when(F.col("id") == 7, F.raise_error(F.lit("seven"))).otherwise(F.col("id")).alias("id")
    assert containment.poisoned_parts(docs, lambda good: {"t": good.select(raising)}, "ner") == [("d7", "ner", "USER_RAISED_EXCEPTION", "seven")]
    assert [r[0] for r in containment.poisoned_parts(docs, lambda good: {"t": good.select("id").filter(raising >= 0)}, "ner")] == ["d7"]
    for wide in (
        lambda good: {"t": good.select(raising).groupBy("id").count()},
        lambda good: {"t": good.select(raising).coalesce(1)},
        lambda good: {"t": good.select("document_id", raising).join(good.select("document_id"), "document_id")},
        lambda good: {"s": good, "t": good.select(raising).limit(3)},
    ):
        assert containment.poisoned_parts(docs, wide, "ner") is None


def test_a_failing_step_skips_its_documents_and_a_broken_plan_stops(spark, tmp_path):
    schema = "document_id string, span_pos int, text string, confidence double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(f"d{k}", 0, "t" * k, 0.9) for k in range(40)] + [("d3", 1, "more", 0.9)], schema).write.parquet(source)
    seen = F.when(F.length("text") == 5, F.raise_error(F.lit("five"))).otherwise(F.length("text"))
    steps = {
        "ocr": lambda good: {"checked": containment.checked(good, "ocr", F.when(F.length("text") == 3, "three"))},
        "ner": lambda good: {"native": good.select("document_id", seen.alias("n")), "plain": good.select("document_id")},
        "normalizing": lambda good: {"last": good.select("document_id", "span_pos")},
    }
    none = F.lit(None).cast("string")
    intake.run_intake(intake.read_spans(spark, source, schema), out, str(tmp_path / "cp"), steps, none).awaitTermination()
    failed = intake.read_table(spark, out, "quarantine", ["document_id"]).collect()
    assert {(r.document_id, r.step, r.error_type, r.message) for r in failed} == {
        ("d3", "ocr", "InvalidInput", "three"), ("d5", "ner", "USER_RAISED_EXCEPTION", "five")
    }
    ids = lambda name: {r.document_id for r in spark.read.parquet(f"{out}/{name}").collect()}
    assert ids("checked") == {f"d{k}" for k in range(40)} - {"d3"}
    assert ids("native") == ids("plain") == ids("last") == {f"d{k}" for k in range(40)} - {"d3", "d5"}
    status = {r.document_id: r.processing_status for r in intake.current_status(spark.read.parquet(f"{out}/status")).collect()}
    assert {k for k, v in status.items() if v == "failed"} == {"d3", "d5"} and len(status) == 40
    broken = {"ocr": lambda good: {"x": good.select("no such column")}}
    query = intake.run_intake(intake.read_spans(spark, source, schema), str(tmp_path / "o2"), str(tmp_path / "c2"), broken, none)
    with pytest.raises(Exception, match="no such column"):
        query.awaitTermination()


def test_errors_of_a_batch_come_in_one_table(spark):
    def raises(rows):
        if (rows["n"] % 5 == 0).any():
            raise ValueError("five")
        return rows.assign(v=rows["n"])

    df = spark.range(2_000).select(F.concat(F.lit("d"), "id").alias("document_id"), F.col("id").alias("n")).coalesce(1)
    numbered = containment.run_extractors(df, {"a": raises}, "v long").withColumn("part", F.monotonically_increasing_id())
    found = numbered.collect()
    assert sorted(r.v for r in found if r.error is None) == [k for k in range(2_000) if k % 5]
    assert sorted(r.document_id for r in found if r.error is not None) == sorted(f"d{k}" for k in range(0, 2_000, 5))
    handed = []
    real = pd.concat
    pd.concat = lambda parts, **k: handed.append(len(parts)) or real(parts, **k)
    try:
        run = {}

        class Frame:
            schema = df.schema

            def mapInPandas(self, work, _):
                run["work"] = work
                raise StopIteration

        with pytest.raises(StopIteration):
            containment.run_extractors(Frame(), {"a": raises}, "v long")
        tables = list(run["work"](iter([df.toPandas()])))
    finally:
        pd.concat = real
    assert len(tables) == 1 and len(tables[0]) == 2_000 and max(handed) > 400


def test_lookups_of_a_token_read_their_state_once():
    calls = []

    class Held:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append("put")

    class Handle:
        def getValueState(self, *_):
            return Held()

        def registerTimer(self, at):
            calls.append("timer")

    state = expiring_tokens.AsOfState(1_000_000, ("token",))
    state.init(Handle())
    rows = [Row(token="t", event_id=k, micros=5_000 * k, value=None if k else "v") for k in range(3)]
    assert list(state.handleInputRows(("t",), iter(rows), None)) == []
    assert calls == ["get", "timer", "timer", "timer", "put"]


def test_a_block_of_many_tokens_is_read_and_written_in_few_state_calls():
    calls = []

    class One:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("put")
            self.value = value

        def clear(self):
            self.value = None

    class Many:
        rows = ()

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def appendValue(self, value):
            calls.append("put")
            self.rows = [*self.rows, value]

        def put(self, rows):
            calls.append("put")
            self.rows = rows

        def clear(self):
            self.rows = ()

    class Handle:
        def getValueState(self, *_):
            return One()

        def getListState(self, *_):
            return Many()

        def registerTimer(self, at):
            calls.append("timer")
            self.at = at

    class Times:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, state = Handle(), expiring_tokens.BlockState(1_000_000, ("token",))
    state.init(handle)
    events = [(f"t{k % 200}", k, 10_000 * (k // 200), f"v{k}" if k < 200 else None) for k in range(2_000)]
    batch = pd.DataFrame(events, columns=["token", "event_id", "micros", "value"])
    assert list(state.handleInputRows((0,), iter([batch[:1_000], batch[1_000:]]), Times(0))) == []
    assert len(calls) == 4 and handle.at == 11
    (first,) = state.handleExpiredTimer((0,), Times(50), None)
    assert sorted(first["event_id"]) == list(range(200, 1_000)) and list(first["value"]) == [f"v{k % 200}" for k in first["event_id"]]
    assert list(state.handleExpiredTimer((0,), Times(50), None)) == []
    (rest,) = state.handleExpiredTimer((0,), Times(2_000), None)
    assert sorted(rest["event_id"]) == list(range(1_000, 2_000)) and state.pieces.rows == () and state.timer.value is None
    assert len(calls) < 14


@pytest.mark.parametrize("seed", range(40))
def test_answers_and_what_is_kept_equal_a_search_through_all_rows(seed):
    rng = random.Random(seed)
    columns = ("record", "token", "event_id", "micros", "value")
    rows = [(rng.choice([None, "r"]), rng.choice("ab"), k, rng.randint(0, 12), f"v{k}" if rng.random() < 0.5 else None) for k in range(rng.randint(0, 20))]
    rng.shuffle(rows)
    passed, ttl = rng.randint(0, 13), rng.randint(1, 8)
    kind = pa.schema([(c, pa.int64() if c in ("event_id", "micros") else pa.string()) for c in columns])
    answers, left = expiring_tokens.as_of(pa.Table.from_pylist([dict(zip(columns, r)) for r in rows], schema=kind), ("record", "token"), passed, ttl)

    def last(record, token, at):
        return max(((r[3], r[2], r) for r in rows if r[:2] == (record, token) and r[4] is not None and r[3] <= at), default=None)

    def known(r):
        found = last(r[0], r[1], r[3])
        return found[2][4] if found and r[3] - found[0] < ttl else None

    assert sorted(answers.to_pylist(), key=lambda r: r["event_id"]) == sorted(
        ({"record": r[0], "token": r[1], "event_id": r[2], "value": known(r)} for r in rows if r[4] is None and r[3] < passed), key=lambda r: r["event_id"])
    kept = {r for r in rows if r[3] >= passed and (r[4] is None or r[3] + ttl > passed)}
    ends = [last(*of, passed - 1) for of in {r[:2] for r in rows}]
    kept |= {found[2] for found in ends if found and found[0] + ttl > passed}
    assert sorted(r["event_id"] for r in left.to_pylist()) == sorted(r[2] for r in kept)
