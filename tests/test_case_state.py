"""Cases as state: the results after any order of arrivals are those of the batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import cases
from ledgerlight.plans.scenarios import SCENARIOS, frames, scenario
from ledgerlight.streaming import state


def arrivals(spark, seed):
    """Events of all scenarios, with corrections, removals and repeats, shuffled."""
    r = random.Random(seed)
    docs, facts = frames(spark, [scenario(n) for n in SCENARIOS])
    first = [tuple(x) for x in state.events(docs, facts).collect()]
    later = []
    for case, ordinal, field, _, content in first:
        kind = r.random()
        if field is not None and kind < 0.15:
            later.append((case, ordinal, field, 1, json.dumps({**json.loads(content), "value": "999.00"})))
            later.append((case, ordinal, field, 2, content))  # and back
        elif field is not None and kind < 0.25:
            later.append((case, ordinal, field, 3, None))
        elif field is not None and kind < 0.3:
            later += [(case, ordinal, field, 3, None), (case, ordinal, field, 4, json.dumps({**json.loads(content), "origin": "user"}))]
        elif field is None and kind < 0.1:
            later.append((case, ordinal, None, 1, json.dumps({**json.loads(content), "included": False})))
    last = max(x[0] for x in first)
    later += [(last, o, f, 9, None) for c, o, f, _, _ in first if c == last]  # all of one case goes
    rows = first + later + r.sample(first, 20) + [(None, 0, None, 1, "{}"), (0, None, "charges", 1, "{}"), (0, 1, "charges", None, "{}"), (77, 0, "charges", 1, None)]
    r.shuffle(rows)
    return rows


def kept(df):
    return {r["case_id"]: json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_arrivals_gives_the_batch_result(spark, tmp_path, seed):
    rows = arrivals(spark, seed)
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    now, sizes = {}, []

    def sink(result, gone, number):
        found = kept(result)
        sizes.append(set(found) | {r["case_id"] for r in gone.collect()})
        for r in gone.collect():
            now.pop(r["case_id"], None)
        now.update(found)

    def run():
        stream = spark.readStream.schema(state.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
        state.reconcile_events(stream, sink, checkpoint).awaitTermination(300)

    parts = [rows[i::3] for i in range(3)]
    for k, part in enumerate(parts[:2]):
        spark.createDataFrame(part, state.EVENTS).coalesce(1).write.mode("append").json(str(folder))
        if k == 1:
            run()
    spark.createDataFrame(parts[2], state.EVENTS).coalesce(1).write.mode("append").json(str(folder))
    run()  # a second run, from the checkpoint
    batches = len(sizes)
    entries = state.latest(spark.createDataFrame(rows, state.EVENTS))
    want = cases.settled(cases.reconcile(*state.unpacked(entries)), *state.RESULT)
    assert now == kept(want) and len(now) == len(SCENARIOS) - 1 and batches == 3
    # nothing new: repeats and older versions change no case; one correction changes its own alone
    spark.createDataFrame(rows[:40], state.EVENTS).coalesce(1).write.mode("append").json(str(folder))
    run()
    assert sizes[batches:] in ([], [set()])
    case, ordinal, field = entries.where("field = 'charges'").orderBy("case_id").select("case_id", "doc_ordinal", "field").first()
    spark.createDataFrame([(case, ordinal, field, 50, None)], state.EVENTS).coalesce(1).write.mode("append").json(str(folder))
    run()
    assert sizes[-1] == {case}
    assert now == kept(cases.settled(cases.reconcile(*state.unpacked(entries.where(~((F.col("case_id") == case) & (F.col("doc_ordinal") == ordinal) & F.col("field").eqNullSafe(F.lit(field)))))), *state.RESULT))
