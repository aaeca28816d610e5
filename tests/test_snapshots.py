import random

from ontoloom.operators.snapshots import snapshot_changes, snapshot_rows

SCHEMA = "run string, delivered_at string, uri string, a string, section string"


def changes(spark, rows, keys=4):
    df = snapshot_rows(spark.createDataFrame(rows, SCHEMA), "s", ["uri"])
    return {(r["run"], r["item_key"], r["change"]) for r in snapshot_changes(df, keys).collect()}


def test_order_gaps_and_repeats(spark):
    rows = [("run_2", "d", "x", "1", None), ("run_2", "d", "x", "1", None), ("run_2", "d", "y", None, None), ("run_10", "c", "x", "2", None), ("run_10", "e", "z", "", None), ("run_11", "b", "x", "2", None), ("run_11", "b", "z", None, None), ("other", "b", "q", "1", None), (None, "b", "q", "1", None)]
    assert changes(spark, rows) == {("run_10", "x", "changed"), ("run_10", "y", "removed"), ("run_10", "z", "added"), ("run_11", "z", "changed")}


def test_random(spark):
    rnd = random.Random(1)
    state, rows, want, before = {}, [], set(), None
    for run in (1, 3, 4, 9, 10):
        for _ in range(40):
            k = f"k{rnd.randrange(300)}"
            if rnd.random() < 0.3:
                state.pop(k, None)
            else:
                state[k] = rnd.choice([None, "", "v", "w"])
        rows += [(f"run_{run}", str(rnd.random()), k, v, "s") for k, v in state.items() for _ in range(rnd.choice([1, 1, 2]))]
        if before is not None:
            want |= {(f"run_{run}", k, "added") for k in state.keys() - before.keys()} | {(f"run_{run}", k, "removed") for k in before.keys() - state.keys()}
            want |= {(f"run_{run}", k, "changed") for k in state.keys() & before.keys() if state[k] != before[k]}
        before = dict(state)
    rnd.shuffle(rows)
    assert changes(spark, rows) == want


def test_empty(spark):
    assert changes(spark, []) == set()
