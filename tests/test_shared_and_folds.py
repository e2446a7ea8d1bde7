"""Shared items and folds as whole relations."""

import random
from collections import Counter
from itertools import combinations

from lodestone.operators import joins
from lodestone.plans import load


def test_shared_items_without_loss(spark):
    rows = [("x", ["p", "q", "r"]), ("y", ["p", "q", "r", "r"]), ("z", ["q", "r", "s"]), ("w", ["s"]), ("v", []), ("u", None), ("z", ["s"])]
    df = spark.createDataFrame(rows, "key string, items array<string>")
    held = {(i, k) for k, items in rows for i in items or []}
    members = joins.shared_members(df, "key", "items")
    assert Counter(map(tuple, members.collect())) == Counter((i, min(k for j, k in held if j == i), k) for i, k in held)
    want = Counter((a, b) for i in "pqrs" for a, b in combinations(sorted(k for j, k in held if j == i), 2))
    assert {(r.a, r.b): r.n for r in joins.shared_pairs(members, "key").collect()} == want
    assert want["y", "z"] == 2  # which a star from x loses


def test_shared_pairs_by_cells(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f"k{i:03d}", r.sample([f"w{j}" for j in range(40)], r.randrange(1, 7)) + ["hot"] * (i % 3 == 0)) for i in range(200)]
    rows += [("k007x", [f"w{j}" for j in range(40)] + ["hot"]), ("alone", ["nobody else"]), (None, ["w1"])]
    want = {}
    for (a, x), (b, y) in combinations(sorted(q for q in rows if q[0]), 2):
        if n := len(set(x) & set(y)):
            want[a, b] = n
    monkeypatch.setattr(joins, "BLOCK", 50)
    for step in (1, 30, joins.STEP):
        monkeypatch.setattr(joins, "STEP", step)
        got = joins.shared_pairs(joins.held_items(spark.createDataFrame(rows, "key string, items array<string>"), "key", "items"), "key")
        pairs = got.collect()
        assert {(p.a, p.b): p.n for p in pairs} == want and len(pairs) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # no pair is shuffled or kept


def test_fold_takes_all_turns(spark, tmp_path):
    turns = [(1, t, "user", f"one {t}") for t in (3, 0, 2, 1)] + [(2, 5, "user", "b"), (2, 3, "user", "a")] + [(3, 7, "user", "only")]
    turns += [(4, t, "user", f"hot {t}") for t in range(300, -1, -1)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r["values"] for r in load()[0]["followup_fold_all"](spark, str(tmp_path)).collect()}
    assert got == {1: [f"one {t}" for t in range(4)], 2: ["a", "b"], 3: ["only"], 4: [f"hot {t}" for t in range(301)]}
