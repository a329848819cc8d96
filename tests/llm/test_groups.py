import math
import random

from archivolt.llm.groups import connected_groups, match_groups, union_find


def brute(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, seen = {}, set()
    for x in sorted(near):
        if x in seen:
            continue
        todo, group = [x], {x}
        while todo:
            for y in near[todo.pop()] - group:
                group.add(y)
                todo.append(y)
        seen |= group
        out |= {y: min(group) for y in group}
    return out


def test_rounds_equal_brute_force(spark):
    rnd = random.Random(1)
    pairs = [(f"n{rnd.randrange(400):03}", f"n{rnd.randrange(400):03}") for _ in range(260)]
    pairs += [(f"c{k:04}", f"c{k + 1:04}") for k in range(300)]  # a long chain
    pairs += [(f"z{k:04}", "hub") for k in range(300)] + [("a", None), (None, None), ("self", "self"), ("x", "y"), ("y", "x"), ("x", "y")]
    rnd.shuffle(pairs)
    df = spark.createDataFrame([(a, b, "k") for a, b in pairs], "a string, b string, node string")
    for per_part in (40, 10_000):
        got = [tuple(r) for r in connected_groups(df, per_part=per_part, fan_in=2).collect()]
        assert len(got) == len(set(got)) and dict(got) == brute(pairs)


def test_a_chain_takes_few_rounds(spark):
    n, per_part = 4000, 40
    pairs = [(f"{k:05}", f"{k + 1:05}") for k in range(n)]
    random.Random(3).shuffle(pairs)
    rounds = []
    got = dict(tuple(r) for r in connected_groups(spark.createDataFrame(pairs, "a string, b string"), per_part=per_part, rounds=rounds).collect())
    assert len(got) == n + 1 and set(got.values()) == {"00000"}
    assert rounds[0][0] == 100 * per_part and rounds[-1][0] <= per_part and rounds[-1][1] == 1
    assert len(rounds) <= 3 * math.log2(n / per_part)
    assert all(a > b for (a, _), (b, _) in zip(rounds, rounds[1:]))


def test_union_find():
    assert union_find([("b", "a"), ("c", "b"), ("e", "d")]) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_scores_and_ids(spark):
    rows = [("a:1", "b:1", 0.65), ("a_1", "c:1", 0.9), ("x:1", "y:1", 0.64), ("p:1", "q:1", None), ("s:1", "s:1", 1.0), ("k-1__img_p1", "a:1", 0.7)]
    df = spark.createDataFrame(rows, "id_a string, id_b string, match_score double")
    assert dict(tuple(r) for r in match_groups(df).collect()) == {"a:1": "a:1", "b:1": "a:1", "c:1": "a:1", "k-1__img_p1": "a:1"}
    assert match_groups(df.limit(0)).count() == 0
