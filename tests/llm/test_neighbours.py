import numpy as np

from archivolt.llm.neighbours import Forest, most_similar


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    x = np.repeat(centres, 20, 0) + 0.4 * rng.standard_normal((800, 24))
    df = spark.createDataFrame([(f"v{i:04}", [float(a) for a in v], "run") for i, v in enumerate(x)], "id string, vector array<float>, model_run string")
    got = most_similar(df, 5, leaf_rows=64, fit_rows=400, block_rows=100).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(f"v{i:04}", f"v{j:04}") for i in range(len(s)) for j in np.argsort(-s[i])[:5]}
    mine = {(r["id"], r["other"]) for r in got}
    assert len(got) == len(mine) == 800 * 5
    assert len(mine & true) / len(true) >= 0.9
    for r in got[:200]:
        assert abs(r["cos"] - s[int(r["id"][1:]), int(r["other"][1:])]) < 1e-5


def test_edges(spark):
    schema = "id string, vector array<float>, model_run string, other string"
    rows = [(f"c{k}", [1.0, 0.0], "r", "x") for k in range(9)]  # copies, more than k + 1
    rows += [("near", [2.0, 0.2], "r", "x"), ("far", [0.0, 3.0], "r", "x"), ("zero", [0.0, 0.0], "r", "x"), ("null", None, "r", "x"), ("hole", [1.0, None], "r", "x"), ("nan", [1.0, float("nan")], "r", "x"), (None, [1.0, 0.0], "r", "x"), ("empty", [], "r", "x"), ("near", [2.0, 0.2], "r", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in most_similar(df, 3, 0.5).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    assert got["c8"] == {1: "c0", 2: "c1", 3: "c2"}
    assert got["c0"] == {1: "c1", 2: "c2", 3: "c3"}
    assert got["near"] == {1: "c0", 2: "c1", 3: "c2"}
    assert set(got) == {f"c{k}" for k in range(9)} | {"near"}
    assert most_similar(df.limit(0)).count() == 0


def test_shared_queue_reaches_home_leaves_first():
    x = np.random.default_rng(2).standard_normal((300, 8)).astype(np.float32)
    f = Forest(x, 3, 20, 2)
    for seen in f.route(x, 9):
        assert [own for _, _, own in seen[:3]] == [True] * 3 and len({no for no, _, _ in seen}) == len(seen) == 9
        assert [far for _, far, _ in seen] == sorted(far for _, far, _ in seen) and not any(own for _, _, own in seen[3:])
    trees = [{f.bucket[no] for (t, _), no in f.leaf_no.items() if t == k} for k in range(3)]
    assert not trees[0] & trees[1] and not trees[1] & trees[2]


def test_leaves_stay_small_at_any_size(spark):
    """Comparisons a row do not grow with the rows, though the sample does not."""
    rng = np.random.default_rng(9)
    each = []
    for n in (2500, 10_000):
        x = (np.repeat(rng.standard_normal((n // 20, 12)), 20, 0) + 0.3 * rng.standard_normal((n, 12))).astype(np.float32)
        df = spark.createDataFrame([(f"v{i:05}", v.tolist(), "run") for i, v in enumerate(x)], "id string, vector array<float>, model_run string")
        seen = []
        got = most_similar(df, 5, fit_rows=64, leaf_rows=64, block_rows=512, compared=seen).collect()
        each.append(seen[0] / n)
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        ask = range(0, n, 50)
        s = u[list(ask)] @ u.T
        s[np.arange(len(s)), list(ask)] = -2
        true = {(f"v{i:05}", f"v{j:05}") for r, i in enumerate(ask) for j in np.argsort(-s[r])[:5]}
        assert len({(r["id"], r["other"]) for r in got} & true) / len(true) >= 0.9
    assert each[1] <= 1.3 * each[0]


def test_lengths_do_not_mix_and_large_leaves_are_cut(spark):
    rows = [(f"a{k:03}", [1.0, k * 1e-9], "r") for k in range(300)] + [(f"b{k}", [1.0, 0.5, float(k)], "r") for k in range(3)] + [("huge", [3e38, 1e38, 0.0], "r")]
    df = spark.createDataFrame(rows, "id string, vector array<float>, model_run string")
    got = most_similar(df, 2, 0.0, leaf_rows=4, fit_rows=16, block_rows=50).collect()
    assert len({r["id"] for r in got if r["id"][0] == "a"}) == 300 and all(r["other"][0] == "a" for r in got if r["id"][0] == "a")
    assert {r["id"] for r in got if r["id"][0] != "a"} == {"b0", "b1", "b2", "huge"}
