import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import cover_tree
from ragloom.llm.cover_tree import Group, Traversal, similar_vectors, tree, unit


def brute(vectors, least=0.9):
    """(id, vector or None) rows: links and components by all pairs and plain search."""
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cos(x, y):
        return math.fsum(a * b for a, b in zip(x, y)) / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))

    n = len(vectors)
    near = {i: [] for i in range(n)}
    for i in range(n):
        for j in range(i + 1, n):
            x, y = vectors[i][1], vectors[j][1]
            if sound(x) and sound(y) and len(x) == len(y) and (list(x) == list(y) or cos(x, y) >= least):
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [vectors[j][0] for j in seen if vectors[j][0] is not None]
        root = min(ids) if ids else None
        out.append((vectors[i][0], len(near[i]), root, vectors[i][0] == root))
    return sorted(out, key=repr)


def clustered(r, n, dims, spread, clusters):
    centres = r.normal(size=(clusters, dims))
    return centres[r.integers(clusters, size=n)] + spread * r.normal(size=(n, dims))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 80), st.integers(1, 5), st.sampled_from([0.0, 1e-9, 0.05, 0.2, 0.5, 1.5]), st.sampled_from([0.5, 0.9, 0.99]))
def test_traversal_against_all_pairs(seed, n, dims, spread, least):
    r = np.random.default_rng(seed)
    raw = clustered(r, n, dims, spread, 4)
    other = np.concatenate([clustered(r, n, dims, spread, 3), raw[: n // 2] * 2])
    groups, weights, places = [], [], []
    for x in (raw, other):
        order, begins = tree(unit(x))
        for level, begin in enumerate(begins):
            assert (begin <= np.arange(len(x))).all() and (cover_tree.distance(np.einsum("ij,ij->i", unit(x[order]), unit(x[order])[begin])) <= cover_tree.FIRST_RADIUS / 2**level + 1e-7).all()
            assert level == 0 or set(begins[level - 1]) <= set(begin)
        weight = r.integers(1, 4, size=len(x))
        groups.append(Group(x[order], begins, weight))
        weights.append(weight)
        places.append(x[order])
    for a, b in ((0, 1), (0, 0)):
        counts, label = Traversal(groups[a], groups[b], least).run()
        linked = unit(places[a]) @ unit(places[b]).T >= least
        want = linked @ weights[b]
        assert counts[: len(places[a])].tolist() == want.tolist()
        if a != b:
            assert counts[len(places[a]) :].tolist() == (weights[a] @ linked).tolist()
        i, j = np.nonzero(linked)
        shift = 0 if a == b else len(places[a])
        up = np.arange(len(label))
        for _ in range(len(up)):
            before = up.copy()
            np.minimum.at(up, i, up[j + shift])
            np.minimum.at(up, j + shift, up[i])
            if (before == up).all():
                break
        assert up.tolist() == label.tolist()


def test_many_pairs_are_opened_in_blocks(monkeypatch):
    monkeypatch.setattr(cover_tree, "PRODUCT", 50)
    test_traversal_against_all_pairs.hypothesis.inner_test(5, 70, 3, 0.2, 0.9)


ODD = [(900, None), (901, [0.0, 0.0]), (902, [float("nan"), 1.0]), (903, [1.0, None]), (904, [float("inf"), 1.0]), (905, []), (906, [1.0]), (907, [-2.0]), (908, [3.0, 0.0]), (909, [1e30, 0.0]), (910, [1e-30, 1e-32])]


@pytest.mark.parametrize("kind,group_bytes", [("float", 1 << 24), ("double", 3 * 8 * 20), ("float", 3 * 8 * 7)])
def test_rows_against_all_pairs(spark, kind, group_bytes):
    r = np.random.default_rng(7)
    base = clustered(r, 90, 3, 0.15, 12).astype(np.float32).astype(float).tolist()
    vectors = [*enumerate(base), *((200 + i, base[0]) for i in range(40)), (300, [2 * x for x in base[1]]), (3, base[3]), (None, base[4]), (None, base[4]), (4, base[80]), *ODD]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], f"vec_id long, embedding array<{kind}>, n_links int, uid string").repartition(3)
    got = similar_vectors(frame, group_bytes=group_bytes)
    assert dict(got.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(vectors)


def test_threshold_is_exact(spark):
    third = [math.sqrt(1 - 0.81), 0.9]
    vectors = [(0, [0.0, 1.0]), (1, third), (2, [math.sqrt(1 - 0.81) + 1e-12, 0.9]), (3, [math.sqrt(1 - 0.81) - 1e-12, 0.9])]
    got = {x.vec_id: x.n_links for x in similar_vectors(spark.createDataFrame(vectors[:1] + vectors[2:], "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 1, 2: 1, 3: 2}


def test_far_groups_do_not_meet():
    near = np.eye(3, dtype=bool)
    near[0, 1] = near[1, 0] = True
    # cells of 4, 4 and 8 places in groups of 4
    assert cover_tree._meeting(near, np.array([0, 4, 8, 16]), 4) == [[0, 1], [1], [2, 3], [3]]


def test_empty(spark):
    assert similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert similar_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0][1:] == (0, 1, True)
