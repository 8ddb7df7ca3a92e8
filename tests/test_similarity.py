"""Similar messages and their clusters against versions that compare all pairs in order."""

import random

import pytest

from quarry.operators import similarity as S


def jaccard(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)


def score(x, y):
    """x, y: (scope, role, tools, files, length)."""
    if x[:2] != y[:2]:
        return -1.0
    ratio = 1.0 if x[4] == y[4] == 0 else min(x[4], y[4]) / max(x[4], y[4])
    return 0.4 * jaccard(x[2], y[2]) + 0.4 * jaccard(x[3], y[3]) + 0.2 * ratio


def leaders(rows, limit, least=3):
    """The cluster of each (turn, message): the index of its leader."""
    owner = {}
    for i, x in enumerate(rows):
        if i in owner:
            continue
        group = [i] + [j for j in range(i + 1, len(rows)) if j not in owner and score(x, rows[j]) >= limit - 1e-9]
        if len(group) >= least:
            owner.update((j, i) for j in group)
    return owner


def made(seed, n, scopes=3):
    rng = random.Random(seed)
    pick = lambda names, k: frozenset(rng.sample(names, rng.randint(0, k)))
    tools, files = [f"t{i}" for i in range(4)], [f"f{i}.rs" for i in range(9)]
    return [(rng.choice([*range(scopes), None]), rng.choice(["user", "assistant", "tool", None]), pick(tools, 2), pick(files, 3), rng.choice([0, 1, 5, 10, 10, 40, 41, 300])) for _ in range(n)]


def frame(spark, rows, extra=()):
    data = [(x[0], i, x[1], sorted(x[2]), sorted(x[3]), x[4], "clash") for i, x in enumerate(rows)]
    return spark.createDataFrame([*data, *extra], "scope long, turn long, role string, tools array<string>, files array<string>, length long, id string")


@pytest.mark.parametrize("limit", [0.3, 0.4, 0.6, 0.75, 0.8])
def test_links(spark, limit):
    rows = made(int(limit * 100), 160)
    m = S.message_classes(frame(spark, rows))
    links = S.class_links(m, limit)
    turn_class = {r["turn"]: r["class"] for r in m.collect()}
    found = {(r.a, r.b): r.ratio for r in links.collect()}
    assert len(found) == links.count()
    for i, x in enumerate(rows):
        for j in range(i + 1, len(rows)):
            a, b = sorted((turn_class[i], turn_class[j]))
            ratio = 1.0 if x[4] == rows[j][4] == 0 else min(x[4], rows[j][4]) / max(x[4], rows[j][4])
            near = a == b or (a, b) in found and ratio >= found[a, b] - 1e-9
            assert near == (score(x, rows[j]) >= limit - 1e-9)
    got = {r.turn: r.n_links for r in S.link_counts(m, links).collect()}
    assert got == {i: sum(score(x, y) >= limit - 1e-9 for j, y in enumerate(rows) if j != i) for i, x in enumerate(rows)}


@pytest.mark.parametrize("limit", [0.4, 0.6])
def test_leaders(spark, limit):
    rows = made(7, 120, 2)
    m = S.message_classes(frame(spark, rows))
    got = {r.turn: r.leader["turn"] for r in S.leader_clusters(m, S.class_links(m, limit)).collect() if r.leader}
    want = {}
    for scope in {x[0] for x in rows}:
        at = [i for i, x in enumerate(rows) if x[0] == scope]
        want |= {at[i]: at[j] for i, j in leaders([rows[i] for i in at], limit).items()}
    assert want and got == want


def test_reads_of_files(spark):
    """Five reads of different files and their results make two clusters at 0.4."""
    rows = [x for i in range(5) for x in ((1, "assistant", frozenset({"read_file"}), frozenset({f"src/{i}.rs"}), 20), (1, "tool", frozenset({"read_file"}), frozenset({f"src/{i}.rs"}), 40))]
    m = S.message_classes(frame(spark, rows))
    got = {r.turn: r.leader["turn"] for r in S.leader_clusters(m, S.class_links(m, 0.4)).collect()}
    assert got == {i: i % 2 for i in range(10)}


def test_odd(spark):
    none = S.message_classes(frame(spark, []))
    assert S.class_links(none).count() == 0 and S.leader_clusters(none, S.class_links(none)).count() == 0
    odd = [(None, None, None, None, None, None, None)] * 3 + [(1, 1, "system", ["a"], [], 3, "x")] + [(1, 5, "user", ["a", None, "a"], [], 3, "x")] * 2
    m = S.message_classes(frame(spark, [], odd))
    got = S.leader_clusters(m, S.class_links(m)).collect()
    assert sorted((r.scope is None, r.leader is None) for r in got) == [(False, True)] * 2 + [(True, False)] * 3
    with pytest.raises(ValueError):
        S.class_links(m, 0.9)
