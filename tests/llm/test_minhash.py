import numpy as np
from helpers import collected, fixture, frame, words

from plinth.llm import minhash


def shingles(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_equals_brute_force(spark):
    got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in collected(minhash.near_duplicates(frame(spark))).items()}
    assert got == brute([(r[0], r[1]) for r in fixture()])


def test_chains_and_unlinked_members_of_a_bucket(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows, own = [], list(base)
    for i in range(40):  # each text changes one more word: neighbours are linked, the ends are not
        own = list(own)
        own[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(own), None, None, None))
    got = {i: r["component_id"] for i, r in collected(minhash.near_duplicates(frame(spark, rows))).items()}
    assert got == {i: c for i, (_, c, _) in brute([(r[0], r[1]) for r in rows]).items()}


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (7, None, None, None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [("5", 2, 5, True), ("5", 2, 5, True), ("7", 0, 7, True), ("None", 2, 5, False)]


def test_signature_estimates_similarity_and_is_exact_for_equal_sets():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b, one = pool[:1000], pool[250:1250], pool[:1]
    s = minhash.super_minhash([a, b, a[::-1].copy(), one])
    assert (s[0] == s[2]).all() and not (s == minhash._UNSET).any()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    alone = minhash.super_minhash([a])  # blocks do not matter
    assert (alone[0] == s[0]).all()


def test_components_of_long_paths_and_hubs(spark):
    path = spark.range(1, 60).selectExpr("id as u", "id - 1 as v")
    hub = spark.range(101, 10_001).selectExpr("id as u", "100 as v").repartition(4)
    for one_task in (0, None):  # by rounds of stars, and in one task
        assert {(r.u, r.v) for r in minhash.components(path, one_task).collect()} == {(i, 0) for i in range(1, 60)}
        assert {(r.u, r.v) for r in minhash.components(hub, one_task).collect()} == {(i, 100) for i in range(101, 10_001)}


def test_copies_of_hot_sets_are_dealt_over_tasks_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 2)
    monkeypatch.setattr(minhash, "ONE_TASK", 0)
    got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in collected(minhash.near_duplicates(frame(spark))).items()}
    assert got == brute([(r[0], r[1]) for r in fixture()])
