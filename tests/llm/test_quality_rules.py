from collections import Counter

import numpy as np
from helpers import collected, fixture, frame, words

from plinth.llm import quality_rules as q


def brute(text):
    w = words(text)
    found = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if found[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def test_counts_equal_brute_force(spark):
    rows = fixture() + [(100, "a#b $ | <x>\n\na#b\n  \na#b", None, None, 1), (101, "p q r s t u v w " * 3 + "end", "en", "s", 1)]
    got = collected(q.judged(frame(spark, rows)))
    for i, text, *_ in rows:
        assert {k: got[i][k] for k in brute(text)} == brute(text), i
    assert all(not r["kept"] for r in got.values() if r["base_failed"])


def clean(rng, i):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(60, 200))) + f" n{i}"


def test_outliers_go_and_clean_rows_stay(spark):
    rng = np.random.default_rng(2)
    rows = [(i, clean(rng, i), "en", "a", 1) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "###$$$" for w in clean(rng, i).split()), "en", "a", 1) for i in range(20)]
    got = collected(q.judged(frame(spark, rows)))
    assert all(got[i]["kept"] for i in range(200)) and not any(got[1000 + i]["kept"] for i in range(20))


def numpy_estimate(X, prior=None):
    """(determinant, centre, covariance, subset's moments) by plain concentration steps from the same starts."""
    lower = lambda x, p: np.quantile(x, p, axis=0, method="inverted_cdf")
    floor, best = np.array([q.FLOOR[d] for d in q.DIMENSIONS]), None
    low, mid, high = (lower(X, p) for p in (0.25, 0.5, 0.75))
    for c, S in ((mid, np.eye(4)), (mid, np.diag(np.maximum((high - low) / 1.349, np.sqrt(floor)) ** 2)), (low, np.eye(4))):
        last = None
        for _ in range(q.STEPS):
            d = np.einsum("ij,jk,ik->i", X - c, np.linalg.inv(S), X - c)
            near = X[d <= lower(d, q.H) * (1 + 1e-12)]
            n, m, mm = len(near), near.sum(0), near.T @ near
            if prior is not None:
                n, m, mm = n + q.PRIOR, m + q.PRIOR * prior[1] / prior[0], mm + q.PRIOR * prior[2] / prior[0]
            c = m / n
            S = q.CONSISTENCY * (mm / n - np.outer(c, c)) + np.diag(floor)
            det = np.linalg.det(S)
            if last is not None and abs(det / last - 1) < 1e-9:
                break
            last = det
        if best is None or det < best[0] * (1 - 1e-9):
            best = (det, c, S, (n, m, mm))
    return best


def test_every_verdict_equals_a_plain_version_with_small_groups(spark):
    """Groups of 20 to 60 rows, a group of repeated rows, and one without a sound row."""
    rng, rows = np.random.default_rng(7), []
    for g, size in enumerate((20, 35, 60, 22, 48)):
        for _ in range(size):
            text = clean(rng, len(rows))
            if rng.random() < 0.1:
                text += " # $ % <" * int(rng.integers(1, 60))
            if rng.random() < 0.1:
                text += "\nsome line again" * int(rng.integers(1, 30))
            rows.append((len(rows), text, "en" if g < 3 else "de", f"s{g}", 1))
    rows += [rows[3]] * 25 + [(900, "too short", "fr", "z", 1), (None, clean(rng, 1), None, None, None)]
    df = q.statistics(frame(spark, rows)).select("*", *q._vector()).toPandas()
    df["sound"] = ~((df.n_words < 20) | (100 * df.n_repeat_words > 30 * df.n_words))
    want = []
    for lang, same in df.fillna({"lang": "", "source": ""}).groupby("lang"):
        X = same[same.sound][list(q.DIMENSIONS)].to_numpy()
        upper = numpy_estimate(X)[3] if len(X) else None
        for _, group in same.groupby("source"):
            X = group[group.sound][list(q.DIMENSIONS)].to_numpy()
            if not len(X):
                want += [(i, False) for i in group.doc_id]
                continue
            _, c, S, _ = numpy_estimate(X, upper)
            for i, sound, *v in group[["doc_id", "sound", *q.DIMENSIONS]].itertuples(index=False):
                d = np.array(v) - c
                want.append((i, bool(sound and d @ np.linalg.inv(S) @ d <= q.CUTOFF)))
    key = lambda r: (-1 if r[0] is None or r[0] != r[0] else int(r[0]), r[1])
    got = [(r.doc_id, r.kept) for r in q.judged(frame(spark, rows)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert 5 < sum(not k for _, k in want) < 100


def test_constants_of_chi_square():
    assert abs(q.CUTOFF - 18.467) < 1e-3 and abs(q.chi_square_quantile(0.75) - 5.385) < 1e-3 and abs(q.CONSISTENCY - 1.4866) < 2e-3


def test_empty_table(spark):
    assert q.judged(frame(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = q.judged(frame(spark))._jdf.queryExecution().executedPlan().toString() + q.statistics(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
