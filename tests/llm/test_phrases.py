import hashlib

from helpers import collected, fixture, frame, sentence, words

from plinth.llm import phrases


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                keep[k : k + 20] = [False] * 20
            seen.add(window)
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out[i] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(df):
    return {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in collected(df).items()}


def test_equals_brute_force(spark):
    assert got(phrases.digest(frame(spark))) == brute([(r[0], r[1]) for r in fixture()])


def test_crowded_keys_are_split_by_window_with_the_same_result(spark):
    digests = phrases.deduplicated(frame(spark), split=1)
    removed = {i: r["n_removed"] for i, r in collected(digests).items()}
    assert removed == {i: n for i, (_, n, _) in brute([(r[0], r[1]) for r in fixture()]).items()}


def test_what_the_automata_do_not_locate_stays(spark):
    """The shard of the fixture's phrases: without the automaton's hits nothing is removed."""
    text = " ".join(f"v{i}" for i in range(30)).encode()
    shard = [(5, 1, (0, 0, 3), 2, text), (5, 1, (1, 0, 9), 2, text), (5, 1, (2, 0, 0), 1, b" ".join(text.split()[1:]))]
    assert phrases.located(shard) == [[0, 1, 2], [0, 1, 2], [0, 1]]
    assert [r[:4] for r in phrases.settled(shard)] == [(1, 0, 9, 31), (2, 0, 0, 21)]


def test_a_hot_phrase_in_ten_thousand_contexts(spark):
    import random

    rng = random.Random(8)
    hot = sentence(rng, 25)
    rows = [(i, f"{sentence(rng, 14, 10**6)} {hot} {sentence(rng, 14, 10**6)}", None, None, None) for i in range(10_000)]
    got_ = got(phrases.digest(frame(spark, rows, extra=False)))
    assert got_ == brute([(r[0], r[1]) for r in rows]) and sum(n for _, n, _ in got_.values()) > 25 * 9990


def test_cleaned_keeps_rows_columns_and_untouched_texts(spark):
    docs = frame(spark).selectExpr("*", "1 as _doc", "2 as _TIE", "3 as _ranges")
    out = phrases.cleaned(docs)
    assert out.schema == docs.schema
    rows, before = collected(out), {r[0]: r[1] for r in fixture()}
    removed = {i: n for i, (_, n, _) in brute(list(before.items())).items()}
    assert all(rows[i]["text"] == t for i, t in before.items() if not removed[i])
    assert all(len(words(rows[i]["text"])) == len(words(before[i])) - n for i, n in removed.items())
    assert rows[0]["n_chars"] == len(rows[0]["text"])


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert phrases.deduplicated(frame(spark, [])).count() == 0
    text = " ".join(f"v{i}" for i in range(25))
    rows = [(None, text, None, None, None), (3, text, None, None, None), (3, text, None, None, None)]
    out = sorted((str(r.doc_id), r.n_removed) for r in phrases.deduplicated(frame(spark, rows)).collect())
    assert out == [("3", 25), ("3", 25), ("None", 0)]
