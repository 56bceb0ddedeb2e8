"""Small documents with the cases every operator must bear, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def fixture(seed=1):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, repeats, nulls, empties, a long text."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(40)]
    base = sentence(rng, 100).split()
    for _ in range(6):  # near copies
        own = list(base)
        own[rng.randrange(100)] = "edit"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 3  # copies
    passage = sentence(rng, 30)
    texts += [f"{sentence(rng, 25)} {passage}\n{sentence(rng, 25)}" for _ in range(4)]
    texts += ["a b c d " * 20, "x " * 60, "", " \t\n", None, "one", "Ünïcode é café " * 9, "line one two\nline one two\nline one two", sentence(rng, 4000)]
    return [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows=None, extra=True):
    """Documents, with extra columns of clashing names."""
    df = spark.createDataFrame(fixture() if rows is None else rows, SCHEMA)
    if extra:
        for c in ("band", "rep", "group", "key", "hash", "ids", "score", "counts", "h", "tie"):
            df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df


def collected(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
