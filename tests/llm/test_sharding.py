import hashlib
from collections import defaultdict

import pytest
from helpers import fixture, frame

from plinth.llm import sharding


def brute(rows, limit):
    """Recursive splitting of a bucket that is too large."""
    own = [(format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b"), len((t or "").encode()), i) for i, t in rows]
    out = []

    def split(prefix, items):
        if sum(b for _, b, _ in items) <= limit or len({h for h, _, _ in items}) == 1:
            out.extend((i, prefix, sum(b for _, b, _ in items)) for _, _, i in items)
        else:
            for bit in "01":
                part = [x for x in items if x[0][len(prefix)] == bit]
                if part:
                    split(prefix + bit, part)

    if own:
        split("", own)
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [300, 2000, 30_000, 1 << 30])
def test_equals_recursive_splitting(spark, limit):
    rows = [(r[0], r[1]) for r in fixture()]
    got = sharding.shard(frame(spark), limit).collect()
    assert sorted([(r.doc_id, r.shard, r.shard_bytes) for r in got], key=str) == brute(rows, limit)
    assert all(r.indivisible == (r.shard_bytes > limit) and len(r.shard) == r.local_depth for r in got)


def test_shards_part_the_hash_space(spark):
    got = {r.shard for r in sharding.shard(frame(spark), 800).collect()}
    assert not any(a != b and b.startswith(a) for a in got for b in got)


def test_empty_table_null_and_repeated_keys(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    rows = [(1, "x" * 50, None, None, 0)] * 3 + [(None, "y" * 10, None, None, 0), (2, None, None, None, 0)]
    by = defaultdict(set)
    for r in sharding.shard(frame(spark, rows), 20).collect():
        by[r.doc_id].add((r.shard, r.indivisible))
    assert len(by[1]) == 1 and by[1].pop()[1] and set(by) == {1, 2, None}


def test_written_shards_fit_their_limit_and_hold_every_row(spark, tmp_path):
    docs, limit = frame(spark), 2000
    found = sharding.write_shards(docs, str(tmp_path / "s"), limit)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    by = defaultdict(int)
    for r in back.select("shard_" if "shard_" in back.columns else "shard", "text").collect():
        by[r[0]] += len((r.text or "").encode())
    whole = {r.shard for r in sharding.shard(docs, limit).where("indivisible").select("shard").collect()}
    assert all(n <= limit or s[1:] in whole for s, n in by.items()) and len(by) == found.count()
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "s").glob("shard*=*") if d.name.partition("=p")[2] not in whole)


def test_a_hot_key_and_plan_without_python(spark):
    rows = [(7, "x" * 10, None, None, 0)] * 10_000 + [(i, "y" * 40, None, None, 0) for i in range(100, 400)]
    df = sharding.shard(frame(spark, rows, extra=False), 500)
    got = df.collect()
    assert sorted([(r.doc_id, r.shard, r.shard_bytes) for r in got], key=str) == brute([(r[0], r[1]) for r in rows], 500)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
