from helpers import collected, frame, sentence, words

import corpus_pipeline


def test_stages_equal_brute_force(spark, tmp_path):
    """run() on a small folder equals plain versions of the stages, applied one after the other."""
    import random

    from test_minhash import brute as near
    from test_phrases import brute as repeated

    from plinth.llm import classifier

    rng = random.Random(4)
    item = sentence(rng, 30, 5000)
    passage = sentence(rng, 40, 5000)
    rows = [(i, sentence(rng, 80, 5000), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)]
    rows += [(200 + i, f"{sentence(rng, 40, 5000)} {passage} {sentence(rng, 40, 5000)}", "en", "s", 1) for i in range(4)]
    rows += [(300 + i, f"{sentence(rng, 40, 5000)} {item} {sentence(rng, 40, 5000)}", "en", "s", 1) for i in range(3)]
    rows += [(400 + i, sentence(rng, 80, 5000).upper().replace(" ", "!! "), "en", "s", 1) for i in range(60)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 400), 0) for r in rows], "doc_id long, quality int, toxic int")
    rows += [(700, None, None, None, None), (701, "", "en", "s", 0)]
    # wholly repeated rows, rows without an id, columns of names that stages use themselves
    docs = frame(spark, rows + [rows[7]] * 3 + [(None, sentence(rng, 80, 5000), "en", "s", 1)] * 2)
    docs = docs.selectExpr("*", "1 as _doc", "2 as _tie", "array(3) as _ranges", "'s' as _scored", "map('a', 1) as row")
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    score = classifier.fit(docs, labels).scorer()
    left = {r[0]: r[1] for r in rows if score((r[1] or "").encode()) >= classifier.ACCEPT}
    assert {i for i in left if i < 700} == {r[0] for r in rows if r[0] < 400}
    kept = near(list(left.items()))
    left = {i: t for i, t in left.items() if kept[i][2]}
    gone = {i: n for i, (_, n, _) in repeated(list(left.items())).items()}
    left = {i: len(words(t)) - gone[i] for i, t in left.items()}
    leaks = {300}  # later ones lost the item as a repeated passage
    want = {i: n for i, n in left.items() if i not in leaks}

    frames, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames, folder)
        out.write.parquet(str(tmp_path / name))
        frames = spark.read.parquet(str(tmp_path / name))
        at[name] = frames
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames.columns == docs.columns
    assert at["benchmark decontamination"].count() == len(want)
    assert {i: len(words(r["text"])) for i, r in collected(at["benchmark decontamination"]).items()} == want
    run = corpus_pipeline.run(spark, folder)
    cut = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(cut).collect())) == sorted(map(tuple, frames.select(cut).collect()))
    assert {r.doc_id for r in run.select("doc_id").collect()} == set(want)


def test_near_copies_from_a_similarity_of_four_fifths_leave(spark):
    import random

    rng = random.Random(6)
    base = sentence(rng, 100, 5000).split()
    near = [f"edit{i}" if i in (30, 60) else w for i, w in enumerate(base)]  # 86 of 106 shingles: 0.811
    far = [f"edit{i}" if i in (30, 60, 90) else w for i, w in enumerate(base[::-1])]
    further = [f"other{i}" if i in (20, 50, 80) else w for i, w in enumerate(base[::-1])]  # below 0.8
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((base, near, far, further))]
    left = corpus_pipeline.near_duplicates(spark, frame(spark, rows, extra=False), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 3]


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "sf")
    frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
