"""Dense vectors (cosine, Euclid, top-k) and visual words (codebook, histograms, TF-IDF, inverted search)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, doubles(a)).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_top(df: DataFrame, field: str, target: list[float], k: int, key: str) -> DataFrame:
    """The k rows most like a vector; adds `score`, rounded so that ties are ties, which go to the smaller key."""
    return df.where(F.col(field).isNotNull()).withColumn("score", F.round(cosine(F.col(field), array(target)), 6)).orderBy(F.desc("score"), key).limit(k)


def euclidean_top(df: DataFrame, field: str, target: list[float], k: int, key: str) -> DataFrame:
    return df.where(F.col(field).isNotNull()).withColumn("distance", F.round(euclidean(F.col(field), array(target)), 6)).orderBy("distance", key).limit(k)


def smooth_idf(df: Column, n: Column) -> Column:
    """Smoothed natural-log IDF."""
    return F.log((n + F.lit(1.0)) / (df + F.lit(1.0))) + F.lit(1.0)


#: Words of a codebook that are sent to every task at once.
BLOCK = 10_000


def assigned(descriptors: DataFrame, codebook: DataFrame, keep: list[str], block: int = BLOCK) -> DataFrame:
    """descriptors (…, v) with the nearest codebook word (word_id, centroid); ties go to the smaller word.

    The codebook travels as one array of at most about `block` words: each descriptor is one row in and one row out.  A
    larger codebook goes by blocks, each of which may better the word found so far."""
    n = max(1, -(-codebook.count() // block))
    out = descriptors.withColumn("_best", F.lit(None).cast("struct<d2:double,word_id:bigint>"))
    for i in range(n):
        own = codebook.where(F.pmod(F.xxhash64("word_id"), F.lit(n)) == i) if n > 1 else codebook
        words = own.agg(F.sort_array(F.collect_list(F.struct("word_id", doubles(F.col("centroid")).alias("c")))).alias("words"))
        away = lambda w: F.round(_sum(F.zip_with("v", w["c"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))), 9)
        found = F.array_min(F.transform("words", lambda w: F.struct(away(w).alias("d2"), w["word_id"].cast("long").alias("word_id"))))
        best = F.array_min(F.array_compact(F.array("_best", found)))
        out = out.crossJoin(F.broadcast(words)).withColumn("_best", best).drop("words")  # one row
    kind = codebook.schema["word_id"].dataType
    return out.select(*keep, F.col("_best.word_id").cast(kind).alias("word_id"), F.col("_best.d2").alias("d2"))


def histogram(assigned_: DataFrame, image: str) -> DataFrame:
    """(image, word_id, tf): a word's share of the image's descriptors."""
    counts = assigned_.groupBy(image, "word_id").agg(F.count("*").alias("n"))
    totals = assigned_.groupBy(image).agg(F.count("*").alias("total"))
    return counts.join(totals, image).select(image, "word_id", (F.col("n") / F.col("total")).alias("tf"))


def visual_idf(histogram_: DataFrame, image: str) -> DataFrame:
    """(word_id, idf): natural log of images over images with the word."""
    n = histogram_.agg(F.count_distinct(image).alias("n_images"))
    return histogram_.groupBy("word_id").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word_id", F.log(F.col("n_images") / F.greatest("df", F.lit(1))).alias("idf"))  # one row


def weighted(histogram_: DataFrame, idf: DataFrame, image: str) -> DataFrame:
    return histogram_.join(idf, "word_id").select(image, "word_id", (F.col("tf") * F.col("idf")).alias("weight"))


def postings(weighted_: DataFrame) -> DataFrame:
    return weighted_.where("weight > 0")


def inverted_search(postings_: DataFrame, query: DataFrame, image: str, k: int) -> DataFrame:
    """Images that share a word with the query (word_id, qw), by cosine."""
    lengths = postings_.groupBy(image).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    qnorm = query.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm")).where("qnorm > 0")
    hits = postings_.join(query, "word_id").groupBy(image).agg(F.sum(F.col("weight") * F.col("qw")).alias("dot"))
    score = F.round(F.col("dot") / (F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")) * F.col("qnorm")), 6)
    return hits.join(lengths, image).crossJoin(F.broadcast(qnorm)).select(image, score.alias("score")).orderBy(F.desc("score"), image).limit(k)  # one row


def sequential_search(weighted_: DataFrame, query: DataFrame, image: str, k: int) -> DataFrame:
    """Cosine of every image with a norm, also where no word is shared."""
    lengths = weighted_.groupBy(image).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).where("norm > 0")
    qnorm = query.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm")).where("qnorm > 0")
    hits = weighted_.join(query, "word_id").groupBy(image).agg(F.sum(F.col("weight") * F.col("qw")).alias("dot"))
    score = F.round(F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("qnorm")), 6)
    return lengths.join(hits, image, "left").crossJoin(F.broadcast(qnorm)).select(image, score.alias("score")).orderBy(F.desc("score"), image).limit(k)  # one row


def average_posting_length(postings_: DataFrame, codebook: DataFrame) -> DataFrame:
    """(avg_len): postings for each word of the codebook."""
    words = codebook.agg(F.count("*").alias("words"))
    return postings_.agg(F.count("*").alias("n")).crossJoin(F.broadcast(words)).select(F.round(F.col("n") / F.col("words"), 6).alias("avg_len"))  # one row each


def _model(descriptors: DataFrame, words: int, seed: int, iterations: int):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = descriptors.select(array_to_vector(doubles(F.col("v"))).alias("features"))
    return KMeans(k=words, seed=seed, maxIter=iterations, featuresCol="features").fit(rows)


def fit_codebook(descriptors: DataFrame, words: int, seed: int = 42, iterations: int = 300, starts: int = 1) -> DataFrame:
    """(word_id, centroid) by k-means over the descriptors' vectors v; of several starts that of the least cost."""
    models = [_model(descriptors, words, seed + i, iterations) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return descriptors.sparkSession.createDataFrame(rows, "word_id int, centroid array<double>")


def grown_codebook(codebook: DataFrame, counts: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(word_id, centroid, n) after new descriptors: each joins its nearest word, whose centre moves to the mean of what
    it held (counts: word_id, n) and what has come.  The vocabulary keeps its size, and old descriptors are not read."""
    placed = assigned(descriptors, codebook, ["v"])
    sums = placed.select("word_id", F.posexplode(doubles(F.col("v"))).alias("i", "x")).groupBy("word_id", "i").agg(F.sum("x").alias("s"), F.count("*").alias("m"))
    new = sums.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a"), F.max("m").alias("m")).select("word_id", "m", F.transform("a", lambda z: z["s"]).alias("s"))
    old = codebook.join(counts, "word_id", "left").join(new, "word_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    moved = F.zip_with(doubles(F.col("centroid")), F.col("s"), lambda c, x: (c * F.col("n") + x) / (F.col("n") + F.col("m")))
    return old.select("word_id", F.when(F.col("m").isNull(), doubles(F.col("centroid"))).otherwise(moved).alias("centroid"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
