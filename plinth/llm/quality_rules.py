"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.  DataFrame functions only.

Statistics of every whole text are computed in the JVM and written as a narrow table.  Each language, then each
(language, source) group has its own estimate of location and covariance of the transformed statistics: from several
starts, concentration steps move to the h = H share of rows with the least Mahalanobis distances until no determinant
changes any more (STEPS at most), and the start with the least determinant is taken.  A group's moments are those of its
subset and of PRIOR rows distributed as its language's subset, so small groups lean on their language and large ones do
not; there is no other way for small groups.  The covariance is multiplied by the factor that makes it consistent for
normal data, and FLOOR, the least variance that matters, is added.  Rows beyond the 0.999 quantile of chi-square go.

A step is one aggregation for the distance quantiles and one for counts, sums and cross products, both map-side combined,
so that a hot source costs one row a task and nothing but the largest change of a determinant is collected.  The
covariance is inverted by Cholesky factors in column expressions; distances come from forward substitution.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, let, with_columns, written

WINDOW = 8
H, STEPS, PRIOR = 0.75, 12, 30
DIMENSIONS = ("word_length", "symbols", "dup_lines", "repeats")
#: Least variance of each coordinate: half of all texts have no symbol, repeated line or window at all.
FLOOR = {"word_length": 0.01, "symbols": 0.25, "dup_lines": 0.25, "repeats": 0.25}
#: Starts of the concentration: the medians with unit or quartile spread, and the lower quartiles.
STARTS = 3


def _chi_square_tail(x: float, dims: int) -> float:
    """Upper tail of chi-square with an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))


def chi_square_quantile(p: float, dims: int = len(DIMENSIONS)) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _chi_square_tail(mid, dims) < p else (low, mid)
    return low


#: Squared distance beyond which a row is rejected, and what makes a subset's covariance that of normal data.
CUTOFF = chi_square_quantile(0.999)
CONSISTENCY = H / (1 - _chi_square_tail(chi_square_quantile(H), len(DIMENSIONS) + 2))


def _repeated(hashes: Column) -> Column:
    """Positions covered by the windows whose hash another window of the array shares."""

    def cover(sorted_: Column) -> Column:
        n = F.size(sorted_)
        same = lambda i, j: sorted_[i]["h"] == sorted_[j]["h"]
        hit = lambda i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < n - 1) & same(i, F.least(i + 1, n - 1)))
        at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), hit), lambda i: sorted_[i]["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(unique, F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), cover))


def _window_hashes(words: Column) -> Column:
    def of(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + j] for j in range(WINDOW)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(let(hashed, of))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of docs; a null text has no words."""
    docs = with_columns(docs, ["doc_id", "lang", "source", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(_window_hashes(w), _repeated).alias("n_repeat_words")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    blanks = F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        (F.length("text") - blanks).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        both.alias("w"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _vector() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    # each estimate is damped by the text's length: a short text's ratios are noise
    return [
        (F.log((F.col("word_chars") + 50.0) / (n + 10.0))).alias("word_length"),
        (F.log1p(100.0 * F.col("n_symbols") / (n + 20.0))).alias("symbols"),
        (F.log1p(100.0 * F.col("n_dup_lines") / (n + 20.0))).alias("dup_lines"),
        (F.log1p(10.0 * F.col("n_repeat_words") / (n + 20.0))).alias("repeats"),
    ]


_PAIRS = [(a, b) for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[: i + 1]]
_MOMENTS = ["n", *[f"s_{d}" for d in DIMENSIONS], *[f"s_{a}_{b}" for a, b in _PAIRS]]
_FACTORS = [*[f"m_{d}" for d in DIMENSIONS], *[f"l_{a}_{b}" for a, b in _PAIRS]]


def _moments() -> list[Column]:
    sums = [F.sum(d).alias(f"s_{d}") for d in DIMENSIONS]
    return [F.count("*").cast("double").alias("n"), *sums, *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in _PAIRS]]


def _factors(moments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the moments, means m_*, Cholesky factors l_*_* of the covariances and their determinant det."""
    for d in DIMENSIONS:
        moments = moments.withColumn(f"m_{d}", F.col(f"s_{d}") / F.col("n"))
    for a, b in _PAIRS:
        v = CONSISTENCY * (F.col(f"s_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")) + (FLOOR[a] if a == b else 0.0)
        for c in DIMENSIONS[: DIMENSIONS.index(b)]:
            v = v - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
        v = F.sqrt(F.greatest(v, F.lit(FLOOR[a] / 2))) if a == b else v / F.col(f"l_{b}_{b}")
        moments = moments.withColumn(f"l_{a}_{b}", v)
    root = reduce(lambda x, y: x * y, [F.col(f"l_{d}_{d}") for d in DIMENSIONS])
    return moments.select(*keys, *_MOMENTS, *_FACTORS, (root * root).alias("det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's factors."""
    ys: list[Column] = []
    for i, a in enumerate(DIMENSIONS):
        y = F.col(a) - F.col(f"m_{a}")
        for j, b in enumerate(DIMENSIONS[:i]):
            y = y - F.col(f"l_{a}_{b}") * ys[j]
        ys.append(y / F.col(f"l_{a}_{a}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


SALTS = 32


def _with(rows: DataFrame, estimates: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows beside their group's estimates.  A hot group is dealt over SALTS tasks, its rows of estimates repeated."""
    salted = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64(*DIMENSIONS, "doc_id"), F.lit(SALTS)).cast("int"))
    return own.join(salted, [*keys, "_salt"], how).drop("_salt")


def _starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start and factors: STARTS rows a group."""
    quartiles = rows.groupBy(*keys).agg(*[F.percentile_approx(d, [0.25, 0.5, 0.75], 1000).alias(d) for d in DIMENSIONS])

    def one(start: int) -> Column:
        centre = [F.col(d)[0 if start == 2 else 1].alias(f"m_{d}") for d in DIMENSIONS]
        wide = lambda d: F.greatest((F.col(d)[2] - F.col(d)[0]) / 1.349, F.lit(math.sqrt(FLOOR[d])))
        spread = [((wide(a) if start == 1 else F.lit(1.0)) if a == b else F.lit(0.0)).alias(f"l_{a}_{b}") for a, b in _PAIRS]
        return F.struct(F.lit(start).alias("start"), *centre, *spread)

    return quartiles.select(*keys, F.inline(F.array(*[one(i) for i in range(STARTS)]))).withColumn("det", F.lit(None).cast("double"))


def estimates(rows: DataFrame, keys: list[str], prior: DataFrame | None = None, steps: int = STEPS, h: float = H) -> DataFrame:
    """keys, moments of the chosen subset and factors by group, a written table.

    prior: such a table by some of the keys, whose subset counts as PRIOR rows more of each group below it."""
    found, own = written(_starts(rows, keys), "mcd"), [*keys, "start"]
    upper = None
    if prior is not None:
        shared = [c for c in prior.columns if c in keys]
        upper = prior.select(*shared, *[(F.col(c) * PRIOR / F.col("n")).alias(f"p_{c}") for c in _MOMENTS])
    for _ in range(steps):
        near = _with(rows, found.select(*own, *_FACTORS), keys).select(*own, "doc_id", *DIMENSIONS, _distance().alias("d2"))
        limits = near.groupBy(*own).agg(F.percentile_approx("d2", h, 1000).alias("limit"))
        subset = _with(near, limits, own).where("d2 <= limit").groupBy(*own).agg(*_moments())
        if upper is not None:
            subset = subset.join(upper, shared, "left").select(*own, *[(F.col(c) + F.coalesce(f"p_{c}", F.lit(0.0))).alias(c) for c in _MOMENTS])
        after = written(_factors(subset, own), "mcd")
        change = after.alias("a").join(found.alias("b"), own).agg(F.max(F.abs(F.col("a.det") / F.col("b.det") - 1)), F.count("b.det")).first()
        discard(found)
        found = after
        if change[1] and change[0] < 1e-9:
            break
    best = F.min_by(F.struct(*[c for c in found.columns if c not in keys]), F.struct("det", "start")).alias("best")
    out = written(found.groupBy(*keys).agg(best).select(*keys, "best.*"), "mcd")
    discard(found)
    return out


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2) of every row.

    base_failed: under 20 words, or 100 * n_repeat_words > 30 * n_words.  kept: not base_failed and within `cutoff` of
    the robust centre of its group, which rows that fail the base rules have no part in; a group with no other rows has
    no centre, and its distance2 is null.  Null lang, source or doc_id are values like others (a null lang or source and
    an empty one share a group); ties at a quantile all count; repeated rows are each judged; a text of any length is
    one array of words in one task; an empty table gives an empty result.
    """
    rows = statistics(docs).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit(""))).withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rows = written(rows.select("*", *_vector()), "statistics")
    sound = rows.where("not base_failed").select("doc_id", "lang", "source", *DIMENSIONS)
    languages = estimates(sound, ["lang"])
    groups = estimates(sound, ["lang", "source"], languages)
    discard(languages)
    joined = _with(rows, groups.select("lang", "source", *_FACTORS), ["lang", "source"], "left").withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")
