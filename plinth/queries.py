"""The engine's operators over the driver's tables: each query with SQL that gives the same rows.

Computed doubles are rounded on both sides, and before they are ordered by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.spanish import stem_terms
from .functions.text import basename, extension, normalized, stem
from .operators import dml, fulltext, keyed, paging, spatial, vectors
from .runtime import fresh_path, ship
from .sources import files
from .sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **keys: str) -> DataFrame:
        engine = Engine(self.spark)
        for name, key in keys.items():
            engine.register(name, getattr(self, name), key)
        return engine.sql(text)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        own = name or f.__name__
        QUERIES[own] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[own] = sql
        return f

    return add


def dialect_query(name: str, text: str, sql: str, **keys: str) -> None:
    """A query in the dialect; its rows are the SQL's."""
    query(sql, name)(lambda t: t.sql(text, **keys))


# scans, projections, predicates, order and pages

dialect_query("scan_all", "SELECT * FROM part", "SELECT * FROM part", part="p_partkey")
dialect_query("project_columns", "SELECT p_partkey, p_name FROM part", "SELECT p_partkey, p_name FROM part", part="p_partkey")
dialect_query("project_unknown_dropped", "SELECT p_partkey, nothing, p_size FROM part", "SELECT p_partkey, p_size FROM part", part="p_partkey")
for _name, _where in {
    "filter_eq_key": "p_partkey = 77",
    "filter_eq_string": "p_brand = 'Brand#13'",
    "filter_gt": "p_retailprice > 950.5",
    "filter_lt": "p_size < 10",
    "filter_ge": "p_size >= 40",
    "filter_le": "p_retailprice <= 925",
    "filter_ne": "p_size != 7",
    "filter_ne_angle": "p_brand <> 'Brand#13'",
    "filter_between_key": "p_partkey BETWEEN 50 AND 150",
    "filter_between_double": "p_retailprice BETWEEN 910.0 AND 930.5",
    "filter_between_string": "p_brand BETWEEN 'Brand#12' AND 'Brand#31'",
    "filter_and": "p_size > 10 AND p_retailprice < 960",
    "filter_or": "p_size = 1 OR p_size = 50",
    "filter_and_or_precedence": "p_size = 1 OR p_size > 30 AND p_retailprice < 930",
}.items():
    dialect_query(_name, f"SELECT * FROM part WHERE {_where}", f"SELECT * FROM part WHERE {_where}", part="p_partkey")
dialect_query("filter_type_mismatch", "SELECT p_partkey FROM part WHERE p_size != 'abc' AND p_partkey < 100", "SELECT p_partkey FROM part WHERE p_size IS NOT NULL AND p_partkey < 100", part="p_partkey")
dialect_query("filter_type_mismatch_text", "SELECT p_partkey FROM part WHERE p_name > 5 OR p_brand != 7 AND p_partkey < 60", "SELECT p_partkey FROM part WHERE p_brand IS NOT NULL AND p_partkey < 60", part="p_partkey")
dialect_query("filter_out_of_range", "SELECT p_partkey FROM part WHERE p_partkey < 99999999999999999999 AND p_size != 1e300 AND p_partkey < 40", "SELECT p_partkey FROM part WHERE p_partkey < 40 AND p_size IS NOT NULL", part="p_partkey")
dialect_query("filter_between_date", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN '1995-01-01' AND '1996-12-31'", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'", orders="o_orderkey")
dialect_query("order_asc", "SELECT p_partkey, p_name FROM part ORDER BY p_name ASC", "SELECT p_partkey, p_name FROM part", part="p_partkey")
dialect_query("order_desc", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC", "SELECT p_partkey, p_retailprice FROM part", part="p_partkey")
dialect_query("order_limit_topk", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 25", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25", part="p_partkey")
dialect_query("order_by_hidden_column", "SELECT p_name FROM part ORDER BY p_partkey DESC LIMIT 30", "SELECT p_name FROM part ORDER BY p_partkey DESC LIMIT 30", part="p_partkey")
dialect_query("limit_n", "SELECT * FROM part ORDER BY p_partkey LIMIT 12", "SELECT * FROM part ORDER BY p_partkey LIMIT 12", part="p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 5 ORDER BY p_partkey LIMIT 20 OFFSET 40")
def page_offset_limit(t: Tables) -> DataFrame:
    return paging.page(t.sql("SELECT p_partkey, p_name FROM part WHERE p_size > 5 ORDER BY p_partkey", part="p_partkey"), 3, 20)


@query("SELECT count(*) AS total_rows, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM part WHERE p_size > 5")
def page_total(t: Tables) -> DataFrame:
    return paging.totals(t.sql("SELECT * FROM part WHERE p_size > 5", part="p_partkey"), 20)


# keyed access: events by user_id, loaded in the order of event_id

_EV = "event_id, user_id, event_type, value"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value")


@query(f"SELECT {_EV} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def btree_last_wins(t: Tables) -> DataFrame:
    return keyed.last_wins(_events(t), "user_id", "event_id")


@query(f"SELECT {_EV} FROM events WHERE user_id = 42 ORDER BY event_id DESC LIMIT 1")
def btree_point(t: Tables) -> DataFrame:
    return keyed.point(_events(t), "user_id", 42, "event_id", "btree")


@query(f"SELECT {_EV} FROM events WHERE user_id BETWEEN 20 AND 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def btree_range(t: Tables) -> DataFrame:
    return keyed.between(_events(t), "user_id", 20, 60, "event_id", "btree").orderBy("user_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 100 AND 1200 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def btree_range_large(t: Tables) -> DataFrame:
    return keyed.between(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", 100, 1200, "o_orderkey", "btree")


@query(f"SELECT {_EV} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def hash_first_match(t: Tables) -> DataFrame:
    return keyed.first_match(_events(t), "user_id", "event_id")


@query(f"SELECT {_EV} FROM events WHERE user_id BETWEEN 20 AND 60")
def hash_range(t: Tables) -> DataFrame:
    return keyed.between(_events(t), "user_id", 20, 60, "event_id", "hash")


_NOT_FIRST = f"SELECT {_EV} FROM events WHERE user_id IS DISTINCT FROM 42 OR event_id <> (SELECT min(event_id) FROM events WHERE user_id = 42)"


@query(_NOT_FIRST)
def hash_delete_first(t: Tables) -> DataFrame:
    return keyed.without_first(_events(t), "user_id", 42, "event_id")


_CHANGED = "SELECT event_id, user_id, event_type, CASE WHEN event_id = (SELECT min(event_id) FROM events WHERE user_id = 42) THEN 0.5 ELSE value END AS value FROM events"


@query(_CHANGED)
def hash_update_first(t: Tables) -> DataFrame:
    return keyed.updated_first(_events(t), "user_id", 42, "event_id", {"value": F.lit(0.5)})


@query("SELECT user_id % 4 AS slot, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys FROM events GROUP BY 1")
def hash_directory_histogram(t: Tables) -> DataFrame:
    return keyed.directory_histogram(t.events, "user_id")


@query(f"SELECT {_EV}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS _rn FROM events")
def isam_base_overflow(t: Tables) -> DataFrame:
    return keyed.base_and_overflow(_events(t), "user_id", "event_id")


@query(f"SELECT {_EV} FROM events WHERE user_id = 42 ORDER BY event_id LIMIT 1")
def isam_point_base(t: Tables) -> DataFrame:
    return keyed.point(_events(t), "user_id", 42, "event_id", "isam")


@query(f"SELECT {_EV} FROM events WHERE user_id = 42")
def isam_all_for_key(t: Tables) -> DataFrame:
    return keyed.all_for(_events(t), "user_id", 42, "event_id")


@query(f"SELECT {_EV} FROM events WHERE user_id BETWEEN 20 AND 60")
def isam_range(t: Tables) -> DataFrame:
    return keyed.between(_events(t), "user_id", 20, 60, "event_id", "isam").orderBy("user_id", "event_id")


@query(f"SELECT {_EV}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS _rn FROM ({_NOT_FIRST})")
def isam_delete_promote(t: Tables) -> DataFrame:
    left = keyed.without_first(_events(t), "user_id", 42, "event_id")
    return keyed.base_and_overflow(left, "user_id", "event_id")  # the first overflow row is the base now


_ABSENT = "count_if(user_id = 42) = 0"


@query(_CHANGED + f" UNION ALL SELECT max(event_id) + 1, 42, NULL, 0.5 FROM events HAVING {_ABSENT} UNION ALL SELECT max(event_id) + CASE WHEN {_ABSENT} THEN 2 ELSE 1 END, -5, NULL, 2.5 FROM events")
def isam_update_base(t: Tables) -> DataFrame:
    changed = keyed.updated_or_inserted(_events(t), "user_id", 42, "event_id", {"value": F.lit(0.5)})
    return keyed.updated_or_inserted(changed, "user_id", -5, "event_id", {"value": F.lit(2.5)})


@query("SELECT CAST((rn - 1) // 511 AS BIGINT) AS page, min(event_id) AS first_key, count(*) AS keys FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM (SELECT DISTINCT event_id FROM events)) GROUP BY 1")
def isam_page_directory(t: Tables) -> DataFrame:
    return keyed.page_directory(t.events, "event_id")


@query("SELECT CAST(page // 511 AS BIGINT) AS page, min(first_key) AS first_key, count(*) AS keys FROM (SELECT (rn - 1) // 511 AS page, min(event_id) AS first_key FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM (SELECT DISTINCT event_id FROM events)) GROUP BY 1) GROUP BY 1")
def isam_root_directory(t: Tables) -> DataFrame:
    return keyed.page_directory(keyed.page_directory(t.events, "event_id"), "first_key")


@query(f"SELECT {_EV} FROM events")
def isam_scan_ordered(t: Tables) -> DataFrame:
    return _events(t).orderBy("user_id", "event_id")


_SEQ_LIVE = f"SELECT {_EV} FROM events WHERE event_type <> 'error'"


def _sequential(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = _events(t)
    return rows.where("event_id % 10 <> 0"), rows.where("event_id % 10 = 0")


@query(_SEQ_LIVE)
def seq_scan_merged(t: Tables) -> DataFrame:
    return keyed.merged(*_sequential(t), "user_id", "event_id", F.col("event_type") != "error")


_SEQ_FIRST = "WHERE user_id = 42 ORDER BY CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, event_id LIMIT 1"


@query(f"SELECT {_EV} FROM events {_SEQ_FIRST}")
def seq_point(t: Tables) -> DataFrame:
    return keyed.sequential_point(*_sequential(t), "user_id", 42, "event_id")


@query(f"SELECT {_EV} FROM events WHERE user_id BETWEEN 20 AND 60")
def seq_range(t: Tables) -> DataFrame:
    return keyed.sequential_between(*_sequential(t), "user_id", 20, 60, "event_id")


@query(f"SELECT {_EV} FROM events WHERE event_id IS DISTINCT FROM (SELECT event_id FROM events {_SEQ_FIRST})")
def seq_delete(t: Tables) -> DataFrame:
    return keyed.sequential_without(*_sequential(t), "user_id", 42, "event_id")


@query(f"SELECT {_EV} FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def lookup_multi_key(t: Tables) -> DataFrame:
    return keyed.lookup(_events(t), "user_id", t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")))


@query("SELECT count(*) AS total_rows, count(DISTINCT user_id) AS distinct_keys, CAST(ceil(count(DISTINCT user_id) / 511.0) AS BIGINT) AS leaves FROM events")
def index_info_btree(t: Tables) -> DataFrame:
    return keyed.statistics(t.events, "user_id", "btree")


@query("SELECT count(*) AS total_rows, count(DISTINCT user_id) AS distinct_keys, count(*) - count(DISTINCT user_id) AS overflow, CAST(ceil(count(DISTINCT user_id) / 511.0) AS BIGINT) AS pages FROM events")
def index_info_isam(t: Tables) -> DataFrame:
    return keyed.statistics(t.events, "user_id", "isam")


@query("SELECT count(*) AS total_rows, count(DISTINCT user_id) AS distinct_keys, min(user_id) AS min_key, max(user_id) AS max_key FROM events")
def index_info_seq(t: Tables) -> DataFrame:
    return keyed.statistics(t.events, "user_id", "seq")


@query(f"SELECT {_EV} FROM events WHERE user_id <> 42")
def delete_key(t: Tables) -> DataFrame:
    return dml.deleted(_events(t), F.col("user_id") == 42)


@query("SELECT event_id, user_id, event_type, CASE WHEN event_id = 77 THEN 1.25 ELSE value END AS value FROM events")
def update_record(t: Tables) -> DataFrame:
    return dml.updated(_events(t), {"value": F.lit(1.25)}, F.col("event_id") == 77)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def bench_stats(t: Tables) -> DataFrame:
    return keyed.summary(t.events, "event_type", "value")


# the plane: the first two dimensions of the embeddings

_POINTS = "SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _boxes(t: Tables) -> tuple[DataFrame, tuple]:
    df = _points(t).select("vec_id", "x", "y", (F.col("x") + 0.05).alias("x2"), (F.col("y") + 0.1).alias("y2"))
    return df, (F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))


_BOXES = f"SELECT vec_id, x, y, x + 0.05 AS x2, y + 0.1 AS y2 FROM ({_POINTS})"


@query(f"SELECT * FROM ({_POINTS}) WHERE (x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02) <= 0.1 * 0.1")
def spatial_radius(t: Tables) -> DataFrame:
    return _points(t).where(spatial.within(F.col("x"), F.col("y"), 0.05, 0.02, 0.1))


@query(f"SELECT vec_id, round(sqrt((x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02)), 9) AS distance FROM ({_POINTS}) ORDER BY distance, vec_id LIMIT 15")
def spatial_knn(t: Tables) -> DataFrame:
    return spatial.nearest(_points(t), F.col("x"), F.col("y"), 0.05, 0.02, 15, "vec_id").select("vec_id", "distance")


@query(f"SELECT * FROM ({_POINTS}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0.0 AND 0.2")
def spatial_bbox(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _points(t).where(spatial.intersects((x, y, x, y), (-0.1, 0.0, 0.1, 0.2)))


@query(f"SELECT vec_id FROM ({_BOXES}) WHERE x <= 0.1 AND x2 >= -0.1 AND y <= 0.2 AND y2 >= 0.0")
def spatial_bbox_rects(t: Tables) -> DataFrame:
    df, box = _boxes(t)
    return df.where(spatial.intersects(box, (-0.1, 0.0, 0.1, 0.2))).select("vec_id")


@query(f"SELECT vec_id FROM ({_BOXES}) WHERE x <= 0.05 AND x2 >= 0.05 AND y <= 0.02 AND y2 >= 0.02")
def spatial_bbox_point(t: Tables) -> DataFrame:
    df, box = _boxes(t)
    return df.where(spatial.intersects(box, (0.05, 0.02, 0.05, 0.02))).select("vec_id")


@query(f"SELECT vec_id, round(sqrt(pow(greatest(x - 0.05, 0, 0.05 - x2), 2) + pow(greatest(y - 0.02, 0, 0.02 - y2), 2)), 9) AS distance FROM ({_BOXES})")
def spatial_mindist(t: Tables) -> DataFrame:
    df, box = _boxes(t)
    return df.select("vec_id", F.round(spatial.min_distance(box, 0.05, 0.02), 9).alias("distance"))


@query(f"SELECT vec_id, round((greatest(x2, 0.1) - least(x, -0.1)) * (greatest(y2, 0.2) - least(y, 0.0)) - (x2 - x) * (y2 - y), 9) AS growth FROM ({_BOXES})")
def spatial_enlargement(t: Tables) -> DataFrame:
    df, box = _boxes(t)
    return df.select("vec_id", F.round(spatial.enlargement(box, (-0.1, 0.0, 0.1, 0.2)), 9).alias("growth"))


@query(f"SELECT * FROM ({_POINTS}) WHERE vec_id <> 7")
def spatial_delete(t: Tables) -> DataFrame:
    return dml.deleted(_points(t), F.col("vec_id") == 7)


@query(f"SELECT label, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ({_POINTS}) GROUP BY label")
def rtree_mbr(t: Tables) -> DataFrame:
    return spatial.bounds(_points(t), F.col("x"), F.col("y"), ["label"])


dialect_query("sql_spatial_radius", "SELECT vec_id FROM embeddings WHERE embedding IN ((0.05, 0.02), 0.1)", f"SELECT vec_id FROM ({_POINTS}) WHERE (x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02) <= 0.1 * 0.1", embeddings="vec_id")
dialect_query("sql_spatial_knn", "SELECT vec_id, distance FROM embeddings WHERE embedding IN ((0.05, 0.02), 8)", f"SELECT vec_id, round(sqrt((x - 0.05) * (x - 0.05) + (y - 0.02) * (y - 0.02)), 9) AS distance FROM ({_POINTS}) ORDER BY distance, vec_id LIMIT 8", embeddings="vec_id")

# ranked text

_QUERY = "the that heed threeain of heed"
_NORMAL = "trim(regexp_replace(strip_accents(lower(text)), '[^0-9a-z]+', ' ', 'g'))"
_FTS = f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND trim(text) <> ''),
tok AS (SELECT doc_id, unnest(string_split({_NORMAL}, ' ')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS f FROM tok WHERE term <> '' GROUP BY doc_id, term),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM docs),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, log10(n / df) AS idf FROM dfs, nd),
w AS (SELECT term, doc_id, f, (1 + log10(f)) * idf AS weight FROM tf JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc_id),
qt AS (SELECT term, count(*) AS c FROM (SELECT unnest(string_split('{_QUERY}', ' ')) AS term) GROUP BY term),
qv AS (SELECT term, (1 + log10(c)) * idf AS qw FROM qt JOIN idf USING (term)),
sc AS (SELECT doc_id, round(sum(qw * weight) / (any_value(norm) * (SELECT sqrt(sum(qw * qw)) FROM qv)), 6) AS score
       FROM w JOIN qv USING (term) JOIN nrm USING (doc_id) WHERE norm > 0 GROUP BY doc_id) """


def _docs(t: Tables) -> DataFrame:
    return fulltext.documents(t.documents, "doc_id", "text")


def _index(t: Tables) -> fulltext.Index:
    return fulltext.Index(_docs(t))


_saved: dict[tuple[str, str], fulltext.Index] = {}


def _saved_index(t: Tables) -> fulltext.Index:
    """The folder's index, built and written by the first query of an application that searches it."""
    own = (t.spark.sparkContext.applicationId, t.folder)
    if own not in _saved:
        _saved[own] = _index(t).save(fresh_path(t.spark, "index"))
    return _saved[own]


def _scores(t: Tables, order: str = "desc") -> DataFrame:
    return _saved_index(t).search(_QUERY, None, order).select("doc_id", F.round("score", 6).alias("score"))


@query(_FTS + "SELECT (SELECT count(*) FROM w) AS n_postings, (SELECT count(*) FROM idf) AS n_terms, (SELECT count(*) FROM nrm) AS n_docs")
def fts_index_build(t: Tables) -> DataFrame:
    built = _index(t).save(fresh_path(t.spark, "index"))
    sizes = [df.agg(F.count("*").alias(name)) for df, name in ((built.tf, "n_postings"), (built.idf, "n_terms"), (built.norms, "n_docs"))]
    return sizes[0].crossJoin(F.broadcast(sizes[1])).crossJoin(F.broadcast(sizes[2]))  # one row each


@query(f"SELECT doc_id, {_NORMAL} AS text FROM documents")
def fts_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", normalized(F.col("text")).alias("text"))


@query(_FTS + "SELECT doc_id, term, f FROM tf", name="fts_term_freq")
def _(t: Tables) -> DataFrame:
    return _index(t).tf


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, md5(string_agg(term, ' ' ORDER BY pos)) AS digest FROM (SELECT doc_id, unnest(string_split(" + _NORMAL + ", ' ')) AS term, generate_subscripts(string_split(" + _NORMAL + ", ' '), 1) AS pos FROM documents WHERE trim(text) <> '') WHERE term <> '' GROUP BY doc_id")
def fts_tokens(t: Tables) -> DataFrame:
    return fulltext.digests(_docs(t))


@query(_FTS + "SELECT doc_id, count(*) AS n FROM tok WHERE term <> '' AND term NOT IN ('the', 'of', 'and', 'de', 'accion') GROUP BY doc_id")
def fts_stopwords(t: Tables) -> DataFrame:
    stop = t.spark.createDataFrame([(w,) for w in ("the", "of", "and", "de", "acción")], "term string")
    return fulltext.tokens(_docs(t), stop).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def fts_stem(t: Tables) -> DataFrame:
    ship(t.spark)
    words = fulltext.tokens(fulltext.documents(t.documents.where("lang = 'es'"), "doc_id", "text")).select("term").distinct()
    return words.select("term", stem_terms("term").alias("stem"))


@query(_FTS + "SELECT term, df FROM dfs")
def fts_doc_freq(t: Tables) -> DataFrame:
    return fulltext.document_frequencies(_index(t).tf)


@query(_FTS + "SELECT n FROM nd")
def fts_doc_count(t: Tables) -> DataFrame:
    return fulltext.count_documents(_docs(t))


@query(_FTS + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def fts_idf(t: Tables) -> DataFrame:
    return _index(t).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(_FTS + "SELECT doc_id, term, f, round(weight, 6) AS weight FROM w")
def fts_tfidf(t: Tables) -> DataFrame:
    return _index(t).postings.select("doc_id", "term", "f", F.round("weight", 6).alias("weight"))


@query(_FTS + "SELECT doc_id, round(norm, 6) AS norm FROM nrm")
def fts_doc_norms(t: Tables) -> DataFrame:
    return _index(t).norms.select("doc_id", F.round("norm", 6).alias("norm"))


@query(_FTS + "SELECT term, round(qw, 6) AS qw FROM qv")
def fts_query_vector(t: Tables) -> DataFrame:
    return fulltext.query_vector(t.spark, _QUERY, _index(t).idf).select("term", F.round("qw", 6).alias("qw"))


@query(_FTS + "SELECT doc_id, score FROM sc")
def fts_score(t: Tables) -> DataFrame:
    return _scores(t)


@query(_FTS + "SELECT count(*) AS n_hits, count(*) FILTER (WHERE score = 0) AS n_zero FROM sc")
def fts_zero_score_kept(t: Tables) -> DataFrame:
    return _scores(t).agg(F.count("*").alias("n_hits"), F.count_if(F.col("score") == 0).alias("n_zero"))


@query(_FTS + "SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 20")
def fts_topk(t: Tables) -> DataFrame:
    return _scores(t).orderBy(F.desc("score"), "doc_id").limit(20)


@query(_FTS + "SELECT doc_id, score FROM sc ORDER BY score, doc_id LIMIT 20")
def fts_topk_asc(t: Tables) -> DataFrame:
    return _scores(t).orderBy("score", "doc_id").limit(20)


@query(_FTS + "SELECT doc_id, score FROM sc ORDER BY abs(score) DESC, doc_id")
def fts_all_hits(t: Tables) -> DataFrame:
    return _scores(t).orderBy(F.desc(F.abs("score")), "doc_id")


@query(_FTS + "SELECT d.doc_id, lang, source, n_chars, score FROM (SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 20) h JOIN documents d USING (doc_id)")
def fts_rows_join(t: Tables) -> DataFrame:
    top = _scores(t).orderBy(F.desc("score"), "doc_id").limit(20)
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(F.broadcast(top), "doc_id").orderBy(F.desc("score"), "doc_id")  # 20 rows


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'heth') ORDER BY doc_id LIMIT 25")
def fts_fallback_scan(t: Tables) -> DataFrame:
    return fulltext.fallback(t.documents, "text", "Tion heth", 25, "doc_id").select("doc_id", "score")


@query("WITH d AS (SELECT doc_id, concat_ws(' ', source, text) AS text FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(string_split(" + _NORMAL + ", ' ')) AS term FROM d) WHERE term <> '' GROUP BY term")
def fts_title_text(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", F.concat_ws(" ", "source", "text").alias("text"))
    return fulltext.document_frequencies(fulltext.term_frequencies(fulltext.documents(both, "doc_id", "text")))


@query(_FTS + "SELECT term, sha1(term) AS file FROM dfs")
def fts_term_sha1(t: Tables) -> DataFrame:
    return fulltext.document_frequencies(_index(t).tf).select("term", F.sha1("term").alias("file"))


@query(_FTS + "SELECT term, count(*) AS df, CAST(sum(f) AS BIGINT) AS total FROM tf GROUP BY term")
def spimi_merge_blocks(t: Tables) -> DataFrame:
    return fulltext.merged_blocks(_index(t).tf, 8)


@query(_FTS + "SELECT term, round(ln((n + 1.0) / (df + 1.0)) + 1.0, 6) AS idf FROM dfs, nd")
def tfidf_smooth(t: Tables) -> DataFrame:
    i = _index(t)
    return i.idf.crossJoin(F.broadcast(fulltext.count_documents(i.docs))).select("term", F.round(vectors.smooth_idf(F.col("df"), F.col("n")), 6).alias("idf"))  # one row


@query(_FTS + "SELECT d.doc_id, lang, score FROM (SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 15) h JOIN documents d USING (doc_id)")
def sql_fulltext(t: Tables) -> DataFrame:
    """Through a FULLTEXT table whose index another engine reads."""
    root = fresh_path(t.spark, "tables")
    own = Catalog(t.spark, root)
    own.create("docs", t.documents, "fulltext", "doc_id")
    own.text_index("docs")
    return Engine(t.spark, root).sql(f"SELECT doc_id, lang, score FROM docs WHERE text @@ '{_QUERY}' LIMIT 15").withColumn("score", F.round("score", 6))


@query(_FTS + "SELECT d.doc_id, lang, score FROM (SELECT doc_id, score, lang FROM sc JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 12) h JOIN documents d USING (doc_id, lang)")
def sql_fulltext_and(t: Tables) -> DataFrame:
    return t.sql(f"SELECT doc_id, lang, score FROM documents WHERE text @@ '{_QUERY}' AND lang = 'en' LIMIT 12", documents="doc_id").withColumn("score", F.round("score", 6))


# vectors and visual words: descriptor = row, image = vec_id % 50, codebook = vec_id < 16

_D = "list_transform(embedding, lambda x: x::DOUBLE)"
_DOT = "list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))"
_VEC = f"""WITH e AS (SELECT vec_id, label, {_D} AS a FROM embeddings), q AS (SELECT {_D} AS b FROM embeddings WHERE vec_id = 3),
s AS (SELECT vec_id, label, round({_DOT} / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))), 6) AS score,
      round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM e, q) """


def _target(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 3").first()["embedding"]]


@query(_VEC + "SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def vec_cosine_topk(t: Tables) -> DataFrame:
    return vectors.cosine_top(t.embeddings, "embedding", _target(t), 10, "vec_id").select("vec_id", "score")


@query(_VEC + "SELECT vec_id, score FROM s")
def vec_cosine_pairs(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(vectors.cosine(F.col("embedding"), vectors.array(_target(t))), 6).alias("score"))


@query(_VEC + "SELECT vec_id, distance FROM s ORDER BY distance, vec_id LIMIT 10")
def vec_euclidean_topk(t: Tables) -> DataFrame:
    return vectors.euclidean_top(t.embeddings, "embedding", _target(t), 10, "vec_id").select("vec_id", "distance")


@query(f"SELECT vec_id, round(a[1] / n, 6) AS first, round(a[64] / n, 6) AS last FROM (SELECT vec_id, a, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS n FROM (SELECT vec_id, {_D} AS a FROM embeddings))")
def vec_normalize(t: Tables) -> DataFrame:
    unit = t.embeddings.select("vec_id", vectors.normalized(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


dialect_query("sql_vector_knn", "SELECT vec_id, score FROM embeddings WHERE embedding <-> '3' LIMIT 10", _VEC + "SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10", embeddings="vec_id")


@query(_VEC + "SELECT vec_id, score FROM s WHERE label = 4 ORDER BY score DESC, vec_id LIMIT 10")
def sql_vector_knn_scoped(t: Tables) -> DataFrame:
    engine = Engine(t.spark)
    engine.register("images", t.embeddings.select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("folder"), F.col("embedding").alias("v")), "vec_id")
    return engine.sql("M SELECT * FROM label4 WHERE image-sim <-> '3'").select("vec_id", "score")


_BOVW = f"""WITH cb AS (SELECT vec_id AS word_id, {_D} AS c FROM embeddings WHERE vec_id < 16),
d AS (SELECT vec_id, vec_id % 50 AS image_id, label, {_D} AS v FROM embeddings),
dist AS (SELECT vec_id, image_id, label, word_id, round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d2 FROM d, cb),
a AS (SELECT vec_id, image_id, label, arg_min(word_id, (d2, word_id)) AS word_id, min(d2) AS d2 FROM dist GROUP BY vec_id, image_id, label),
tot AS (SELECT image_id, count(*) AS total FROM a GROUP BY image_id),
h AS (SELECT image_id, word_id, count(*) / any_value(total) AS tf FROM a JOIN tot USING (image_id) GROUP BY image_id, word_id),
idf AS (SELECT word_id, ln((SELECT count(DISTINCT image_id) FROM h) / greatest(count(*), 1)) AS idf FROM h GROUP BY word_id),
w AS (SELECT image_id, word_id, tf * idf AS weight FROM h JOIN idf USING (word_id)),
p AS (SELECT * FROM w WHERE weight > 0),
qv AS (SELECT word_id, weight AS qw FROM w WHERE image_id = 7),
nrm AS (SELECT image_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY image_id) """


def _assigned(t: Tables) -> DataFrame:
    e = t.embeddings
    book = e.where("vec_id < 16").select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("centroid"))
    return vectors.assigned(e.select("vec_id", (F.col("vec_id") % 50).alias("image_id"), "label", F.col("embedding").alias("v")), book, ["vec_id", "image_id", "label"])


def _weighted(t: Tables) -> DataFrame:
    h = vectors.histogram(_assigned(t), "image_id")
    return vectors.weighted(h, vectors.visual_idf(h, "image_id"), "image_id")


def _visual_query(t: Tables) -> DataFrame:
    return _weighted(t).where("image_id = 7").select("word_id", F.col("weight").alias("qw"))


@query(_BOVW + "SELECT vec_id, word_id, d2 FROM a")
def bovw_assign_words(t: Tables) -> DataFrame:
    return _assigned(t).select("vec_id", "word_id", "d2")


@query(_BOVW + "SELECT image_id, word_id, round(tf, 6) AS tf FROM h")
def bovw_histogram(t: Tables) -> DataFrame:
    return vectors.histogram(_assigned(t), "image_id").select("image_id", "word_id", F.round("tf", 6).alias("tf"))


@query(_BOVW + "SELECT word_id, round(idf, 6) AS idf FROM idf")
def bovw_idf(t: Tables) -> DataFrame:
    return vectors.visual_idf(vectors.histogram(_assigned(t), "image_id"), "image_id").select("word_id", F.round("idf", 6).alias("idf"))


@query(_BOVW + "SELECT image_id, word_id, round(weight, 6) AS weight FROM w")
def bovw_tfidf(t: Tables) -> DataFrame:
    return _weighted(t).select("image_id", "word_id", F.round("weight", 6).alias("weight"))


@query(_BOVW + "SELECT image_id, word_id, round(weight, 6) AS weight FROM p")
def bovw_postings(t: Tables) -> DataFrame:
    return vectors.postings(_weighted(t)).select("image_id", "word_id", F.round("weight", 6).alias("weight"))


@query(_BOVW + "SELECT round((SELECT count(*) FROM p) / (SELECT count(*) FROM cb), 6) AS avg_len")
def bovw_avg_posting_len(t: Tables) -> DataFrame:
    return vectors.average_posting_length(vectors.postings(_weighted(t)), t.embeddings.where("vec_id < 16"))


@query(_BOVW + "SELECT n.image_id, round(coalesce(dot, 0) / (norm * (SELECT sqrt(sum(qw * qw)) FROM qv)), 6) AS score FROM nrm n LEFT JOIN (SELECT image_id, sum(weight * qw) AS dot FROM w JOIN qv USING (word_id) GROUP BY image_id) s ON n.image_id = s.image_id WHERE norm > 0 ORDER BY score DESC, n.image_id LIMIT 10")
def bovw_sequential_search(t: Tables) -> DataFrame:
    return vectors.sequential_search(_weighted(t), _visual_query(t), "image_id", 10)


@query(_BOVW + "SELECT image_id, round(sum(weight * qw) / (any_value(norm) * (SELECT sqrt(sum(qw * qw)) FROM qv)), 6) AS score FROM p JOIN qv USING (word_id) JOIN nrm USING (image_id) GROUP BY image_id ORDER BY score DESC, image_id LIMIT 10")
def bovw_inverted_search(t: Tables) -> DataFrame:
    return vectors.inverted_search(vectors.postings(_weighted(t)), _visual_query(t), "image_id", 10)


_SCOPED = _BOVW.replace("nrm AS (", "fa AS (SELECT * FROM a WHERE label = 4), ft AS (SELECT image_id, count(*) AS total FROM fa GROUP BY image_id), fh AS (SELECT image_id, word_id, count(*) / any_value(total) AS tf FROM fa JOIN ft USING (image_id) GROUP BY image_id, word_id), fw AS (SELECT image_id, word_id, tf * idf AS weight FROM fh JOIN idf USING (word_id)), nrm AS (")


@query(_SCOPED + "SELECT image_id, word_id, round(weight, 6) AS weight FROM fw")
def bovw_scoped_global_idf(t: Tables) -> DataFrame:
    own = _assigned(t)
    idf = vectors.visual_idf(vectors.histogram(own, "image_id"), "image_id")
    return vectors.weighted(vectors.histogram(own.where("label = 4"), "image_id"), idf, "image_id").select("image_id", "word_id", F.round("weight", 6).alias("weight"))


@query()
def bovw_kmeans_fit(t: Tables) -> DataFrame:
    return vectors.fit_codebook(t.embeddings.select(F.col("embedding").alias("v")), 10)


_GROWN = f"""WITH cb AS (SELECT vec_id AS word_id, {_D} AS c FROM embeddings WHERE vec_id < 16),
d AS (SELECT vec_id, {_D} AS v FROM embeddings WHERE vec_id >= 16),
dist AS (SELECT vec_id, any_value(v) AS v, word_id, min(round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)) AS d2 FROM d, cb GROUP BY vec_id, word_id),
a AS (SELECT vec_id, any_value(v) AS v, arg_min(word_id, (d2, word_id)) AS word_id FROM dist GROUP BY vec_id),
x AS (SELECT word_id, count(*) AS m, sum(v[1]) AS s1, sum(v[64]) AS s64 FROM a GROUP BY word_id)
SELECT cb.word_id, 1 + coalesce(m, 0) AS n, round((c[1] + coalesce(s1, 0)) / (1 + coalesce(m, 0)), 6) AS first, round((c[64] + coalesce(s64, 0)) / (1 + coalesce(m, 0)), 6) AS last FROM cb LEFT JOIN x USING (word_id)"""


@query(_GROWN)
def bovw_incremental(t: Tables) -> DataFrame:
    book = t.embeddings.where("vec_id < 16").select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("centroid"))
    new = t.embeddings.where("vec_id >= 16").select(F.col("embedding").alias("v"))
    grown = vectors.grown_codebook(book, book.select("word_id", F.lit(1).cast("long").alias("n")), new)
    return grown.select("word_id", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[63], 6).alias("last"))


# paths, sources, catalog, DDL and DML


@query("SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1)) IN ('.html', '.jpg', '.png')")
def src_extension_filter(t: Tables) -> DataFrame:
    return t.pages.where(extension(F.col("url")).isin(".html", ".jpg", ".png")).select("page_id", "url")


@query("SELECT page_id, b AS name, regexp_replace(b, '^(.+)\\.[^.]*$', '\\1') AS stem FROM (SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS b FROM pages)")
def str_basename_stem(t: Tables) -> DataFrame:
    return t.pages.select("page_id", basename(F.col("url")).alias("name"), stem(F.col("url")).alias("stem"))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_csv_roundtrip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    files.write_csv(t.customer, path)
    return files.read_csv(t.spark, path)


@query(f"SELECT CAST(vec_id AS VARCHAR) AS image_id, round(list_sum({_D}), 6) AS total FROM embeddings")
def src_json_features(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "features")
    files.write_features(t.embeddings, path, "vec_id", "embedding")
    return files.read_feature_lines(t.spark, path).select("image_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _catalog(t: Tables) -> str:
    root = fresh_path(t.spark, "tables")
    own = Catalog(t.spark, root)
    for name, df, kind, key in (("customers", t.customer, "btree", "c_custkey"), ("nations", t.nation, "hash", "n_nationkey"), ("regions", t.region, "seq", "r_regionkey")):
        own.create(name, df, kind, key, f"{name}.parquet")
    return root


@query("SELECT * FROM customer")
def catalog_roundtrip(t: Tables) -> DataFrame:
    return Catalog(t.spark, _catalog(t)).load("customers")


_CATALOG = "SELECT * FROM (VALUES ('customers', 'btree', 'c_custkey', 'customers.parquet', 5::INTEGER), ('nations', 'hash', 'n_nationkey', 'nations.parquet', 3), ('regions', 'seq', 'r_regionkey', 'regions.parquet', 2)) v(table_name, index_kind, key, source, n_columns)"


@query(_CATALOG)
def catalog_tables(t: Tables) -> DataFrame:
    return Catalog(t.spark, _catalog(t)).tables()


@query(_CATALOG + " WHERE contains(table_name, 'ion')")
def catalog_search(t: Tables) -> DataFrame:
    return Catalog(t.spark, _catalog(t)).find("ION")


@query("SELECT * FROM (VALUES (1::BIGINT, 'café', 2.5::DOUBLE, DATE '2024-01-02'), (2, 'pan', NULL, DATE '2024-02-03')) v(id, name, price, day)")
def ddl_create_insert(t: Tables) -> DataFrame:
    return Engine(t.spark).sql("""
        CREATE TABLE menu (id INT KEY INDEX BTree, name VARCHAR[20], price FLOAT, day DATE);
        INSERT INTO menu VALUES (1, 'café', 2.5, '2024-01-02');
        INSERT INTO menu VALUES (2, 'pan', NULL, '2024-02-03');
        SELECT * FROM menu""")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part UNION ALL SELECT 999999, 'new', 'Brand#99', 'NONE', 5, 12.5")
def dml_insert(t: Tables) -> DataFrame:
    return dml.inserted(t.part, (999999, "new", "Brand#99", "NONE", 5, 12.5), "p_partkey")


@query("SELECT * FROM part WHERE p_partkey <> 77")
def dml_delete_key(t: Tables) -> DataFrame:
    return dml.deleted(t.part, F.col("p_partkey") == 77)


@query("SELECT * FROM part WHERE NOT (p_size > 40 AND p_retailprice < 950)")
def dml_delete_predicate(t: Tables) -> DataFrame:
    return dml.deleted(t.part, (F.col("p_size") > 40) & (F.col("p_retailprice") < 950))


@query("SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size < 5 THEN 0 ELSE p_size END AS p_size, CASE WHEN p_size < 5 THEN 1.0 ELSE p_retailprice END AS p_retailprice FROM part")
def dml_update(t: Tables) -> DataFrame:
    return dml.updated(t.part, {"p_size": F.lit(0), "p_retailprice": F.lit(1.0)}, F.col("p_size") < 5)


def _orders_table(t: Tables, kind: str) -> Engine:
    """An engine with orders, keyed by the customer: many rows a key, in the order of o_orderkey."""
    engine = Engine(t.spark, fresh_path(t.spark, "tables"))
    engine.catalog.create("o", t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("_pos")), kind, "o_custkey")
    return engine


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_custkey = 10) THEN 9.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey DESC LIMIT 1")
def engine_update_btree(t: Tables) -> DataFrame:
    engine = _orders_table(t, "btree")
    engine.update("o", 10, o_totalprice=9.5)
    return engine.get("o", 10)


@query(_ORDERS + " WHERE o_custkey = 10 AND o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 10)")
def engine_delete_hash(t: Tables) -> DataFrame:
    engine = _orders_table(t, "hash")
    engine.remove("o", 10)
    return engine.sql("SELECT * FROM o WHERE o_custkey = 10")


@query(_ORDERS + " WHERE NOT (o_custkey BETWEEN 5 AND 50 AND o_orderstatus = 'F') UNION ALL SELECT 99999999, 7, 'N', 1.5")
def engine_dml_statements(t: Tables) -> DataFrame:
    engine = _orders_table(t, "isam")
    return engine.sql("DELETE FROM o WHERE o_custkey BETWEEN 5 AND 50 AND o_orderstatus = 'F'; INSERT INTO o VALUES (99999999, 7, 'N', 0.5); UPDATE o SET o_totalprice = 1.5 WHERE o_orderkey = 99999999; SELECT * FROM o")


@query(_ORDERS + " WHERE o_custkey BETWEEN 10 AND 20 UNION ALL SELECT 90000000 + i, 11, 'N', i FROM range(1, 8) r(i)")
def engine_seq_add(t: Tables) -> DataFrame:
    engine = _orders_table(t, "seq")
    for i in range(1, 8):  # the fifth part makes a new snapshot
        engine.sql(f"INSERT INTO o VALUES ({90000000 + i}, 11, 'N', {float(i)})")
    return engine.range("o", 10, 20)


@query(f"SELECT vec_id, x, y FROM ({_POINTS}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0.0 AND 0.2")
def engine_rtree_box(t: Tables) -> DataFrame:
    engine = Engine(t.spark, fresh_path(t.spark, "tables"))
    engine.catalog.create("p", _points(t).select("vec_id", "x", "y"), "rtree", "vec_id")
    return engine.box("p", (-0.1, 0.0, 0.1, 0.2))


@query(_BOVW + "SELECT image_id, round(sum(weight * qw) / (any_value(norm) * (SELECT sqrt(sum(qw * qw)) FROM qv)), 6) AS score FROM p JOIN qv USING (word_id) JOIN nrm USING (image_id) GROUP BY image_id ORDER BY score DESC, image_id LIMIT 10")
def engine_visual_index_or_scan(t: Tables) -> DataFrame:
    engine, weighted = Engine(t.spark), _weighted(t)
    engine.register("histograms", weighted, "image_id")
    engine.register("histograms_postings", vectors.postings(weighted), "image_id")
    return engine.similar(7)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """A ranked text query joined back to its documents."""
    return QUERIES["fts_rows_join"](spark, folder)
