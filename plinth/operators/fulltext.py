"""Ranked text retrieval: normalised terms, log TF x log10 IDF weights, cosine scores, top-k and substring fallback.

The index is three tables (term frequencies, idf, norms) of narrow rows.  A document's terms are counted where its text
is read; only ids that several rows have are brought together.  IDF reaches the rows of frequent terms, nearly all, by
broadcast, so that weights and norms shuffle the rows of rare terms alone.  A query touches only its terms' postings.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import terms, words
from ..runtime import delete, fresh_path, ship

#: Ids of several rows, and frequent terms, that are broadcast at most; bytes of text that are taken apart at once.
REPEATED, FREQUENT, BLOCK = 1_000_000, 200_000, 4 << 20


def documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text) of the rows with an id and a text."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null and trim(text) <> ''")


def tokens(docs: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, term); stop words, a table (term), are folded like the text."""
    out = docs.select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    if stopwords is not None:
        folded = stopwords.select(F.explode(terms(F.col("term"))).alias("term")).distinct()
        out = out.join(folded, "term", "left_anti").select("doc_id", "pos", "term")
    return out


def by_repetition(docs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose id no other row has, the other rows); None where there are none.  Of very many repeated ids all rows
    count as repeated.  Only ids are shuffled for this."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    n = ids.limit(REPEATED + 1).count()
    if not n:
        return docs, None
    if n > REPEATED:
        return None, docs
    few = F.broadcast(ids)  # REPEATED at most
    return docs.join(few, "doc_id", "left_anti"), docs.join(few, "doc_id", "left_semi")


def _blocks(batch):
    """(positions, texts as bytes) of a batch, about BLOCK bytes each."""
    at, texts, size = [], [], 0
    for i, text in enumerate(batch.column("text")):
        at.append(i)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= BLOCK:
            yield at, texts
            at, texts, size = [], [], 0
    if at:
        yield at, texts


def _counted(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at, texts in _blocks(batch):
            counts = [Counter(words(text)) for text in texts]
            found = pa.array([term for c in counts for term in c], pa.binary()).cast(pa.string())
            ids = batch.column("doc_id").take(pa.array(np.repeat(at, [len(c) for c in counts])))
            yield pa.RecordBatch.from_arrays([ids, found, pa.array([f for c in counts for f in c.values()], pa.int64())], ["doc_id", "term", "f"])


def _folded(batches):
    import pyarrow as pa

    for batch in batches:
        for at, texts in _blocks(batch):
            found = [words(text) for text in texts]
            joined = pa.array([b" ".join(w) for w in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), joined, pa.array([len(w) for w in found], pa.int64())], ["doc_id", "words", "n"])


def _in_rows(docs: DataFrame, f, *columns: T.StructField) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(f, T.StructType([docs.schema["doc_id"], *columns]))


def _term_counts(rows: DataFrame) -> DataFrame:
    return _in_rows(rows, _counted, T.StructField("term", T.StringType()), T.StructField("f", T.LongType()))


def term_frequencies(docs: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, f) of documents; rows of one id count together."""
    once, several = by_repetition(docs)
    parts = [_term_counts(once)] if once is not None else []
    if several is not None:
        parts.append(_term_counts(several).groupBy("doc_id", "term").agg(F.sum("f").alias("f")))
    out = reduce(DataFrame.unionByName, parts)
    if stopwords is not None:
        folded = stopwords.select(F.explode(terms(F.col("term"))).alias("term")).distinct()
        out = out.join(folded, "term", "left_anti").select("doc_id", "term", "f")
    return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, digest): MD5 of a document's terms in their order, for documents with any.  Rows of one id are
    taken together, by position and then by term."""
    once, several = by_repetition(docs)
    parts = []
    if once is not None:
        rows = _in_rows(once, _folded, T.StructField("words", T.StringType()), T.StructField("n", T.LongType()))
        parts.append(rows.where("n > 0").select("doc_id", F.col("n").alias("n_tokens"), F.md5("words").alias("digest")))
    if several is not None:
        rows = tokens(several).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
        parts.append(rows.select("doc_id", "n_tokens", F.md5(F.array_join("t.term", " ")).alias("digest")))
    return reduce(DataFrame.unionByName, parts)


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf); n_docs is one row (n)."""
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", F.log10(F.col("n") / F.col("df")).alias("idf"))  # one row


def count_documents(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_distinct("doc_id").alias("n"))


def weights(tf: DataFrame, idf_: DataFrame) -> DataFrame:
    """(term, doc_id, f, weight)."""
    return tf.join(idf_, "term").select("term", "doc_id", "f", ((F.lit(1.0) + F.log10("f")) * F.col("idf")).alias("weight"))


def frequent_from(idf_: DataFrame) -> int:
    """The least power of two such that at most FREQUENT terms are in so many documents."""
    counts = {r.b: r.n for r in idf_.groupBy(F.floor(F.log2("df")).alias("b")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    bits, n = max(counts, default=-1) + 1, 0
    while bits and n + counts.get(bits - 1, 0) <= FREQUENT:
        bits -= 1
        n += counts.get(bits, 0)
    return 1 << bits


def weights_of_all(tf: DataFrame, idf_: DataFrame) -> DataFrame:
    """weights() of whole tables, which are read more than once: idf of frequent terms, FREQUENT at most, is broadcast, and
    only rows of the others are shuffled."""
    least = frequent_from(idf_)
    frequent = F.broadcast(idf_.where(F.col("df") >= least))
    out = weights(tf, frequent)
    return out if least == 1 else out.unionByName(weights(tf.join(frequent.select("term"), "term", "left_anti"), idf_.where(F.col("df") < least)))


def norms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def query_vector(spark, text: str, idf_: DataFrame) -> DataFrame:
    """(term, qw) of the query's known terms."""
    query = spark.range(1).select(F.lit(0).alias("doc_id"), F.lit(text).alias("text"))
    counts = tokens(query).groupBy("term").agg(F.count("*").alias("f"))
    return idf_.join(F.broadcast(counts.select("term", "f")), "term").select("term", ((F.lit(1.0) + F.log10("f")) * F.col("idf")).alias("qw"))  # a query's terms


def scores(postings: DataFrame, norms_: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, score): cosine of every document that shares a known term, also where it is 0; no rows if the query's
    norm is 0.  Norms are needed for the hits only."""
    hits = postings.join(query, "term").groupBy("doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"))
    length = query.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm")).where("qnorm > 0")
    return hits.join(norms_, "doc_id").where("norm > 0").crossJoin(F.broadcast(length)).select("doc_id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))  # one row


def _held(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Index:
    """Term frequencies, IDF, postings (with weights) and norms of a document table.  Frequencies and IDF are lazy plans
    until postings or norms, which read them more than once, are asked for, or the index is saved."""

    def __init__(self, docs: DataFrame, stopwords: DataFrame | None = None):
        self.docs = docs
        self.tf = term_frequencies(docs, stopwords)
        self.idf = idf(document_frequencies(self.tf), count_documents(docs))
        self._made: list[str] = []  # paths of intermediate tables
        self._norms: DataFrame | None = None  # a table, if the index is saved

    def _hold(self) -> None:
        """Texts are taken apart once: frequencies and IDF become tables in the shared folder."""
        if self._made or self._norms is not None:
            return
        spark = self.docs.sparkSession
        self._made = [fresh_path(spark, "tf"), fresh_path(spark, "idf")]
        self.tf = _held(self.tf, self._made[0])
        self.idf = _held(idf(document_frequencies(self.tf), count_documents(self.docs)), self._made[1])

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, f, weight)."""
        self._hold()
        return weights_of_all(self.tf, self.idf)

    @property
    def norms(self) -> DataFrame:
        """(doc_id, norm)."""
        return norms(self.postings) if self._norms is None else self._norms

    def save(self, path: str) -> Index:
        """Writes the index and reads from it.  Frequencies and IDF are sorted by term, so that a query's filter prunes
        files and row groups, and norms by document; a frequent term's rows are dealt over several files."""
        self._hold()
        spark, made = self.docs.sparkSession, [*self._made, fresh_path(self.docs.sparkSession, "norms")]
        for name, df, key in (("norms", _held(self.norms, made[-1]), ["doc_id"]), ("idf", self.idf, ["term"]), ("tf", self.tf, ["term", "doc_id"])):
            df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        self._read(path)
        for old in made:
            delete(spark, old)
        return self

    def _read(self, path: str) -> None:
        spark = self.docs.sparkSession
        self.tf, self.idf, self._norms = (spark.read.parquet(f"{path}/{name}") for name in ("tf", "idf", "norms"))
        self._made = []

    @classmethod
    def saved(cls, docs: DataFrame, path: str) -> Index:
        own = cls.__new__(cls)
        own.docs = docs
        own._read(path)
        return own

    def search(self, text: str, k: int | None = 10, order: str = "desc") -> DataFrame:
        """(doc_id, score): the k best (None: all); order desc, asc or norm (by absolute score); ties by doc_id.

        The query's terms, few, are literals of the plan, so that their filter reaches the scans."""
        spark = self.docs.sparkSession
        asked = [r.term for r in tokens(spark.range(1).select(F.lit(0).alias("doc_id"), F.lit(text).alias("text"))).select("term").distinct().collect()]
        own = F.col("term").isin(asked) if asked else F.lit(False)
        self._hold()
        known = self.idf.where(own)
        found = scores(weights(self.tf.where(own), F.broadcast(known)), self.norms, query_vector(spark, text, known))  # a query's terms
        by = {"desc": F.desc("score"), "asc": F.asc("score"), "norm": F.desc(F.abs("score"))}[order]
        found = found.orderBy(by, "doc_id")
        return found if k is None else found.limit(k)


def fallback(df: DataFrame, field: str, text: str, k: int | None, key: str) -> DataFrame:
    """Rows whose field holds every word of the query as a substring, ignoring case; score 1.0."""
    condition = F.lit(True)
    for word in text.lower().split():
        condition = condition & F.contains(F.lower(field), F.lit(word))
    out = df.where(condition).withColumn("score", F.lit(1.0)).orderBy(key)
    return out if k is None else out.limit(k)


def matching_rows(df: DataFrame, key: str, field: str, text: str, k: int | None, index: Index | None = None, rows: DataFrame | None = None, pos: str | None = None) -> DataFrame:
    """Rows with their score, the best first: ranked hits, or without any the substring fallback.

    Statistics are those of df, all rows, or of its saved index; `rows` (df without it) are those that other conditions
    leave, of which the k best come.  Of several rows with one id the last loaded stands for it: by `pos`, else by a hash."""
    rows = df if rows is None else rows
    fresh = index is None
    index = Index(documents(df, key, field)) if fresh else index
    found = index.search(text, None if rows is not df else k).select(F.col("doc_id").alias(key), "score")
    if fresh:  # written, since it is read more than once
        found = _held(found, fresh_path(df.sparkSession, "hits"))
    if found.isEmpty():
        return fallback(rows, field, text, k, key)
    if rows is not df and k is not None:  # the best by their ids alone, so that other rows' texts stay where they are
        found = found.join(rows.select(key), key, "left_semi").orderBy(F.desc("score"), key).limit(k)
    last = F.col(pos) if pos and pos in rows.columns else F.xxhash64(*rows.columns)
    hits = rows.join(found, key, "inner")
    one = hits.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(last.desc()))).where("_rn = 1").drop("_rn")
    out = one.select(*rows.columns, "score").orderBy(F.desc("score"), key)
    return out if k is None else out.limit(k)


def blocks(tf: DataFrame, n_blocks: int) -> DataFrame:
    """(block, term, postings): an inverted index built block by block of documents."""
    block = F.pmod(F.col("doc_id"), F.lit(n_blocks)).alias("block")
    return tf.groupBy(block, "term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "f"))).alias("postings"))


def merged_blocks(tf: DataFrame, n_blocks: int) -> DataFrame:
    """(term, df, total) after the blocks are merged: counts are added block by block, then over the blocks."""
    block = F.pmod(F.col("doc_id"), F.lit(n_blocks)).alias("block")
    parts = tf.groupBy(block, "term").agg(F.count("*").alias("df"), F.sum("f").alias("total"))
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
