"""Ranking of documents for a batch of queries: BM25, cosine, rank fusion.

``corpus`` rows are ``doc_id, layer, text``; each layer is an index of its own
and all layers are answered in one job. ``queries`` rows are ``query_id, text``
(and ``vector`` for the dense side).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assayer.functions import text as X
from assayer.session import materialise, tasks

# ---- fixed values -----------------------------------------------------------------
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP_K, RRF_K = 5, 60
EVERY = "\u0001"  # the mark in a term index, never a token
TASK_TOKENS = 400_000  # tokens of all texts whose postings and scores one task holds
# ---- end of fixed values ------------------------------------------------------------


def top_k(df: DataFrame, keys: list[str], score: str, tie: str, k: int, positive: bool = True) -> DataFrame:
    """First ``k`` rows per key by falling score; ties by ``tie``; then scores of 0 or less go.

    ``row_number <= k`` is cut to k rows per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    best = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.filter(F.col(score) > 0) if positive else best


def tokenised(corpus: DataFrame) -> DataFrame:
    return corpus.select("layer", "doc_id", X.tokens(F.col("text")).alias("tokens"))


def term_index(tokens: DataFrame) -> DataFrame:
    """Document frequency of every term per layer, written once as a table.

    Every document also counts for one mark that is no term: its row holds the
    number of documents and their total length, so one pass over the texts
    gives all statistics.
    """
    marked = tokens.select("layer", F.size("tokens").alias("len"), F.explode_outer(
        F.concat(F.array_distinct("tokens"), F.array(F.lit(EVERY)))).alias("term"))
    counts = marked.groupBy("layer", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == EVERY, F.col("len")).otherwise(0)).alias("total_len"))
    return materialise(counts, "term-index")


def lengths(index: DataFrame) -> DataFrame:
    """Documents and mean length per layer."""
    return index.filter(F.col("term") == EVERY).select(
        "layer", F.col("df").alias("n_docs"), (F.col("total_len") / F.col("df")).alias("avg_len"))


def term_statistics(index: DataFrame) -> DataFrame:
    """Document frequency and idf of every term; a negative idf becomes a quarter of the layer's mean idf."""
    raw = index.filter(F.col("term") != EVERY).join(F.broadcast(lengths(index)), "layer").withColumn(  # one row per layer
        "raw_idf", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.groupBy("layer").agg(F.avg("raw_idf").alias("mean_idf"))
    return raw.join(F.broadcast(mean), "layer").select("layer", "term", "df", "n_docs", "avg_len", F.when(
        F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))


def postings(corpus: DataFrame, n_tokens: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """``layer, doc_id, doc_len, term, tf``; with a vocabulary only its terms are counted.

    ``n_tokens`` is the number of tokens of all texts, or near it: it sets the number of tasks.

    ``explode_outer`` keeps the optimiser from testing the size of the token
    list before the explode, which would cut every text into tokens twice. Texts
    are placed by document: the term counts here and any later sums per document
    and query then need no shuffle of their own, and no row of a token is sent.
    """
    tokens = tokenised(corpus.repartition(tasks(corpus.sparkSession, n_tokens, TASK_TOKENS), "doc_id"))
    long = tokens.select("layer", "doc_id", F.size("tokens").alias("doc_len"), F.explode_outer("tokens").alias("term"))
    long = long.filter(F.col("term").isNotNull()) if vocabulary is None else long.join(vocabulary, "term", "left_semi")
    return long.groupBy("layer", "doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` as a table (the batch of queries is read by several joins)."""
    asked = (queries.select("query_id", F.explode_outer(X.tokens(F.col("text"))).alias("term"))
             .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    return materialise(asked.filter(F.col("term").isNotNull()), "query-terms")


def bm25_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Okapi score of every document that shares a term with a query; repeated query terms count again.

    Query terms carry their idf and the layer's mean length, so the postings are
    joined once. Terms and weighted terms are written tables, so the optimiser knows
    their size and broadcasts them only below its own limit.
    """
    asked = query_terms(queries)
    vocabulary = asked.select("term").distinct()
    index = term_index(tokenised(corpus))
    n_tokens = index.agg(F.sum("total_len")).first()[0]
    stats = term_statistics(index).join(vocabulary, "term", "left_semi")
    weights = materialise(stats.join(asked, "term").select(
        "layer", "term", "query_id", (F.col("qtf") * F.col("idf")).alias("weight"), "avg_len"), "query-weights")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    hits = postings(corpus, n_tokens, vocabulary).join(weights, ["layer", "term"])
    return (hits.groupBy("layer", "query_id", "doc_id")
            .agg(F.round(F.sum(F.col("weight") * tf), 9).alias("score")))


def bm25(corpus: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_k(bm25_scores(corpus, queries), ["layer", "query_id"], "score", "doc_id", k)


BLOCK_BYTES = 2 << 20


def _blocks(rows: DataFrame, id_column: str, key: str | None = None) -> DataFrame:
    """``key, ids, matrix``: unit vectors packed to rows of about two megabytes, a scan without a shuffle."""
    fields = [(key, rows.schema[key].dataType)] if key else []
    schema = pa.schema([*[(k, to_arrow_type(t)) for k, t in fields], ("ids", pa.list_(pa.int64())), ("matrix", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(batch.num_rows, -1)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(size == 0, 1.0, size)
            ids, step = batch.column(id_column).to_numpy(), max(1, BLOCK_BYTES // (8 * v.shape[1]))
            names = batch.column(key).dictionary_encode("encode") if key else None
            codes = names.indices.to_numpy() if key else np.zeros(batch.num_rows, np.int64)
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                for i in range(0, len(own), step):
                    at = own[i:i + step]
                    head = [pa.array([names.dictionary[int(code)].as_py()], schema.field(0).type)] if key else []
                    yield pa.RecordBatch.from_arrays([*head, pa.array([ids[at]], pa.list_(pa.int64())), pa.array([v[at].tobytes()], pa.binary())],
                                                     schema=schema)
    out = ", ".join([*[f"`{k}` {t.simpleString()}" for k, t in fields], "ids array<long>", "matrix binary"])
    return rows.filter(F.col("vector").isNotNull()).select(*[k for k, _ in fields], id_column, "vector").mapInArrow(pack, out)


def dense(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` nearest documents by cosine, exact, per layer and query, for any number of queries.

    Both sides are packed into blocks of bounded bytes; every block of documents meets every block of queries (that is what
    exact search is), and a pair of blocks is one matrix product that keeps k rows per query. So what is shuffled is
    document blocks x queries x k, never all pairs, and no query vector passes through the driver.
    """
    docs = _blocks(vectors, "doc_id", "layer")
    # written once: its size is known to the planner, and no document partition packs the queries anew
    asked = materialise(_blocks(queries, "query_id").select(F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix")), "query-blocks")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for layer, ids, matrix, query_ids, query_matrix in batch.itertuples(index=False):
                d = np.frombuffer(matrix).reshape(len(ids), -1)
                q = np.frombuffer(query_matrix).reshape(len(query_ids), -1)
                sims = np.round(d @ q.T, 9)
                # the k-th best of each query, then everything that reaches it, ties by document
                least = -np.partition(-sims, k - 1, axis=0)[k - 1] if len(ids) > k else np.full(len(query_ids), -np.inf)
                row, column = np.nonzero(sims >= least)
                score, doc = sims[row, column], np.asarray(ids)[row]
                order = np.lexsort((doc, -score, column))
                column, score, doc = column[order], score[order], doc[order]
                first = np.searchsorted(column, np.arange(len(query_ids)))
                keep = np.arange(len(column)) - first[column] < k
                yield pd.DataFrame({"layer": layer, "query_id": np.asarray(query_ids)[column[keep]], "doc_id": doc[keep], "score": score[keep]})
    pairs = docs.crossJoin(asked).select("layer", "ids", "matrix", "query_ids", "query_matrix")
    layer = vectors.schema["layer"].dataType.simpleString()
    found = pairs.mapInPandas(nearest, f"layer {layer}, query_id long, doc_id long, score double")
    return top_k(found, ["layer", "query_id"], "score", "doc_id", k, positive=False)


def fuse(lists: list[DataFrame], keys: list[str], k: int = TOP_K, constant: int = RRF_K) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists; equal sums keep the order of first appearance."""
    every = None
    for number, ranked in enumerate(lists):
        part = ranked.select(*keys, "doc_id", F.struct(F.lit(number).alias("list"), F.col("rank").alias("rank")).alias("seen"),
                             (1.0 / (constant + F.col("rank"))).alias("gain"))
        every = part if every is None else every.unionByName(part)
    s = every.groupBy(*keys, "doc_id").agg(F.round(F.sum("gain"), 12).alias("score"), F.min("seen").alias("first_seen"))
    return top_k(s, keys, "score", "first_seen", k).drop("first_seen")


def hybrid(corpus: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Both retrievers in every layer, fused per layer and query."""
    return fuse([bm25(corpus, queries, k), dense(vectors, queries, k)], ["layer", "query_id"], k)
