"""Nearest vectors by random hyperplanes: tables of sign codes, several probes per query, exact cosine for what is met.

The exact search (``retrieval.dense``) looks at every pair; this one at the vectors that share a bucket with a query in some
table. Both ends are settled by parameters: more tables and probes find more of the true neighbours, more bits look at fewer vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assayer.operators.retrieval import TOP_K, top_k
from assayer.session import materialise

#: Vectors and queries of one bucket that meet in one task.
CELL = 4096


def hyperplanes(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, tables * bits))


def _flips(bits: int) -> np.ndarray:
    """Masks of up to two flipped bits, as rows of 0 and 1."""
    one = np.eye(bits, dtype=np.int64)
    two = [one[i] + one[j] for i in range(bits) for j in range(i)]
    return np.vstack([np.zeros((1, bits), np.int64), one, np.reshape(two, (-1, bits))])


def codes(unit: np.ndarray, tables: int, bits: int, probes: int, seed: int) -> np.ndarray:
    """Buckets (table and sign code in one number) of each row: its own and those of the ``probes`` cheapest flips in each table.

    A flip costs the sum of the distances to the planes that it crosses.
    """
    side = (unit @ hyperplanes(unit.shape[1], tables, bits, seed)).reshape(len(unit), tables, bits)
    weight = 1 << np.arange(bits, dtype=np.int64)
    own = ((side > 0) * weight).sum(2)
    flips = _flips(bits)
    if probes:
        cost = np.abs(side) @ flips.T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes + 1]
        own = own[:, :, None] ^ (flips @ weight)[best]
    else:
        own = own[:, :, None]
    return (own + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]).reshape(len(unit), -1)


def hashed(vectors: DataFrame, id_col: str, keys: list[str], tables: int, bits: int, probes: int = 0, seed: int = 0) -> DataFrame:
    """(keys, id, unit, buckets): unit vectors as bytes of doubles with their buckets. Null vectors are left out.

    For documents this is the index: written once, it answers any number of query batches made with the same tables, bits and seed.
    """
    fields = [(k, vectors.schema[k].dataType) for k in [*keys, id_col]]
    out = pa.schema([*[(k, to_arrow_type(t)) for k, t in fields], ("unit", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("vector").to_pylist(), float)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(size == 0, 1.0, size)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k, _ in fields], pa.array([x.tobytes() for x in v], pa.binary()),
                                              pa.array(list(codes(v, tables, bits, probes, seed)), pa.list_(pa.int64()))], schema=out)

    schema = ", ".join([*[f"`{k}` {t.simpleString()}" for k, t in fields], "unit binary", "buckets array<long>"])
    return vectors.filter(F.col("vector").isNotNull()).select(*[k for k, _ in fields], "vector").mapInArrow(run, schema)


def _met(k: int, layer: pa.DataType):
    """Exact cosine of the vectors and queries of one cell of a bucket; ``k`` vectors a query go on."""
    out = pa.schema([("layer", layer), ("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return out.empty_table()
        d, q = (np.frombuffer(b"".join(t.column("unit").to_pylist())).reshape(t.num_rows, -1) for t in (docs, asked))
        doc, query = docs.column("doc_id").to_numpy(), asked.column("query_id").to_numpy()
        found: list[list[np.ndarray]] = [[], [], []]
        for i in range(0, len(q), 512):
            sims = np.round(d @ q[i:i + 512].T, 9)
            least = -np.partition(-sims, k - 1, axis=0)[k - 1] if len(doc) > k else np.full(sims.shape[1], -np.inf)
            row, column = np.nonzero(sims >= least)
            order = np.lexsort((doc[row], -sims[row, column], column))
            row, column = row[order], column[order]
            keep = np.arange(len(column)) - np.searchsorted(column, np.arange(sims.shape[1]))[column] < k
            for x, y in zip(found, (query[i:i + 512][column[keep]], doc[row[keep]], sims[row[keep], column[keep]])):
                x.append(y)
        query, doc, score = map(np.concatenate, found)
        name = docs.column("layer")[0]
        return pa.table([pa.array([name.as_py()] * len(doc), layer), query, doc, score], schema=out)
    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = TOP_K, tables: int = 24, bits: int = 8, probes: int = 8, seed: int = 0) -> DataFrame:
    """The ``k`` nearest documents met per layer and query, as ``retrieval.dense`` gives them: (layer, query_id, doc_id, score, rank).

    ``index`` is ``hashed(vectors, "doc_id", ["layer"], tables, bits, seed=seed)``. Every score is an exact cosine; a true neighbour is
    missed only if it shares no probed bucket with the query. Buckets of any size are cut into cells of about ``CELL`` vectors by
    ``CELL`` queries, so a bucket that holds a third of all vectors is many tasks, and each hands on ``k`` rows a query. Only vectors of
    probed buckets are shuffled. About log2(vectors / 1000) bits keep the buckets small.
    """
    asked = materialise(hashed(queries, "query_id", [], tables, bits, probes, seed).select(
        "query_id", "unit", F.explode("buckets").alias("bucket")), "lsh-queries")
    wanted = asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_queries"))
    hit = index.select("layer", F.explode("buckets").alias("bucket")).groupBy("layer", "bucket").agg(F.count(F.lit(1)).alias("n_docs"))
    cells = materialise(hit.join(wanted, "bucket").select(
        "layer", "bucket", F.ceil(F.col("n_docs") / CELL).alias("parts"), F.ceil(F.col("n_queries") / CELL).alias("q_parts")), "lsh-cells")

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    docs = (index.select("layer", "doc_id", "unit", F.explode("buckets").alias("bucket")).join(cells, ["layer", "bucket"])
            .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).withColumn("q_part", spread("q_parts")))
    asked = (asked.join(cells, "bucket").withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("q_parts")))
             .withColumn("part", spread("parts")))
    by = ["layer", "bucket", "part", "q_part"]
    layer = index.schema["layer"].dataType
    found = (docs.select(*by, "doc_id", "unit").groupBy(*by).cogroup(asked.select(*by, "query_id", "unit").groupBy(*by))
             .applyInArrow(_met(k, to_arrow_type(layer)), f"layer {layer.simpleString()}, query_id long, doc_id long, score double"))
    once = found.groupBy("layer", "query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k(once, ["layer", "query_id"], "score", "doc_id", k, positive=False)


def dense_approx(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, tables: int = 24, bits: int = 8, probes: int = 8, seed: int = 0) -> DataFrame:
    """``nearest`` over vectors that are hashed, and written, for this call alone."""
    index = materialise(hashed(vectors, "doc_id", ["layer"], tables, bits, seed=seed), "lsh-index")
    return nearest(index, queries, k, tables, bits, probes, seed)
