"""Exact cosine search in blocks, and asset search by id and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, BASE_BLOCK = 1024, 4096
#: Queries up to this size go to every executor; larger sets meet the rows through a join.
BROADCAST_BYTES = 64 << 20
SALTS = 64


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in doubles; null for a zero vector."""
    mul = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(mul(a, b), F.sqrt(mul(a, a)) * F.sqrt(mul(b, b)))


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows packed into hash blocks of about ``size`` (block number, array of (key, vector)), and the number of blocks."""
    df = df.where(F.col(vector).isNotNull())
    n = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{name}_block")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(vector).alias("vector")))).alias(name)), n


def top_k(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, key, similarity, rank_no): the k most similar rows of ``base`` for each query, ties by key.

    A stated query set against all rows. Its size is counted first: up to
    ``broadcast_bytes`` the queries are sent to every executor, and each task
    runs over its rows in place and keeps the k best of each query, so only k
    rows a query and task are shuffled. Beyond that both sides are packed into
    blocks that meet through a join on the query block, salted so that no task
    gets all rows. Similarities are matrix products; all of them are never kept.
    Null vectors take no part, zero vectors have similarity 0.
    """
    ddl = f"query_id {dict(queries.dtypes)[key]}, `{key}` {dict(base.dtypes)[key]}, similarity double"
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        sent = base.sparkSession.sparkContext.broadcast(_unit_rows(asked.collect()))
        rows = base.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        out = rows.mapInPandas(lambda it: _scan(it, sent, key, k), ddl)
    else:
        blocks, n = _blocks(queries, key, vector, QUERY_BLOCK, "q")
        rows, _ = _blocks(base, key, vector, BASE_BLOCK, "b")
        rows = rows.select("b", F.pmod("b_block", F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("q_block"))
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = rows.join(blocks, ["q_block", "salt"]).select("q", "b").mapInPandas(lambda it: _search(it, key, k), ddl)
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), key)
    return out.withColumn("rank_no", F.row_number().over(w).cast("long")).where(F.col("rank_no") <= k)


def _unit_rows(items) -> tuple[np.ndarray, np.ndarray]:
    names = np.array([x["key"] for x in items])
    m = np.array([x["vector"] for x in items], dtype=np.float64)
    if not len(names):
        return names, m.reshape(0, 0)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return names, np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best(q: np.ndarray, names: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, name, similarity) of the k best of each query among flat candidates, ties by name."""
    order = np.lexsort((names, -np.round(sim, 9), q))
    q, names, sim = q[order], names[order], sim[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return q[place < k], names[place < k], sim[place < k]


def _candidates(q: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of all pairs that reach the k-th similarity of their query, ties included."""
    sim = q @ b.T
    near = np.round(sim, 9)
    least = -np.partition(-near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
    at, row = np.nonzero(near >= least[:, None])
    return at, row, sim[at, row]


def _scan(batches: Iterator[pd.DataFrame], sent, key: str, k: int) -> Iterator[pd.DataFrame]:
    ids, q = sent.value
    best = None
    for batch in batches:
        names, b = _unit_rows(batch.to_dict("records"))
        for lo in range(0, len(ids) if len(names) else 0, QUERY_BLOCK):
            at, row, sim = _candidates(q[lo : lo + QUERY_BLOCK], b, k)
            new = (at + lo, names[row], sim)
            best = _best(*(np.concatenate(c) for c in zip(best, new)), k) if best is not None else _best(*new, k)
    if best is not None:
        yield pd.DataFrame({"query_id": ids[best[0]], key: best[1], "similarity": best[2]})


def _search(batches: Iterator[pd.DataFrame], key: str, k: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for asked, rows in zip(batch["q"], batch["b"]):
            ids, q = _unit_rows(asked)
            names, b = _unit_rows(rows)
            at, row, sim = _candidates(q, b, k)
            at, name, sim = _best(at, names[row], sim, k)
            yield pd.DataFrame({"query_id": ids[at], key: name, "similarity": sim})


def search_assets(assets: DataFrame, keyword: str, vector: list[float], k: int, key: str = "asset_id", column: str = "embedding") -> DataFrame:
    """(asset, similarity, by_id) of the best k: an exact id first, then by cosine; each asset once."""
    q = F.array(*[F.lit(float(v)) for v in vector])
    hit = F.col(key).cast("string") == keyword
    s = assets.select("*", cosine(F.col(column), q).alias("similarity"), hit.alias("by_id"))
    return s.where(F.col("similarity").isNotNull() | F.col("by_id")).orderBy(F.desc("by_id"), F.desc("similarity"), key).limit(k)


def asset_by_id(assets: DataFrame, value: str, key: str = "asset_id") -> DataFrame:
    return assets.where(F.col(key).cast("string") == value)
