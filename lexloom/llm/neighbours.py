"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all its leaves, exact reranking.

Fit: the trees' hyperplanes (random directions, split at the median) come from a bounded sample of vectors; they are small
and go to every task. Index: every row is routed to its leaf in each tree. Search: a query's leaves in all trees stand in
one queue, ordered by how far the query lies on the wrong side of the splits on the way there (sum of squared margins);
leaves are taken from its head until they hold the wanted number of candidates. Leaf candidates are reranked exactly, in
double precision.

For inner products, vectors are routed with one more coordinate, sqrt(M^2 - |x|^2) (M: the largest norm; 0 for queries),
which makes the largest inner product the nearest point.

Scale: leaves are packed into buckets of at most `bucket_rows` rows; a leaf with more (say, many equal vectors) is spread
over several buckets by a hash of the id. A query is sent once to each bucket that it visits, and each bucket answers
with at most k rows per query. Nothing is broadcast but the hyperplanes and the leaf counts, both bounded by the sample.

The share of rows to look at is a parameter, since what a recall costs depends on the data: vectors without structure (as
random ones of 64 dimensions) need most of the rows, clustered ones a small part.

Defined results: null vectors, zero vectors and those with null or non-finite components take no part, nor do vectors
whose length isn't the most common one (no inner product with the others is defined), nor rows whose id is null or isn't
a whole number (ids are cast to long); repeated ids are returned once per query, by their best row, and take one place; a
query's own row (id) is never returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import lean, materialise

#: SHARE counts the rows of the leaves taken, a row once for each tree.
K, TREES, SHARE, LEAST = 20, 2, 1.25, 2_000
SAMPLE, LEAF_ROWS, BUCKET_ROWS = 16_384, 256, 8_192


@dataclass
class Forest:
    """Complete binary trees of one depth; node n of a tree has the children 2n and 2n + 1."""

    depth: int
    planes: list[np.ndarray]  # per tree: 2**depth x (dim + 1)
    cuts: list[np.ndarray]
    top: float  # the largest norm

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf's number over the whole forest. x: rows, augmented."""
        out = np.empty((len(x), len(self.planes)), dtype=np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + (np.einsum("ij,ij->i", x, planes[node]) >= cuts[node])
            out[:, t] = node - (1 << self.depth) + (t << self.depth)
        return out

    def penalties(self, q: np.ndarray) -> np.ndarray:
        """queries x leaves of the forest: the queue's keys, smallest first."""
        found = []
        for planes, cuts in zip(self.planes, self.cuts, strict=True):
            margin = q @ planes.T - cuts
            cost = np.zeros((len(q), 1))
            for d in range(self.depth):
                m = margin[:, 1 << d : 2 << d]
                cost = np.stack([cost + np.maximum(m, 0) ** 2, cost + np.maximum(-m, 0) ** 2], axis=2).reshape(len(q), -1)
            found.append(cost)
        return np.concatenate(found, axis=1)


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(1)))])


def fit_forest(sample: np.ndarray, n_rows: int, top: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> Forest:
    """sample: rows x dim. Depth follows the row count, as far as the sample can cut medians (8 sample rows to a leaf)."""
    x = augmented(sample, top)
    depth = int(max(0, min(np.ceil(np.log2(max(1.0, n_rows / leaf_rows))), np.floor(np.log2(max(1.0, len(x) / 8))))))
    rng = np.random.default_rng(seed)
    planes, cuts = [], []
    for _ in range(trees):
        h = rng.normal(size=(1 << depth, x.shape[1]))
        h /= np.linalg.norm(h, axis=1, keepdims=True)
        c = np.zeros(1 << depth)
        node = np.ones(len(x), dtype=np.int64)
        for d in range(depth):
            p = np.einsum("ij,ij->i", x, h[node])
            for k in range(1 << d, 2 << d):
                mine = p[node == k]
                c[k] = np.median(mine) if len(mine) else 0.0
            node = 2 * node + (p >= c[node])
        planes.append(h)
        cuts.append(c)
    return Forest(depth, planes, cuts, top)


def usable_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id (long), v (binary, float64 or float32 as given), dim, norm2: rows that can take part, whatever their length."""
    single = "float" in table.schema[vector].dataType.simpleString()
    kind = np.float32 if single else np.float64
    rows = table.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("e")).where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.exists("e", lambda x: x.isNull()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            kept, vectors, norms = [], [], []
            for i, (end, size) in enumerate(zip(ends, sizes, strict=True)):
                x = flat[end - size : end].astype(np.float64)
                norm = float((x * x).sum())
                if size and norm > 0 and np.isfinite(x).all():
                    kept.append(i)
                    vectors.append(flat[end - size : end].astype(kind).tobytes())
                    norms.append(norm)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(vectors, pa.binary()), pa.array(sizes[kept].astype(np.int32)), pa.array(norms, pa.float64())], names=["id", "v", "dim", "norm2"])

    return rows.mapInArrow(lean(run), "id bigint, v binary, dim int, norm2 double"), kind


def _matrix(column, kind) -> np.ndarray:
    data = b"".join(x.as_py() for x in column)
    return np.frombuffer(data, kind).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def best_of(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k largest inner products over the rows, ties to smaller ids, its own id left out."""
    rough = q @ x.T
    rough[queries[:, None] == ids] = -np.inf
    best = rough
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    if len(starts) < len(ids):  # rows of one id take one of the k places
        best = np.maximum.reduceat(rough[:, order], starts, axis=1)
    n = best.shape[1]
    floor = np.partition(best, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))  # a matrix product may round equal rows differently
    a, b = np.nonzero((rough >= (floor - slack)[:, None]) & np.isfinite(rough))
    score = np.empty(len(a))
    for at in range(0, len(a), 1 << 15):
        s = slice(at, at + (1 << 15))
        score[s] = (x[b[s]] * q[a[s]]).sum(axis=1)
    return top_k(a, ids[b], score, k)


def top_k(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per value of a: the k best (score, then smaller id), each id once."""
    order = np.lexsort((ids, -score, a))
    a, ids, score = a[order], ids[order], score[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (ids[1:] != ids[:-1])
    a, ids, score = a[new], ids[new], score[new]
    place = np.arange(len(a)) - np.searchsorted(a, a, side="left")
    keep = place < k
    return a[keep], ids[keep], score[keep]


def nearest(table: DataFrame, every: int = 20, k: int = K, trees: int = TREES, share: float = SHARE, least: int = LEAST, vec_id: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE, leaf_rows: int = LEAF_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Queries: rows whose id is divisible by `every`. Returns query_id, rank (int, from 1), vec_id, score."""
    spark = table.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    vectors, kind = usable_vectors(table, vec_id, vector)
    vectors = materialise(vectors.dropDuplicates(["id", "v"]), "vectors")  # a repeated row counts once in leaves and budgets
    dims = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    dim, n_rows, top = dims[0]["dim"], dims[0]["n"], float(np.sqrt(dims[0]["norm2"]))
    vectors = vectors.where(F.col("dim") == dim).select("id", "v")
    # About sample_rows rows by a hash of the id: bounded whatever the table's size.
    part = int(min(1.0, sample_rows / n_rows) * (1 << 30))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < part).orderBy("id").limit(2 * sample_rows).collect()
    forest = fit_forest(np.array([np.frombuffer(r["v"], kind).astype(np.float64) for r in drawn]).reshape(-1, dim), n_rows, top, trees, leaf_rows)
    n_leaves = len(forest.planes) << forest.depth

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            leaves = forest.leaves(augmented(_matrix(batch.column(1), kind), top)) if batch.num_rows else np.zeros((0, trees), dtype=np.int64)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves[:, t].astype(np.int32))], names=["id", "v", "leaf"])

    routed = materialise(vectors.mapInArrow(route, "id bigint, v binary, leaf int"), "leaves")
    counts = np.zeros(n_leaves, dtype=np.int64)
    for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per leaf
        counts[r["leaf"]] = r["n"]
    # Buckets: small leaves share one, a large leaf has several.
    first, parts, bucket, held = np.zeros(n_leaves, dtype=np.int64), np.ones(n_leaves, dtype=np.int64), 0, 0
    for leaf, n in enumerate(counts):
        if held and held + n > bucket_rows:
            bucket, held = bucket + 1, 0
        first[leaf] = bucket
        if n > bucket_rows:
            parts[leaf] = -(-int(n) // bucket_rows)
            bucket += int(parts[leaf])
            held = 0
        else:
            held += int(n)
    n_buckets = bucket + 1
    budget = max(least, share * n_rows)

    def deal_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[leaf]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array((first[leaf] + spread).astype(np.int32)), pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32)), pa.nulls(n, pa.list_(pa.int32()))], names=["bucket", "kind", "id", "v", "leaf", "visits"])

    def deal_queries(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column(1), kind)
                cost = forest.penalties(np.column_stack([q, np.zeros(len(q))]))
                order = np.argsort(cost, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                rows, buckets, visits = [], [], []
                for i in range(len(q)):
                    taken = order[i][(before[i] < budget) & (counts[order[i]] > 0)]
                    per = np.repeat(taken, parts[taken])
                    place = first[per] + np.arange(len(per)) - np.repeat(np.cumsum(parts[taken]) - parts[taken], parts[taken])
                    by = np.argsort(place, kind="stable")
                    place, per = place[by], per[by]
                    cuts = np.append(0, np.flatnonzero(np.diff(place)) + 1)
                    for a, b in zip(cuts, np.append(cuts[1:], len(place)), strict=True):
                        rows.append(i)
                        buckets.append(int(place[a]))
                        visits.append(np.unique(per[a:b]).astype(np.int32))
                take = pa.array(rows, pa.int64())
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.ones(n, np.int32)), part.column(0).take(take), part.column(1).take(take), pa.nulls(n, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["bucket", "kind", "id", "v", "leaf", "visits"])

    schema = "bucket int, kind int, id bigint, v binary, leaf int, visits array<int>"
    both = routed.mapInArrow(deal_rows, schema).unionByName(vectors.where(F.pmod("id", F.lit(every)) == 0).mapInArrow(deal_queries, schema))
    dealt = both.repartition(max(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket", "kind", "leaf")

    def rerank(batches: Iterator) -> Iterator:
        """Rows of a bucket come before the queries that visit it."""
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        now, ids, xs, leaf, loaded = None, [], [], [], None
        for batch in batches:
            start = 0
            keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy() if batch.num_rows else np.zeros(0, dtype=np.int64)
            cuts = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)) if len(keys) else []
            for end in cuts:
                part = batch.slice(start, end - start)
                start = int(end)
                number, queries = divmod(int(keys[end - 1]), 2)
                if number != now:
                    now, ids, xs, leaf, loaded = number, [], [], [], None
                if not queries:
                    ids.append(part.column(2).to_numpy())
                    xs.append(_matrix(part.column(3), kind))
                    leaf.append(part.column(4).to_numpy())
                    continue
                if not ids:
                    continue
                if loaded is None:
                    all_ids, x, leaves = np.concatenate(ids), np.concatenate(xs), np.concatenate(leaf)
                    edges = np.append(0, np.flatnonzero(np.diff(leaves)) + 1)
                    loaded = [(int(leaves[a]), all_ids[a:b], x[a:b]) for a, b in zip(edges, np.append(edges[1:], len(leaves)), strict=True)]
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    qid, q = some.column(2).to_numpy(), _matrix(some.column(3), kind)
                    visits = some.column(5)
                    owner = np.repeat(np.arange(len(qid)), np.diff(visits.offsets.to_numpy()))
                    wanted = visits.flatten().to_numpy()
                    found = []
                    for number_, own_ids, own_x in loaded:
                        mine = owner[wanted == number_]
                        if len(mine):
                            a, b, s = best_of(own_ids, own_x, qid[mine], q[mine], k)
                            found.append((mine[a], b, s))
                    if found:
                        a, b, s = top_k(*[np.concatenate(c) for c in zip(*found, strict=True)], k)
                        yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(b), pa.array(s)], names=names)

    answers = dealt.mapInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    once = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id's rows may lie in several buckets
    ranked = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
