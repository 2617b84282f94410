"""Centroid clustering over integers, with bounds that loosen by geometry.

A vector is kept if it has exactly ``dims`` components, none null or non-finite; a component x
becomes floor(1024 * x). Lloyd's rounds follow: nearest centroid (squared Euclidean distance, the
smaller number among equals), then each centroid that has vectors becomes their exact mean, floored.

A vector carries its cluster and a lower bound of its distance to all other centroids. After
centroids have moved, the bound of a cluster's vectors is loosened by what geometry allows, not by
the largest drift: all vectors of cluster i lie in a sphere around its old centroid whose radius is
the largest distance found. For a centroid that moved from a to b, seen from the middle m between
both, a point p comes nearer by |p - a| - |p - b| <= |b - a| * cos(angle of p - m and b - a), since
|p - a| + |p - b| >= 2 |p - m|. In the plane of a, b and the sphere's centre the least angle of a
point of the sphere is that of the centre less asin(radius / distance from m), so the bound loosens
by |b - a| * cos of it, nothing where that angle is a right one or more. A vector that is nearer to
its own centroid (an exact distance) than its bound keeps its cluster; the others are scanned exactly.
Bounds are floating-point numbers with a margin and only ever save scans: distances, ties, sums and
means are exact integers.

Each round is one pass without a shuffle. It writes vectors and bounds as compressed Parquet to the
shared folder, with the sums of each Arrow batch in a column of its own, from which Spark adds up
the numbers of ``k`` clusters; only these reach the driver. The table of the round before is then removed. When no
centroid moves, further rounds change nothing and are left out.

Defined cases: an empty table, or one without kept vectors, gives no rows; with fewer vectors than
``k`` there are as many centroids; repeated rows and repeated ids are vectors of their own (equal
hashes are ordered by components); a null id hashes last. Components beyond ``LARGEST`` in magnitude
(x of 131072), whose squared distances a long could not hold, are an error. ``k * dims`` is at most
``MOST_NUMBERS``. Further columns are returned if ``keep`` names them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, stored_at, table, tidied

SCALE, DIMS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Largest component, and the most components of all centroids together (they travel with the code).
LARGEST, MOST_NUMBERS = 1 << 27, 1 << 22
#: Components up to this size have exact distances in double precision (64 products below 2**53).
_EXACT = 1 << 22
#: Of a batch's vectors in a cluster: the largest distance, and numbers that add up (how many, distance above
#: and below 20 bits, how many were scanned, each component).
_PART = T.ArrayType(T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("far", T.LongType()), T.StructField("numbers", T.ArrayType(T.LongType()))]))


def integer_vectors(df: DataFrame, dims: int = DIMS, vec_col: str = "embedding", name: str = "v") -> DataFrame:
    """The rows of ``df`` with a usable vector, and a column ``name`` of its integers (it replaces ``vec_col``)."""
    v, big = F.col(vec_col), free_name(df, "big")
    usable = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    rows = df.where(F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn(big, F.exists(v, lambda x: F.abs(x.cast("double")) * SCALE > LARGEST))
    checked = F.when(F.col(big), F.raise_error(F.lit(f"a component lies beyond {LARGEST // SCALE}")).cast("array<bigint>")).otherwise(scaled)
    return rows.withColumn(name, checked.cast("array<int>")).drop(big, *([] if name == vec_col else [vec_col]))


def first_centroids(vectors: DataFrame, k: int, seed: int, id_col: str, vec_col: str) -> list[list[int]]:
    """The ``k`` vectors whose hash of seed and id is least, in order of the hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return [list(r[0]) for r in vectors.select(F.col(vec_col), key.alias("h")).orderBy(F.asc_nulls_last("h"), vec_col).limit(k).collect()]


def loosening(old, new, radius):
    """What each cluster's lower bound loses when centroids move from ``old`` to ``new``.

    ``radius``: the largest distance of a vector of each cluster from its old centroid.
    """
    import numpy as np

    old, new = np.asarray(old, float), np.asarray(new, float)
    drift, middle = np.linalg.norm(new - old, axis=1), (old + new) / 2
    out = np.zeros(len(old))
    for i, r in enumerate(radius):
        to = old[i] - middle
        away = np.linalg.norm(to, axis=1)
        moved = (drift > 0) & (np.arange(len(old)) != i)
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((to * (new - old)).sum(1) / (away * drift), -1, 1))
            least = np.maximum(0, angle - np.arcsin(np.minimum(1, r / away)))
            lost = np.where(away <= r, drift, drift * np.maximum(0, np.cos(least)))
        out[i] = max(lost[moved], default=0.0) * (1 + 1e-9) + 1e-9
    return out


def _distances(v, centroids):
    """Exact squared distances, a row for each vector."""
    import numpy as np

    c = np.asarray(centroids, np.int64)
    if not len(v) or max(np.abs(v).max(), np.abs(c).max()) <= _EXACT and v.shape[1] <= 64:
        x, y = v.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


def assigned(v, cluster, lower, centroids, lost):
    """Cluster, squared distance and lower bound of each vector, and which were scanned.

    ``cluster`` and ``lower`` are those of the round before (-1 where there is none), ``lost`` what
    each cluster's bound loses.
    """
    import numpy as np

    cluster, lower = cluster.astype(np.int64), lower - np.where(cluster >= 0, lost[cluster], 0)
    c = np.asarray(centroids, np.int64)
    distance = ((v - c[cluster]) ** 2).sum(1)
    open_ = np.flatnonzero((cluster < 0) | (np.sqrt(distance) * (1 + 1e-9) + 1e-9 >= lower))
    every = _distances(v[open_], c)
    best = every.argmin(1) if len(open_) else np.zeros(0, np.int64)
    cluster[open_], distance[open_] = best, every[np.arange(len(open_)), best]
    if len(c) > 1:
        every[np.arange(len(open_)), best] = np.iinfo(np.int64).max
        lower[open_] = np.sqrt(every.min(1)) * (1 - 1e-9) if len(open_) else 0
    else:
        lower[open_] = np.inf
    return cluster, distance, lower, open_


def _pass(rows: DataFrame, columns: list[str], centroids, lost, last: bool) -> DataFrame:
    """One round over ``rows`` (columns k0, k1, ... and v, cluster, lower)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    dims, part_type = len(centroids[0]), to_arrow_type(_PART)
    kept = [*columns, *([] if last else ["v"])]
    out = T.StructType([*(rows.schema[c] for c in kept), T.StructField("cluster", T.IntegerType()), T.StructField("lower", T.DoubleType()), T.StructField("distance", T.LongType()), T.StructField("part", _PART)])

    def run(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            had = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, distance, lower, scanned = assigned(v, had, batch.column("lower").to_numpy(zero_copy_only=False).astype(float), centroids, np.asarray(lost))
            part = []
            for i in np.unique(cluster).tolist():
                own = cluster == i
                d = distance[own]
                part.append({"cluster": i, "far": int(d.max()), "numbers": [len(d), int((d >> 20).sum()), int((d & 0xFFFFF).sum()), int(own[scanned].sum()), *v[own].sum(0).tolist()]})
            parts = pa.array([part, *[None] * (batch.num_rows - 1)], part_type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cluster, pa.int32()), pa.array(lower), pa.array(distance), parts], names=[*kept, "cluster", "lower", "distance", "part"])

    return rows.mapInArrow(lambda batches: tidied(run(batches)), out)


def _summed(rows: DataFrame) -> dict[int, dict]:
    """For each cluster: n, far, inertia, scanned, sums; the driver gets a row for each number of a cluster."""
    p = rows.where("part is not null").select(F.explode("part").alias("p")).select("p.cluster", "p.far", F.posexplode("p.numbers"))
    got = p.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("x"), F.max("far").alias("far")).collect()
    out: dict[int, dict] = {}
    for i in {r["cluster"] for r in got}:
        own = sorted((r for r in got if r["cluster"] == i), key=lambda r: r["pos"])
        n, high, low, scanned, *sums = (int(r["x"]) for r in own)
        out[i] = {"n": n, "far": own[0]["far"], "inertia": (high << 20) + low, "scanned": scanned, "sums": sums}
    return out


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None, trace: list | None = None) -> DataFrame:
    """The kept vectors' columns ``keep`` (default: the id) with cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``trace`` gets a dict for each pass: vectors, those scanned, the largest drift and the largest loosening.
    """
    import numpy as np

    if k * dims > MOST_NUMBERS:
        raise ValueError(f"centroids of more than {MOST_NUMBERS} numbers don't travel with the code")
    spark, keep = df.sparkSession, [id_col] if keep is None else keep
    columns = [f"k{i}" for i in range(len(keep))]
    named = df.select(*(F.col(c).alias(n) for c, n in zip(keep, columns, strict=True)), F.col(id_col).alias("id"), F.col(vec_col).alias("given"))
    vectors = integer_vectors(named, dims, "given", "v")
    centroids = first_centroids(vectors, k, seed, "id", "v")
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not centroids:
        kinds = ["int", "bigint", "bigint", "bigint", "string"]
        return df.limit(0).select(*keep, *(F.lit(None).cast(t).alias(n) for n, t in zip(names, kinds, strict=True)))
    rows = vectors.drop("id").withColumns({"cluster": F.lit(-1), "lower": F.lit(0.0)})
    lost, path, drift, still = [0.0] * len(centroids), None, 0.0, False
    for t in range(rounds + 1):
        last = t == rounds or still
        now, at = stored_at(_pass(rows, columns, centroids, lost, last), "vectors")
        found = _summed(now)
        if path:
            discard(spark, path)
        if trace is not None:
            trace.append({"vectors": sum(x["n"] for x in found.values()), "scanned": sum(x["scanned"] for x in found.values()), "drift": drift, "lost": max(lost)})
        if last:
            break
        moved = [[s // found[i]["n"] for s in found[i]["sums"]] if i in found else c for i, c in enumerate(centroids)]
        still = moved == centroids
        lost = loosening(centroids, moved, [found[i]["far"] ** 0.5 * (1 + 1e-9) if i in found else 0.0 for i in range(len(centroids))]).tolist()
        drift = float(np.linalg.norm(np.array(moved, float) - np.array(centroids, float), axis=1).max())
        rows, path, centroids = now.drop("distance", "part"), at, moved
    whole = sum(x["inertia"] for x in found.values())
    told = spark.createDataFrame([(i, x["inertia"], whole, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, x in found.items()], "c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    own = now.join(F.broadcast(told), F.col("cluster") == F.col("c"))  # k rows at most
    return own.select(*(F.col(n).alias(c) for c, n in zip(keep, columns, strict=True)), *names)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> str:
    """The same rounds as DuckDB SQL; distances are whole numbers below 2**53, so doubles are exact."""
    parts = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
        where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as c, v as m from kept order by sha256('{seed}:' || vec_id), v limit {k})",
    ]
    for t in range(rounds + 1):
        parts.append(
            f"""a{t} as materialized (select r, min({{'d': d, 'c': c}}) as s from
            (select r, c, (list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m))::bigint as d from kept, c{t}) group by r)"""
        )
        if t < rounds:
            parts.append(
                f"""c{t + 1} as materialized (select c{t}.c, coalesce(n.m, c{t}.m) as m from c{t} left join
                (select c, list(((s - ((s % n) + n) % n) // n)::double order by i) as m from
                (select s.c as c, i, sum(v[i]::bigint) as s, count(*) as n from a{t} join kept using (r), range(1, {dims + 1}) g(i) group by 1, 2) group by c) n using (c))"""
            )
    return f"""with {", ".join(parts)}
    select vec_id, s.c::int as cluster, s.d as distance, sum(s.d) over (partition by s.c)::bigint as cluster_inertia, sum(s.d) over ()::bigint as inertia,
    sha256(array_to_string(list_transform(m, lambda x: x::bigint), ',')) as centroid_sha256
    from a{rounds} join kept using (r) join c{rounds} on c{rounds}.c = s.c"""


OP12_SQL = _sql()
