"""Near-duplicates by cosine similarity: pairs, nearest neighbours, clusters.

All-pairs work is cut down by partitioning around pivots: a vector visits only
the partitions that can hold a partner within the threshold, and partitions are
split into blocks of bounded size, so neither a cluster nor a partition is ever
one task.  Nothing is lost by it: the bound is the triangle inequality's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeassay.functions.vectors import doubles, l2_normalize
from lakeassay.operators.skew import heavy_keys, salted_join
from lakeassay.session import materialize, ship_package

BLOCK = 2048
PIVOTS = 32


def _matrix(column: pd.Series) -> np.ndarray:
    return np.asarray(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def unit_classes(df: DataFrame, asset_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members): identical vectors form one class, named by its least id.

    classes: id, v (normalised), copies.  members: asset, id.  Rows without an
    id or embedding are left out; a zero vector is similar to nothing.
    """
    # 128 bits of hash stand for the vector; adding zero makes both zeros one
    plain = F.transform(l2_normalize(F.col(embedding)), lambda x: x + F.lit(0.0))
    rows = df.where(F.col(asset_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(asset_id).cast("long").alias("asset"), plain.alias("v"))
    keyed = materialize(rows.select("asset", "v", F.concat_ws("/", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("h")), "vectors")
    classes = materialize(keyed.groupBy("h").agg(F.min("asset").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "classes")
    slim = keyed.select("asset", "h")
    members = salted_join(slim, classes.select("h", "id"), "h", heavy_keys(slim, "h"), F.col("asset")).select("asset", "id")
    return classes, members


def _pivots(classes: DataFrame, n: int) -> np.ndarray:
    """A bounded sample of vectors, picked by hash."""
    picked = classes.orderBy(F.xxhash64("id")).limit(n).select("v").toPandas()
    return _matrix(picked["v"]) if len(picked) else np.zeros((0, 0))


def links(classes: DataFrame, threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(src, dst, sim) for every pair of classes with src < dst and cosine of at least ``threshold``.

    A vector lives in the partition of its nearest pivot and visits partition p
    if its distance to p exceeds that to its own pivot by at most twice the
    threshold's distance, which no possible partner can evade.
    """
    spark = classes.sparkSession
    ship_package(spark)
    points = _pivots(classes, pivots)
    schema = "src long, dst long, sim double"
    if not len(points):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(points)
    reach = 2 * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            x = _matrix(b["v"])
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))
            home = d.argmin(1)
            near = d <= d[np.arange(len(d)), home][:, None] + reach
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "home": home.astype(np.int32), "visits": [np.flatnonzero(r).astype(np.int32).tolist() for r in near]})

    placed = materialize(classes.select("id", "v").mapInPandas(assign, "id long, v array<double>, home int, visits array<int>"), "placed")
    # Partition sizes (at most one row per pivot) fix the number of blocks.
    homes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    visits = {r["p"]: r["n"] for r in placed.select(F.explode("visits").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks_of = lambda sizes: F.create_map(*[F.lit(x) for p in range(len(points)) for x in (p, max(1, -(-sizes.get(p, 0) // block)))])
    nh, nv = blocks_of(homes), blocks_of(visits)
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    residents = placed.select(F.col("home").alias("p"), "id", "v").withColumn("hb", spread(nh[F.col("p")])).withColumn("vb", F.explode(F.sequence(F.lit(0), nv[F.col("p")] - 1)))
    # Columns of their own for the other side: it comes from the same frame, and pruning would mix them up.
    other = placed.select(F.col("id").alias("vid"), F.col("v").alias("w"), "visits")
    visitors = other.select(F.explode("visits").alias("p"), "vid", "w").where(nh[F.col("p")].isNotNull()).withColumn("vb", F.pmod(F.xxhash64("vid"), nv[F.col("p")]).cast("int")).withColumn("hb", F.explode(F.sequence(F.lit(0), nh[F.col("p")] - 1)))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        ia, ib = a["id"].to_numpy(), b["vid"].to_numpy()
        sims = _matrix(a["v"]) @ _matrix(b["w"]).T
        i, j = np.nonzero((sims >= threshold) & (ia[:, None] < ib[None]))
        return pd.DataFrame({"src": ia[i], "dst": ib[j], "sim": sims[i, j]})

    return residents.groupBy("p", "hb", "vb").cogroup(visitors.groupBy("p", "hb", "vb")).applyInPandas(compare, schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of an edge list (src, dst): root is the least id it is connected with.

    Alternates large-star and small-star steps, which halve path lengths, and
    writes each round to the shared folder; the number of rounds is logarithmic
    in the diameter.
    """
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
        # large star: every greater neighbour points to the least
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        # small star: the node and its lesser neighbours point to the least of them
        small = down.join(low, "src").select(F.col("dst").alias("a"), F.col("src").alias("b"), "m")
        e = small.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("m").alias("dst")), F.struct(F.col("b").alias("src"), F.col("m").alias("dst"))))).where("src <> dst").distinct()
        e = materialize(e, "stars")
        state = e.agg(F.count(F.lit(1)), F.sum(F.col("src").cast("decimal(38,0)")), F.sum(F.col("dst").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return e.select(F.col("src").alias("id"), F.col("dst").alias("root")).unionByName(e.select(F.col("dst").alias("id"), F.col("dst").alias("root"))).distinct()


def membership(df: DataFrame, threshold: float, asset_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per asset: its cluster (least asset id), links to other classes, copies of itself, best similarity.

    Columns: asset, cluster, n_links, n_copies, max_similarity (1 for a copied
    vector, null for an asset that is similar to none).
    """
    classes, members = unit_classes(df, asset_id, embedding)
    found = materialize(links(classes, threshold), "links")
    ends = found.select("src", "dst", "sim").unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    degree = ends.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_links"), F.max("sim").alias("best"))
    roots = components(found)
    per = classes.select("id", "copies").join(degree, "id", "left").join(roots, "id", "left")
    best = F.greatest("best", F.when(F.col("copies") > 1, F.lit(1.0)))
    per = per.select("id", F.coalesce("root", "id").alias("cluster"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"), best.alias("max_similarity"))
    return members.join(per, "id").select("asset", "cluster", "n_links", "n_copies", "max_similarity")


def clusters(df: DataFrame, threshold: float, asset_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Clusters of at least two assets: cluster (least id), cluster_size, max_similarity.

    The greatest similarity of a cluster is that of its best link: pairs that
    are no link lie below the threshold.
    """
    return membership(df, threshold, asset_id, embedding).groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.max("max_similarity").alias("max_similarity")).where("cluster_size >= 2")


def duplicate_flags(found: DataFrame) -> DataFrame:
    """One flag per cluster, on its first member."""
    from lakeassay.schemas import flags

    sim = F.col("max_similarity")
    evidence = {"cluster_size": F.col("cluster_size"), "max_cosine_similarity": F.round(sim, 6)}
    return flags(found, "data_integrity", F.lit("Cluster of near-duplicate assets."), evidence, F.least(F.lit(1.0), sim), F.when(sim >= 0.99, "high").otherwise("medium"), F.col("cluster"), "review")


def nearest(df: DataFrame, queries: DataFrame, k: int, asset_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, neighbour, sim, rank) of the ``k`` rows most similar to each query row, itself excluded.

    Exact: blocks of queries meet blocks of rows, each meeting keeps its best k,
    and those are merged per query.  Ties go to the lesser id.
    """
    spark = df.sparkSession
    ship_package(spark)
    pick = lambda d: d.where(F.col(asset_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(asset_id).cast("long").alias("id"), l2_normalize(doubles(F.col(embedding))).alias("v"))
    rows, asked = pick(df), pick(queries)
    nr, nq = (max(1, -(-d.count() // block)) for d in (rows, asked))
    rows = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "neighbour": [], "sim": []}
        if len(a) and len(b):
            ids = b["id"].to_numpy()
            sims = _matrix(a["v"]) @ _matrix(b["v"]).T
            for q, s in zip(a["id"].to_numpy(), sims):
                s = np.where(ids == q, -np.inf, s)
                near = np.flatnonzero(s >= np.partition(s, -k)[-k]) if 0 < k < len(s) else np.arange(len(s))
                top = near[np.lexsort((ids[near], -s[near]))[:k]]
                top = top[np.isfinite(s[top])]
                out["query"] += [q] * len(top)
                out["neighbour"] += ids[top].tolist()
                out["sim"] += s[top].tolist()
        return pd.DataFrame(out).astype({"query": "int64", "neighbour": "int64", "sim": "float64"})

    part = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(best, "query long, neighbour long, sim double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("sim").desc(), "neighbour"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)
