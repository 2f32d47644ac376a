"""The most similar vectors for every vector: navigable small-world graphs over shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut, spread, stored

#: Links of a node in the upper layers and in the lowest; candidates looked at when building and when searching.
LINKS, LINKS_0, BUILD_BEAM, SEARCH_BEAM = 12, 24, 40, 32
#: The same beams where only close pairs are asked for, which stand out from everything else.
CLOSE_BUILD, CLOSE_SEARCH = 24, 24
#: Rows of a shard, queries sent to it at a time, rows on which centroids are fitted, and most centroids.
SHARD_ROWS, SHARD_QUERIES, MOST_CENTROIDS = 8192, 131_072, 4096
LEAST_TRAIN, TRAIN_ROWS = 20_000, 65_536
#: A query also visits the shards whose border is nearer than this, or than what ROUTED of the true neighbours of PROBES rows of the sample need.
MARGIN, ROUTED, PROBES = 0.1, 0.98, 1000
#: Shards whose sizes are broadcast; more of them are met by a join.
MOST_SHARDS = 500_000
BATCH = 1024


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, kept as one flat array of neighbours for each layer."""

    def __init__(self, vectors: np.ndarray, seed: int = 7, beam: int = BUILD_BEAM) -> None:
        self.x, self.beam = np.ascontiguousarray(vectors, np.float32), beam
        n = len(self.x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS)).astype(int), 6)
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n, LINKS_0 if not k else LINKS), -1, np.int32) for k in range(top + 1)]
        self.entry, self.height = -1, -1
        order = np.arange(n)
        at, size = 0, 16
        while at < n:
            self._insert(order[at : at + size])
            at, size = at + size, min(BATCH, 2 * size)

    def _search(self, queries: np.ndarray, layer: int, entries: np.ndarray, entry_sims: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of up to `beam` nodes per query, best first; -1 where there are fewer. Best-first, all queries at once."""
        b, links = len(queries), self.links[layer]
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        w = min(beam, entries.shape[1])
        ids[:, :w], sims[:, :w] = entries[:, :w], entry_sims[:, :w]
        seen = np.zeros((b, len(self.x) + 1), bool)
        np.put_along_axis(seen, ids, True, 1)
        seen[:, -1] = True  # the place of id -1
        opened = ids < 0
        ahead = min(4, beam)
        active = np.arange(b)
        while len(active):
            a = active
            worth = np.where(opened[a], -np.inf, sims[a])
            pick = np.argpartition(-worth, ahead - 1, axis=1)[:, :ahead] if ahead < beam else np.tile(np.arange(beam), (len(a), 1))
            ok = np.isfinite(np.take_along_axis(worth, pick, 1))
            go = ok.any(1)
            a, pick, ok = a[go], pick[go], ok[go]
            if not len(a):
                break
            active = a
            nodes = np.where(ok, ids[a[:, None], pick], -1)
            opened[a[:, None], pick] = True
            new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(a), -1).astype(np.int64)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[a[:, None], new]] = -1
            keep = int((new >= 0).sum(1).max())
            if not keep:
                continue
            new = -np.sort(-new, axis=1)[:, :keep]
            seen[a[:, None], new] = True
            got = np.matmul(self.x[new], queries[a][:, :, None])[:, :, 0]
            got[new < 0] = -np.inf
            all_ids = np.concatenate([ids[a], new], 1)
            all_sims = np.concatenate([sims[a], got], 1)
            all_opened = np.concatenate([opened[a], new < 0], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[a] = np.where(np.isfinite(np.take_along_axis(all_sims, best, 1)), np.take_along_axis(all_ids, best, 1), -1)
            sims[a] = np.take_along_axis(all_sims, best, 1)
            opened[a] = np.take_along_axis(all_opened, best, 1) | (ids[a] < 0)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _descend(self, queries: np.ndarray, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full((len(queries), 1), self.entry, np.int64)
        sims = (queries @ self.x[self.entry])[:, None]
        for layer in range(self.height, down_to, -1):
            entries, sims = self._search(queries, layer, entries, sims, 4)
        return entries, sims

    def _diverse(self, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's candidates (-1: none): those nearer to the row's node than to any candidate kept before,
        then, where places are left, the nearest of the others."""
        order = np.argsort(-np.where(cand >= 0, sims, -np.inf), axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[cand]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(cand.shape, bool)
        count = np.zeros(len(cand), int)
        for j in range(cand.shape[1]):
            rival = np.where(kept[:, :j], between[:, j, :j], -np.inf).max(1) if j else np.full(len(cand), -np.inf)
            kept[:, j] = (cand[:, j] >= 0) & (count < most) & (sims[:, j] > rival)
            count += kept[:, j]
        rank = np.where(kept, 0, np.where(cand >= 0, 1, 2))
        chosen = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(cand, chosen, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _insert(self, batch: np.ndarray) -> None:
        level = self.level[batch]
        mates = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(mates, -np.inf)
        height = self.height
        entries = sims = None
        if self.entry >= 0:
            entries, sims = np.full((len(batch), 1), self.entry, np.int64), (self.x[batch] @ self.x[self.entry])[:, None]
        for layer in range(max(height, int(level.max())), -1, -1):
            here = level >= layer
            if entries is not None and layer <= height:
                entries, sims = self._search(self.x[batch], layer, entries, sims, self.beam if here.any() else 4)
            if not here.any():
                continue
            own = batch[here]
            m = np.where(here[None, :], mates[here], -np.inf)
            width = min(self.beam // 2, len(batch))
            near = np.argpartition(-m, width - 1, axis=1)[:, :width]
            cand, cs = np.where(np.isfinite(np.take_along_axis(m, near, 1)), batch[near], -1), np.take_along_axis(m, near, 1)
            if entries is not None and layer <= height:
                cand, cs = np.concatenate([entries[here], cand], 1), np.concatenate([sims[here], cs], 1)
            most = self.links[layer].shape[1]
            picked = self._diverse(cand, cs, most // 2 if layer == 0 else most)
            self.links[layer][own, : picked.shape[1]] = picked
            self._link_back(layer, own, picked)
        if int(level.max()) > height:
            self.height, self.entry = int(level.max()), int(batch[level.argmax()])

    def _link_back(self, layer: int, own: np.ndarray, picked: np.ndarray) -> None:
        source, target = np.repeat(own, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, times = np.unique(target, return_index=True, return_counts=True)
        links, most = self.links[layer], self.links[layer].shape[1]
        for a in range(0, len(nodes), 2048):
            part, f, t = nodes[a : a + 2048], first[a : a + 2048], times[a : a + 2048]
            extra = np.full((len(part), int(t.max())), -1, np.int64)
            within = np.arange(int(t.max()))[None, :]
            mask = within < t[:, None]
            extra[mask] = source[(f[:, None] + within)[mask]]
            cand = np.concatenate([links[part].astype(np.int64), extra], 1)
            cand = -np.sort(-cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            cand = -np.sort(-cand, axis=1)
            full = (cand >= 0).sum(1) > most
            links[part[~full]] = np.pad(cand[~full][:, :most], ((0, 0), (0, max(0, most - cand.shape[1]))), constant_values=-1)
            if full.any():
                c = cand[full][:, : int((cand >= 0).sum(1).max())]
                s = np.matmul(self.x[c], self.x[part[full]][:, :, None])[:, :, 0]
                links[part[full]] = self._diverse(c, s, most)

    def query(self, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of about the k nearest nodes of each query, best first; -1 where the graph is smaller."""
        ids, sims = [], []
        beam = max(beam, 2 * k)
        for a in range(0, len(queries), BATCH):
            q = np.ascontiguousarray(queries[a : a + BATCH], np.float32)
            entries, s = self._descend(q, 0)
            i, s = self._search(q, 0, entries, s, beam)
            ids.append(i[:, :k])
            sims.append(s[:, :k])
        return (np.concatenate(ids), np.concatenate(sims)) if ids else (np.zeros((0, k), np.int64), np.zeros((0, k), np.float32))


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n unit centroids of a sample of unit vectors, by spherical k-means."""
    rng = np.random.default_rng(11)
    n = max(1, min(n, len(sample)))
    centroids = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(sample[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids).astype(np.float32)
    return centroids


def borders(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, away) of unit vectors: the nearest centroid, and how far the border to each other shard is."""
    sims = x @ centroids.T
    home = sims.argmax(1)
    gaps = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-12))
    return home, (sims[np.arange(len(x)), home][:, None] - sims) / gaps[home]


def route(x: np.ndarray, centroids: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits) of unit vectors: the nearest centroid, and which shards lie within `margin` of crossing a border."""
    home, away = borders(x, centroids)
    return home, away <= margin


def fit_margin(sample: np.ndarray, lanes: np.ndarray, centroids: np.ndarray, k: int) -> float:
    """The margin with which the shards of ROUTED of the k nearest in a sample are visited, at least MARGIN.

    The nearest of the whole table lie closer than those of a sample, so theirs are visited at least as often.
    """
    home, needed = borders(sample, centroids)[0], []
    for lane in np.unique(lanes):
        own = np.flatnonzero(lanes == lane)
        probes, most = own[:: math.ceil(len(sample) / PROBES)], min(k, len(own) - 1)
        for a in range(0, len(probes) if most else 0, BATCH):
            part = probes[a : a + BATCH]
            sims = sample[part] @ sample[own].T
            sims[part[:, None] == own[None, :]] = -np.inf
            near = own[np.argpartition(-sims, most - 1, axis=1)[:, :most]]
            needed.append(np.take_along_axis(borders(sample[part], centroids)[1], home[near], 1).ravel())
    return max(MARGIN, float(np.quantile(np.concatenate(needed), ROUTED, method="higher"))) if needed else MARGIN


def close_margin(least: float, size: int) -> float:
    """The margin for pairs of at least `least` similarity, whose vectors lie at most d = sqrt(2 - 2 * least) apart.

    Both vectors see the same border between their shards, so one of them is no farther from it than half the part of their
    difference across it: at most d / 2, and d / (2 * sqrt(size)) on average over directions, of which three are allowed.
    """
    d = math.sqrt(max(0.0, 2 - 2 * least))
    return min(d / 2, 1.5 * d / math.sqrt(size))


def _unit(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the usable vectors of a batch."""
    lists = batch.column("v")
    right = np.flatnonzero(pc.equal(pc.list_value_length(lists), size).fill_null(False).to_numpy(zero_copy_only=False))
    x = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    most = np.abs(x).max(axis=1, initial=0.0)
    ok = np.isfinite(most) & (most > 0)
    x = x[ok] / most[ok][:, None]
    return right[ok], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _matrix(values: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, size)


def _usable(df: DataFrame, id_column: str, lane: str, vector: str, size: int) -> DataFrame:
    """(lane, id, v), one row for each id of a lane: of ids given more than once the smallest usable vector. Only such ids are moved."""
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(lane).cast("string"), F.lit("")).alias("lane"), F.col(vector).alias("v")).filter("id is not null")
    again = cut(rows.groupBy("lane", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if again.isEmpty():
        return rows
    ok = (F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    one = rows.join(again, ["lane", "id"], "left_semi").filter(ok).groupBy("lane", "id").agg(F.min("v").alias("v"))
    return rows.join(again, ["lane", "id"], "left_anti").unionByName(one)


def nearest(df: DataFrame, k: int = 5, id_column: str = "vec_id", lane: str = "lane", vector: str = "embedding", size: int = 64, least: float | None = None, margin: float | None = None, shard_rows: int = SHARD_ROWS, shard_queries: int = SHARD_QUERIES) -> DataFrame:
    """(lane, id, neighbour, similarity, place): about the k vectors of the same lane with the highest cosine similarity; with
    `least`, only those of at least that similarity, for which far shards and wide beams aren't needed.

    Vectors that are null, not of `size` values, all zero or hold a null, NaN or infinite value are left out, as are null ids;
    a null lane is a lane of its own. Rows repeated under one id of a lane count once (the smallest vector). Equal vectors
    under other ids are neighbours; ties go to the smaller id. Other columns are ignored. Empty tables give an empty result.

    Vectors are sharded by their nearest centroid (fitted on TRAIN_ROWS rows at most; every row is indexed). A shard over
    `shard_rows` rows is split at random, its queries into blocks many times as large as what is built for them, so no task
    gets more than about shard_rows and shard_queries rows. Each shard builds a graph of its own; a query visits its own shard
    and those it nearly belongs to (borders within `margin`: close_margin(least), or fitted to the k nearest of the sample),
    and the shards' results are merged. The driver sees the sample only.
    """
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    rows = spread(_usable(df, id_column, lane, vector, size))
    total = df.count()
    n = min(MOST_CENTROIDS, math.ceil(total / shard_rows))
    train = min(TRAIN_ROWS, max(LEAST_TRAIN, 16 * n))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch, size)
            yield pa.RecordBatch.from_arrays([batch.column("lane").take(pa.array(at)), _binary(x)], ["lane", "v"])

    few = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(total, 1))) < train).mapInArrow(taken, "lane string, v binary").limit(train).toPandas()
    if not len(few):
        return spark.createDataFrame([], f"lane string, id {kind}, neighbour {kind}, similarity float, place int")
    sample = _matrix(few["v"], size)
    centroids = fit_centroids(sample, n)
    if margin is None:
        margin = fit_margin(sample, few["lane"].to_numpy(), centroids, k) if least is None else close_margin(least, size)
    shared = spark.sparkContext.broadcast(centroids)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch, size)
            for a in range(0, len(at), 4096):
                part, own = pa.array(at[a : a + 4096]), x[a : a + 4096]
                home, near = route(own, shared.value, margin)
                offsets = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
                near_lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(near)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("lane").take(part), batch.column("id").take(part), _binary(own), pa.array(home.astype(np.int32)), near_lists], ["lane", "id", "v", "home", "near"])

    routed = stored(rows.mapInArrow(visits, f"lane string, id {kind}, v binary, home int, near array<int>"))
    each = routed.select("lane", "home", F.explode("near").alias("c")).groupBy("lane", "c").agg(F.count(F.lit(1)).alias("asks"), F.count_if(F.col("home") == F.col("c")).alias("rows"))
    shape = cut(each.filter("rows > 0").select("lane", "c", F.ceil(F.col("rows") / shard_rows).cast("int").alias("subs"), F.ceil(F.col("asks") / shard_queries).cast("int").alias("blocks")))
    if shape.count() <= MOST_SHARDS:
        shape = F.broadcast(shape)
    parts = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    cells = routed.withColumn("c", F.explode("near")).join(shape, ["lane", "c"])
    cells = cells.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("subs") * F.col("blocks") - 1)))
    cells = cells.withColumn("sub", F.expr("cell div blocks").cast("int")).withColumn("block", (F.col("cell") % F.col("blocks")).cast("int"))
    cells = cells.withColumn("own", (F.col("home") == F.col("c")) & (parts % F.col("subs") == F.col("sub"))).withColumn("ask", (parts / 7).cast("long") % F.col("blocks") == F.col("block"))
    cells = cells.filter("own or ask").select("lane", "c", "sub", "block", "id", "v", "own", "ask")
    build, look = (BUILD_BEAM, SEARCH_BEAM) if least is None else (CLOSE_BUILD, CLOSE_SEARCH)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        base, ask = pdf[pdf["own"]].sort_values("id"), pdf[pdf["ask"]]
        if not len(base) or not len(ask):
            return pd.DataFrame({"lane": [], "id": [], "s": [], "n": []})
        names = base["id"].to_numpy()
        asked = ask["id"].to_numpy()
        found, similar = Graph(_matrix(base["v"], size), beam=build).query(_matrix(ask["v"], size), k + 1, look)
        keep = (found >= 0) & (names[found] != asked[:, None])
        if least is not None:
            keep &= similar >= least
        hits = keep.sum(1)
        cuts = np.cumsum(hits)[:-1]
        out = pd.DataFrame({"lane": ask["lane"].iloc[0], "id": asked, "s": np.split(-similar[keep], cuts), "n": np.split(names[found[keep]], cuts)})
        return out[hits > 0]

    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 4)
    found = cells.repartition(n_parts, "lane", "c", "sub", "block").groupBy("lane", "c", "sub", "block").applyInPandas(search, f"lane string, id {kind}, s array<float>, n array<{kind}>")
    best = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("s", "n")))), 1, k)
    merged = found.groupBy("lane", "id").agg(best.alias("_b")).select("lane", "id", F.posexplode("_b").alias("place", "_x"))
    return merged.select("lane", "id", F.col("_x.n").alias("neighbour"), (-F.col("_x.s")).alias("similarity"), (F.col("place") + 1).alias("place"))


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """(vec_a, vec_b): the pairs among nearest() of at least `least` similarity, the smaller id first, each once."""
    near = found.filter(F.col("similarity") >= least)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()
