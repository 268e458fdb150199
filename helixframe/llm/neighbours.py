"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph for each shard, searched by beams.

Vectors are dealt into shards by a hash of their ids, so that a group of like or equal vectors is spread over all of them. A task holds one
shard at a time: it builds the graph as the shard's rows arrive, then beam-searches it for every query, which arrive behind them in
batches. Each shard offers its best k, and of all offers the best k of each query stay.

A shard's vectors are parted into bands of like length, each with a graph of its own; a query is done with a band if its product with the band's longest
vector could not be among its best. In a band vectors are lengthened by one component to a common length, where the largest inner product is the smallest distance. A graph
is built in batches: a greedy search of the graph so far proposes neighbours of each new vector; relaxed distance pruning keeps a candidate
unless a kept one is nearer to it by the factor `alpha`, so that kept edges lead different ways; edges are added backwards and pruned again; a
second pass over all vectors does the same with the whole graph. Vectors that no path reaches are places where searches start. Equal
vectors of a shard are one node with its k + 1 smallest ids: more can't be among anyone's best k.

The scores returned are sums of products in double precision, in the order of the components.

Cost: queries x shards searches, and each query is sent to each shard. A shard holds up to SHARD_BYTES of single-precision
components, but there are `shards` at least; a task needs some eight times a shard's size.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths are no candidates for one another. Ties go to the smaller id. A query's own id is no candidate of it; rows that share an id
and are queries give one list, of the best over their vectors, with each id once. With fewer than k candidates all are
returned, with none no row; an empty table gives no rows. Only key and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, table

SHARDS = 16  # at least
SHARD_BYTES = 4 << 20
DEGREE, BEAM, ALPHA = 32, 96, 1.2
BAND, BAND_ROWS = 1.25, 96  # lengths of a band's vectors differ by this factor at most, unless they are fewer
BUILD_BEAM = 64  # at most, while the graph is built
BATCH = 256  # vectors searched at a time
CELLS = 1 << 22  # entries of a temporary array


class Graph:
    """Nodes are the rows of y, whose lengths are equal, so that larger products are smaller distances."""

    def __init__(self, y: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7):
        self.y, self.degree, self.beam, self.alpha = y, degree, beam, alpha
        self.n = len(y)
        self.edges = np.full((self.n, degree), -1, np.int32)
        self.square = float((y[:1] ** 2).sum())
        order = np.random.default_rng(seed).permutation(self.n)
        centre = int((y @ y.mean(0)).argmax())
        order = np.concatenate(([centre], order[order != centre]))
        self.starts = np.array([centre])
        done = min(self.n, 2 * degree)
        self.first(order[:done])
        while done < self.n:
            size = min(BATCH, max(32, done // 8))
            self.insert(order[done : done + size])
            done += size
        if self.n > 2 * degree:
            for at in range(0, self.n, BATCH):
                self.insert(order[at : at + BATCH])
        self.starts = np.concatenate((self.starts, self.unreached()))

    def apart(self, products: np.ndarray) -> np.ndarray:
        """Squared distances."""
        return np.maximum(2 * (self.square - products), 0)

    def first(self, nodes: np.ndarray) -> None:
        """Edges among the first few, of which all are candidates of all."""
        if len(nodes) > 1:
            self.edges[nodes] = self.pruned(nodes, np.array([nodes[nodes != x] for x in nodes]))

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to `degree` of each node's candidates (-1: none, repeats allowed), nearest first; one to which a kept one is nearer
        than the node, by the factor alpha, is left out."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        width = candidates.shape[1]
        step = max(1, CELLS // max(1, width * max(width, self.y.shape[1])))
        for at in range(0, len(nodes), step):
            own, c = nodes[at : at + step], candidates[at : at + step].astype(np.int64)
            c = np.sort(c, axis=1)
            bad = (c < 0) | (c == own[:, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            z = self.y[c]
            d = np.where(bad, np.inf, self.apart(np.matmul(z, self.y[own][:, :, None])[:, :, 0]))
            between = self.apart(np.matmul(z, z.transpose(0, 2, 1)))
            left, r = ~bad, np.arange(len(own))
            for k in range(self.degree):
                far = np.where(left, d, np.inf)
                best = far.argmin(1)
                go = left[r, best]
                if not go.any():
                    break
                out[at : at + step][go, k] = c[r, best][go]
                left &= ~(self.alpha**2 * between[r, best] <= d) & go[:, None]
                left[r, best] = False
        return out

    def insert(self, nodes: np.ndarray) -> None:
        found, _ = self.search(self.y[nodes], min(self.beam, BUILD_BEAM))
        self.edges[nodes] = new = self.pruned(nodes, np.concatenate((found, self.edges[nodes]), axis=1))
        r, k = np.nonzero(new >= 0)
        to, by = new[r, k].astype(np.int64), nodes[r].astype(np.int64)
        known = (self.edges[to] == by[:, None]).any(1)
        to, by = to[~known], by[~known]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        own, first, size = np.unique(to, return_index=True, return_counts=True)
        order = np.argsort(size, kind="stable")  # like many at a time
        own, first, size = own[order], first[order], size[order]
        at = 0
        while at < len(own):
            stop = min(len(own), at + BATCH)
            width = int(size[stop - 1])
            col = np.arange(width)
            inside = col < size[at:stop, None]
            more = np.where(inside, by[np.minimum(first[at:stop, None] + col, len(by) - 1)], -1)
            self.edges[own[at:stop]] = self.joined(own[at:stop], more)
            at = stop

    def joined(self, nodes: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Their edges with more; pruned only where they are too many."""
        both = np.concatenate((self.edges[nodes], more.astype(np.int32)), axis=1)
        fits = (both >= 0).sum(1) <= self.degree
        out = np.empty((len(nodes), self.degree), np.int32)
        out[fits] = -np.sort(-both[fits], axis=1)[:, : self.degree]
        if not fits.all():
            out[~fits] = self.pruned(nodes[~fits], both[~fits])
        return out

    def search(self, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the `beam` nodes with the largest products that a greedy walk meets, and these products (-1, -inf: none)."""
        m = len(q)
        ids, score = np.full((m, beam), -1, np.int32), np.full((m, beam), -np.inf)
        seen, walked = np.zeros((m, self.n), bool), np.zeros((m, beam), bool)
        rows = np.arange(m)
        new = np.tile(self.starts, (m, 1))
        while len(rows):
            # new: nodes met by each of `rows`, none met before, -1 for none
            r, c = np.nonzero(new >= 0)
            flat, at = np.unique(rows[r] * self.n + new[r, c], return_index=True)
            r, c = r[at], c[at]
            seen.reshape(-1)[flat] = True
            got = np.full(new.shape, -np.inf)
            for a in range(0, len(r), CELLS // 16):
                b = slice(a, a + CELLS // 16)
                got[r[b], c[b]] = np.einsum("ij,ij->i", self.y[new[r[b], c[b]]], q[rows[r[b]]])
            all_s = np.concatenate((score[rows], got), axis=1)
            all_i = np.concatenate((ids[rows], new.astype(np.int32)), axis=1)
            all_w = np.concatenate((walked[rows], np.zeros(new.shape, bool)), axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            s = np.take_along_axis(all_s, best, 1)
            i = np.where(s > -np.inf, np.take_along_axis(all_i, best, 1), -1)
            w = np.take_along_axis(all_w, best, 1) | (i < 0)
            turn = np.cumsum(~w, axis=1)
            take = ~w & (turn <= wide)
            ids[rows], score[rows], walked[rows] = i, s, w | take
            go = take.any(1)
            rows, i, take = rows[go], i[go], take[go]
            if len(rows):
                pick = np.argsort(~take, axis=1, kind="stable")[:, :wide]
                nodes = np.where(np.take_along_axis(take, pick, 1), np.take_along_axis(i, pick, 1), -1)
                new = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(rows), -1)
                new = np.where((new >= 0) & ~seen[rows[:, None], new], new, -1)
        return ids, score

    def unreached(self) -> np.ndarray:
        met = np.zeros(self.n, bool)
        now = self.starts
        met[now] = True
        while len(now):
            ahead = np.unique(self.edges[now])
            now = ahead[(ahead >= 0) & ~met[ahead]]
            met[now] = True
        return np.flatnonzero(~met)


class Shard:
    """Distinct vectors of one length with the smallest ids of each, and the graphs of their bands."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, degree: int, beam: int, alpha: float):
        self.k, self.beam = k, beam
        x = x + 0.0  # one zero
        self.x, group = np.unique(x, axis=0, return_inverse=True)
        pairs = np.unique(np.stack((group.reshape(-1), ids), axis=1), axis=0)
        place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
        pairs = pairs[place <= k]
        self.ids = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.x) + 1))
        small = self.x / max(float(np.abs(self.x).max()), np.finfo(float).tiny)  # squares of large components stay finite
        square = np.einsum("ij,ij->i", small, small)
        order = np.argsort(-square, kind="stable")
        self.bands = []
        at = 0
        while at < len(order):
            least = square[order[at]] / BAND**2
            stop = max(int(np.searchsorted(-square[order], -least, "right")), at + BAND_ROWS)
            stop = len(order) if len(order) - stop < BAND_ROWS else stop
            own = order[at:stop]
            y = np.concatenate((small[own], np.sqrt(np.maximum(square[own[0]] - square[own], 0))[:, None]), axis=1)
            longest = np.sqrt(max((self.x[own] ** 2).sum(1).max(), np.finfo(float).tiny))
            self.bands.append((own, longest, Graph(y, degree, beam, alpha)))
            at = stop

    def best(self, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of q, id and score of up to k neighbours of each, without its own id."""
        length = np.sqrt((q**2).sum(1))
        beam = max(self.beam, self.k + 1)
        found, top = [], np.full((len(q), self.k + 1), -np.inf)
        for members, longest, graph in self.bands:
            r = np.flatnonzero(length * longest * (1 + 1e-9) >= top[:, -1])  # no product of the others can be among their best
            if not len(r):
                continue
            unit = q[r] / np.abs(q[r]).max(1, keepdims=True)
            nodes, _ = graph.search(np.concatenate((unit, np.zeros((len(r), 1))), axis=1), beam)
            i, col = np.nonzero(nodes >= 0)
            node = members[nodes[i, col]]
            score = exact(q, r[i], self.x, node)
            found.append((r[i], node, score))
            new = np.full(nodes.shape, -np.inf)
            new[i, col] = score
            top[r] = -np.sort(-np.concatenate((top[r], new), axis=1), axis=1)[:, : self.k + 1]
        row, node, score = (np.concatenate(x) for x in zip(*found))
        many = self.first[node + 1] - self.first[node]
        at = np.repeat(self.first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
        row, score, ids = np.repeat(row, many), np.repeat(score, many), self.ids[at]
        other = ids != own[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        stay = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[stay], ids[stay], score[stay]


def exact(q: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of q with rows j of x, added up in the order of the components."""
    out = np.zeros(len(i))
    a, b = np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
    for u, v in zip(a, b):
        out += u[i] * v[j]
    return out


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int, is_query: Column, key: str = "vec_id", vector: str = "embedding", shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """query_id, rank (from 1), key and score of the k nearest found of each row for which is_query holds; key is a whole number."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    (parts,) = rows.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    shards = max(shards, -(-4 * int(parts) // shard_bytes))
    own = F.array(F.struct(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks")))
    asked = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("shard"), F.lit(True).alias("asks")))
    dealt = rows.select("id", "vector", F.inline(F.when(F.col("asks"), F.concat(own, asked)).otherwise(own)).alias("shard", "asks")).withColumn("parts", F.size("vector"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "parts", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, held, shard = None, [], [], None
        for b in batches:
            parts, shards = (b.column(c).to_numpy(zero_copy_only=False) for c in ("parts", "shard"))
            asks = b.column("asks").to_numpy(zero_copy_only=False)
            x, own = b.column("vector").flatten().to_numpy(zero_copy_only=False), b.column("id").to_numpy()
            ends = np.concatenate(([0], np.cumsum(parts)))
            cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(parts) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(own)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if here != (shards[a], parts[a]):
                    here, ids, held, shard = (shards[a], parts[a]), [], [], None
                v = x[ends[a] : ends[z]].reshape(z - a, parts[a])
                if not asks[a]:
                    ids.append(own[a:z])
                    held.append(v)
                    continue
                if shard is None and ids:
                    shard = Shard(np.concatenate(ids), np.concatenate(held).astype(float), k, degree, beam, alpha)
                    ids, held = [], []
                step = BATCH if shard is None else max(16, min(BATCH, (64 << 20) // len(shard.x)))
                for at in range(0, z - a if shard is not None else 0, step):
                    q = own[a:z][at : at + step]
                    row, found, score = shard.best(q, v[at : at + step].astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

    found = dealt.mapInArrow(lean(run), "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # an id met through several rows
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)
