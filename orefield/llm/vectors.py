"""The k most similar vectors of every vector, within an acceptable loss.

Method: vectors are grouped into regions around centroids, as many as the table is long; every vector visits
the nearest regions. There, in one task, the region is cut into small cells; the four-bit codes of the
cells nearest to a query are scanned through lookup tables, and all that may be among its best
are reranked by their exact products. The codebooks minimise a score-aware loss that weighs residual error
parallel to the vector more than orthogonal error. Regions and codebooks are fitted on bounded
samples; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from orefield.session import stored

#: Fitting sample on the driver: at most so many vectors (19 MB at 72 dimensions).
SAMPLE = 40_000
#: Vectors per region aimed at. Up to TOP regions are fitted on the driver's sample; a larger table's regions are
#: fitted below TOP nodes in tasks, on so many sampled vectors each. Their centroids are broadcast, so their
#: number is bounded (38 MB); a table of more than 537 million vectors has longer regions.
REGION, TOP, SAMPLED, MOST_REGIONS = 2_048, 256, 32, 262_144
#: Regions that a vector visits on average (those whose centroid is nearly as near as the nearest's), the most, and
#: nodes looked into for them.
VISITS, MOST_VISITS, NODES = 3.5, 12, 8
#: Vectors per cell, and cells scanned in the first, second, ... region.
CELL, PROBES = 64, (8, 6, 4, 3, 3, 2, 2, 2, 1, 1, 1, 1)
#: Candidates reranked per vector and region: at least so many, and all whose quantised score is within so many
#: standard errors of the k-th best.
RERANK, ERRORS = 40, 3.0
#: Weight of parallel against orthogonal residual error (anisotropic loss); passes of its fit.
PARALLEL, PASSES = 4.0, 4
#: Dimensions per four-bit code.
SUB = 2
#: Scale of the fixed-point form in which unit vectors travel.
FIXED = np.float32(32767)
#: A group of the scan holds at most about so many vectors of a region and so many of its visitors; a crowded
#: region is cut on both sides, and each part of the visitors meets each part of the vectors.
BLOCK, VISITORS = 8_192, 24_576
#: Queries handled at once in a task.
QUERY_BLOCK = 512
#: A list of copies or of their groups up to this many rows is broadcast; a longer one is shuffled.
SMALL = 200_000


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty centroid takes the vector that fits worst."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.empty(len(x), np.int64)
        fit = np.empty(len(x), np.float32)
        for a in range(0, len(x), 4096):
            s = x[a : a + 4096] @ centre.T
            own[a : a + 4096] = s.argmax(1)
            fit[a : a + 4096] = s.max(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            total[empty] = x[np.argsort(fit)[: len(empty)]]
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32)


def codebooks(x: np.ndarray, residual: np.ndarray, seed: int = 7) -> np.ndarray:
    """(subspaces, 16, SUB) codebooks of the residuals to the cells' centres, under the anisotropic loss
    e'e + (PARALLEL - 1)(x'e)^2 of the error e that the code leaves."""
    rng = np.random.default_rng(seed)
    along, parts = x.reshape(len(x), -1, SUB).astype(np.float64), residual.reshape(len(x), -1, SUB).astype(np.float64)
    books = parts[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
    for _ in range(PASSES):
        code = encode(x, residual, books)
        shares = np.stack([((parts[:, m] - books[m][code[:, m]]) * along[:, m]).sum(1) for m in range(parts.shape[1])])
        total = shares.sum(0)
        for m in range(parts.shape[1]):
            rest = total - shares[m]
            for c in range(16):
                of = code[:, m] == c
                if not of.any():
                    books[m, c] = parts[rng.integers(len(parts)), m]
                    continue
                r, v = parts[of, m], along[of, m]
                left = of.sum() * np.eye(SUB) + (PARALLEL - 1) * v.T @ v
                right = r.sum(0) + (PARALLEL - 1) * (v * (rest[of] + (v * r).sum(1))[:, None]).sum(0)
                books[m, c] = np.linalg.solve(left, right)
            shares[m] = ((parts[:, m] - books[m][code[:, m]]) * along[:, m]).sum(1)
            total = rest + shares[m]
    return books.astype(np.float32)


def encode(x: np.ndarray, residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Four-bit codes: nearest codewords, then one pass of coordinate descent on the anisotropic loss."""
    along, parts = x.reshape(len(x), -1, SUB), residual.reshape(len(x), -1, SUB)
    code = np.empty(parts.shape[:2], np.uint8)
    square = np.empty((len(x), parts.shape[1], 16), np.float32)
    share = np.empty_like(square)
    for m in range(parts.shape[1]):
        square[:, m] = (books[m] ** 2).sum(1)[None] - 2 * (parts[:, m] @ books[m].T)
        share[:, m] = (along[:, m] * parts[:, m]).sum(1)[:, None] - along[:, m] @ books[m].T
        code[:, m] = square[:, m].argmin(1)
    rows = np.arange(len(x))
    total = share[rows[:, None], np.arange(parts.shape[1])[None], code].sum(1)
    for m in range(parts.shape[1]):
        rest = total - share[rows, m, code[:, m]]
        best = (square[:, m] + (PARALLEL - 1) * np.square(rest[:, None] + share[:, m])).argmin(1)
        total = rest + share[rows, m, best]
        code[:, m] = best
    return code


@dataclass
class VectorIndex:
    """What every task needs: the nodes, the regions in order of their node, and the codebooks."""

    nodes: np.ndarray
    regions: np.ndarray
    begin: np.ndarray  # the first region of each node, and the number of regions
    books: np.ndarray
    margin: float = 0.0  # how much less near than the nearest a visited region may be

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest regions of each vector among those of its nearest nodes, nearest first, and how much less
        near they are than the first."""
        wanted = min(MOST_VISITS, len(self.regions))
        found, gap = np.empty((len(x), wanted), np.int64), np.empty((len(x), wanted), np.float32)
        for a in range(0, len(x), 2_000):  # bounds the products held at once
            part = x[a : a + 2_000]
            if len(self.nodes) == len(self.regions):
                product = part @ self.regions.T
                best = _first(product, wanted)
                found[a : a + 2_000], gap[a : a + 2_000] = best, np.take_along_axis(product, best, 1)
                continue
            near = _first(part @ self.nodes.T, min(NODES, len(self.nodes)))
            scores = np.full((len(part), near.shape[1], wanted), -np.inf, np.float32)
            names = np.zeros(scores.shape, np.int64)
            for node in np.unique(near):
                row, place = np.nonzero(near == node)
                low, high = self.begin[node], self.begin[node + 1]
                product = part[row] @ self.regions[low:high].T
                top = _first(product, min(wanted, high - low))
                scores[row, place, : top.shape[1]] = np.take_along_axis(product, top, 1)
                names[row, place, : top.shape[1]] = top + low
            scores, names = scores.reshape(len(part), -1), names.reshape(len(part), -1)
            best = _first(scores, wanted)
            found[a : a + 2_000], gap[a : a + 2_000] = np.take_along_axis(names, best, 1), np.take_along_axis(scores, best, 1)
        return found, gap[:, :1] - gap

    def with_margin(self, sample: np.ndarray) -> "VectorIndex":
        """With the margin at which a vector of the sample visits VISITS regions on average."""
        gaps = np.sort(self.nearest(sample[:8_000])[1].ravel())
        self.margin = float(gaps[min(len(gaps) - 1, int(VISITS * min(len(sample), 8_000)))])
        return self


def _first(score: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest of each row, largest first."""
    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


def fit_books(sample: np.ndarray) -> np.ndarray:
    """Codebooks of the residuals to centroids of cells, on a bounded sample."""
    few = sample[np.random.default_rng(1).permutation(len(sample))[:10_000]]
    centres = kmeans(few, max(1, len(few) // CELL), 5)
    return codebooks(few, few - centres[(few @ centres.T).argmax(1)])


def scan(books: np.ndarray, base: np.ndarray, base_key: np.ndarray, query: np.ndarray, query_key: np.ndarray, probes: np.ndarray, k: int):
    """(query position, key, exact product) of the best ``k`` of each query within the ``probes`` cells of a
    region that are nearest to it."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(base) or not len(query):
        return none
    count = max(1, len(base) // CELL)
    some = base[np.random.default_rng(5).permutation(len(base))[: 16 * count]]
    centres = kmeans(some, count, 4)
    own = (base @ centres.T).argmax(1)
    order = np.argsort(own, kind="stable")
    base, base_key, own = base[order], base_key[order], own[order]
    residual = base - centres[own]
    code = encode(base, residual, books)
    left = residual - books[np.arange(code.shape[1])[None], code].reshape(len(base), -1)
    error = float(np.sqrt(np.square(left).sum(1).mean() / base.shape[1]))  # of a product, if errors have no direction
    if code.shape[1] % 2:
        code, books = np.pad(code, ((0, 0), (0, 1))), np.concatenate([books, np.zeros_like(books[:1])])
    pair = (code[:, ::2].astype(np.int64) << 4 | code[:, 1::2]).T.copy()  # two four-bit codes a byte
    begin = np.searchsorted(own, np.arange(count + 1))
    found = []
    for at in range(0, len(query), QUERY_BLOCK):
        block = query[at : at + QUERY_BLOCK]
        parts = np.zeros((len(block), len(books) * SUB), np.float32)
        parts[:, : block.shape[1]] = block
        table = np.matmul(parts.reshape(len(block), -1, SUB).transpose(1, 0, 2), books.transpose(0, 2, 1))
        both = (table[::2][:, :, :, None] + table[1::2][:, :, None, :]).reshape(len(books) // 2, -1)
        product = block @ centres.T
        most = min(int(probes[at : at + QUERY_BLOCK].max()), count)
        near = _first(product, most)
        chosen = np.arange(most)[None] < probes[at : at + QUERY_BLOCK, None]
        who, place = np.nonzero(chosen)[0], near[chosen]
        size = (begin[1:] - begin[:-1])[place]
        total = np.bincount(who, size, len(block)).astype(np.int64)
        width = int(total.max())
        if not width:
            continue
        shift = np.cumsum(size) - size - (np.cumsum(total) - total)[who]  # pairs are in the order of the queries
        score = np.full((len(block), width), -np.inf, np.float32)
        row = np.zeros(score.shape, np.int32)
        by_cell = np.argsort(place, kind="stable")
        for n in np.split(by_cell, np.flatnonzero(np.diff(place[by_cell])) + 1):
            c, q = place[n[0]], who[n]
            a, b = begin[c], begin[c + 1]
            if a == b:
                continue
            sums = np.repeat(product[q, c][:, None], b - a, axis=1)
            own_table = (q * 256)[:, None]
            for m in range(len(both)):
                sums += both[m].take(own_table + pair[m, a:b])
            columns = shift[n][:, None] + np.arange(b - a)[None]
            score[q[:, None], columns] = sums
            row[q[:, None], columns] = np.arange(a, b, dtype=np.int32)[None]
        score[base_key[row] == query_key[at : at + len(block)][:, None]] = -np.inf
        keep = min(RERANK, width)
        ranked = -np.partition(-score, sorted({min(k, width) - 1, keep - 1}), axis=1)[:, :keep]
        ranked.sort(1)
        bound = np.minimum(ranked[:, 0], ranked[:, max(0, keep - k)] - ERRORS * error)
        q, column = np.nonzero((score >= bound[:, None]) & np.isfinite(score))
        near = row[q, column]
        exact = np.empty(len(q))
        for a in range(0, len(q), 100_000):
            exact[a : a + 100_000] = np.einsum("ij,ij->i", base[near[a : a + 100_000]], block[q[a : a + 100_000]], dtype=np.float64)
        order = np.lexsort((base_key[near], -exact, q))
        q, near, exact = q[order], near[order], exact[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[first] + at, base_key[near[first]], exact[first]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none


def _fixed_point(width: int):
    """Unit vectors as 16-bit fixed point (a product of two errs by about 1e-5) and their digest, so vectors
    of one direction are copies whatever their lengths; null where a vector isn't usable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            full = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
            x = column.filter(full).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            place = np.flatnonzero(full.to_numpy(zero_copy_only=False))[good]
            x = x[good]
            vector, digest = np.full(len(batch), None, object), np.full(len(batch), None, object)
            if len(x):
                unit = x / np.abs(x).max(1, keepdims=True)  # extreme lengths must not overflow
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                fixed = np.rint(unit * FIXED).astype(np.int16)
                vector[place] = [v.tobytes() for v in fixed]
                digest[place] = [md5(v).digest() for v in vector[place]]
            arrays = [batch.column(0), batch.column(1), pa.array(vector, pa.binary()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "at", "vector", "digest"])

    return run


def _packed(value):
    """Ids of the form ``symbol:sha256:`` and 64 hex digits travel as 32 bytes behind a one, others as
    they are behind a zero byte."""
    hashed = value.rlike("^symbol:sha256:[0-9a-f]{64}$")
    return F.when(hashed, F.unhex(F.concat(F.lit("01"), F.substring(value, 15, 64)))).otherwise(
        F.concat(F.unhex(F.lit("00")), F.encode(value, "UTF-8"))
    )


def _unpacked(value):
    rest = F.substring(value, 2, 2147483647)
    return F.when(F.substring(value, 1, 1) == F.unhex(F.lit("01")), F.concat(F.lit("symbol:sha256:"), F.lower(F.hex(rest)))).otherwise(
        F.decode(rest, "UTF-8")
    )


def usable_points(rows: DataFrame, key: str, vector: str, version: str, width: int) -> DataFrame:
    """(n, id, vector, digest): of each key the row of the latest version, if its vector is usable.

    ``n`` numbers the ids in their order. Rows that tie in the version are ordered by their vectors, so
    the choice doesn't depend on the input's order. One shuffle, by ranges of the id, serves the choice
    of the latest row and the numbering.
    """
    kept = rows.select(F.col(key).alias("id"), F.col(version).alias("at"), F.col(vector).cast("array<float>").alias("vector")).where("id is not null")
    kind = kept.schema["at"].dataType.simpleString()
    fixed = kept.mapInArrow(_fixed_point(width), f"id string, at {kind}, vector binary, digest binary")
    latest = fixed.repartitionByRange("id").groupBy("id").agg(F.max(F.struct("at", "vector", "digest")).alias("row"))
    points = latest.sortWithinPartitions("id").where("row.vector is not null")
    return points.select(F.monotonically_increasing_id().alias("n"), _packed(F.col("id")).alias("id"), "row.vector", "row.digest")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors padded to whole subspaces."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), width).astype(np.float32) / FIXED
    return np.pad(x, ((0, 0), (0, -width % SUB)))


def _checked(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its number of rows is proven small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def fit_index(points: DataFrame, reps: DataFrame, total: int, width: int) -> VectorIndex | None:
    """Fitted on bounded samples; the number of regions follows that of all vectors. None if there are none.

    The driver fits the nodes and codebooks; where a table needs more than TOP regions, every node's
    regions are fitted in a task, on a sample of the node's vectors.
    """
    share = min(1.0, 1.2 * SAMPLE / max(total, 1))
    few = points.select("vector") if total <= SAMPLE else points.select("vector").sample(share, seed=11).limit(SAMPLE)
    sample = _matrix(few.toArrow().column("vector"), width)
    if not len(sample):
        return None
    books = fit_books(sample)
    wanted = max(1, min(MOST_REGIONS, total // REGION))
    nodes = kmeans(sample, min(wanted, TOP, len(sample)), 16)
    if wanted <= TOP:
        return VectorIndex(nodes, nodes, np.arange(len(nodes) + 1), books).with_margin(sample)
    shared = points.sparkSession.sparkContext.broadcast(nodes)
    every = max(REGION, total // MOST_REGIONS)
    share = min(1.0, SAMPLED / every)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                node = (_matrix(batch.column(0), width) @ shared.value.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), batch.column(0)], names=["node", "vector"])

    def split(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vector"), width)
        centres = np.rint(kmeans(x, max(1, min(len(x), round(len(x) / share / every))), 16)[:, :width] * FIXED).astype(np.int16)
        node = np.repeat(table.column("node")[0].as_py(), len(centres))
        return pa.table({"node": pa.array(node, pa.int32()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    members = reps.select("vector").sample(share, seed=13).mapInArrow(assign, "node int, vector binary")
    found = members.groupBy("node").applyInArrow(split, "node int, centre binary").toArrow()
    node = found.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    regions = _matrix(found.column("centre"), width)[order]
    # A node without a sampled vector has no regions; its vectors go to those of the next nodes.
    return VectorIndex(nodes, regions, np.searchsorted(node[order], np.arange(len(nodes) + 1)), books).with_margin(sample)


def _neighbours(rows: DataFrame, key: str, vector: str, version: str, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(n, m, similarity) of the nearest of every point, and (n, id)."""
    spark = rows.sparkSession
    points = stored(usable_points(rows, key, vector, version, width))
    # Copies (equal 128-bit digests of equal fixed-point vectors) are one point. The window keeps the first
    # k + 2 numbers of a group in each task before anything is shuffled.
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("n"))
    first = points.select("n", "digest").withColumn("r", rank).where(F.col("r") <= k + 2)
    groups = first.groupBy("digest").agg(F.array_sort(F.collect_list("n")).alias("first")).where(F.size("first") > 1)
    groups = stored(groups.select("digest", F.col("first")[0].alias("g"), F.slice("first", 1, k + 1).alias("first")))
    copies = points.select("n", "digest").join(_checked(groups.select("digest", "g")), "digest").where("n != g").select("n", "g")
    copies = stored(copies)
    reps = points.select(F.col("n").alias("g"), "vector").join(_checked(copies.select(F.col("n").alias("g"))), "g", "left_anti")
    total = points.count() - copies.count()
    index = fit_index(points, reps, total, width)
    if index is None:
        return spark.createDataFrame([], "n bigint, m bigint, similarity double"), points.select("n", "id")
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            regions, gap = shared.value.nearest(_matrix(batch.column(1), width))
            row, turn = np.nonzero(gap <= shared.value.margin)
            take = pa.array(row)
            columns = [pa.array(regions[row, turn].astype(np.int32)), pa.array(turn.astype(np.int8))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=["g", "vector", "region", "turn"])

    # Every vector with the regions it visits; it belongs to the nearest.
    visits = reps.mapInArrow(assign, "g bigint, vector binary, region int, turn tinyint")
    sizes = visits.groupBy("region").agg(F.ceil(F.count_if(F.col("turn") == 0) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    crowded = stored(sizes.where("blocks > 1 or parts > 1"))
    visits = visits.join(_checked(crowded), "region", "left").withColumns({"blocks": F.greatest(F.coalesce("blocks", F.lit(1)), F.lit(1)), "parts": F.coalesce("parts", F.lit(1))})
    mine, part = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("g", F.lit(1)), F.col("parts")).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.col("part").alias("part"), (F.col("home") & (b == F.col("mine"))).alias("base"), F.lit(True).alias("asks")))
    serves = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("home") & (p != F.col("part"))), lambda p: F.struct(F.col("mine").alias("block"), p.alias("part"), F.lit(True).alias("base"), F.lit(False).alias("asks")))
    visits = visits.withColumns({"mine": mine, "part": part, "home": F.col("turn") == 0})
    visits = visits.select("g", "vector", "region", "turn", F.explode(F.concat(asks, serves)).alias("x")).select("g", "vector", "region", "turn", "x.*")

    found = pa.schema([("g", pa.int64()), ("others", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")  # the cells don't depend on the order of arrival
        x = _matrix(table.column("vector"), width)
        n, turn, base, asks = (table.column(c).to_numpy() for c in ("g", "turn", "base", "asks"))
        base, asks = np.flatnonzero(base), np.flatnonzero(asks)
        q, other, score = scan(shared.value.books, x[base], n[base], x[asks], n[asks], np.array(PROBES)[turn[asks]], k)
        # Each point lists itself too, once, for the sake of its copies.
        itself = np.flatnonzero(np.isin(asks, base))
        q, other = np.concatenate([q, itself]), np.concatenate([other, n[asks[itself]]])
        score = np.concatenate([score, np.ones(len(itself))])
        order = np.argsort(q, kind="stable")
        q, other, score = q[order], other[order], score[order]
        held, begin = np.unique(q, return_index=True)
        offsets = pa.array(np.append(begin, len(q)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (other, score)]
        return pa.Table.from_arrays([pa.array(n[asks[held]]), *lists], schema=found)

    near = visits.groupBy("region", "block", "part").applyInArrow(search, "g bigint, others array<bigint>, scores array<double>")
    near = near.groupBy("g").agg(F.flatten(F.collect_list(F.arrays_zip("scores", "others"))).alias("x"))

    def best(pairs, most: int):
        """The first entries of an array of (score, number) by falling score, then rising number."""
        keyed = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["scores"]).alias("s"), p["others"].alias("o"))))
        return F.slice(keyed, 1, most)

    lists = near.select("g", best(F.col("x"), k + 1).alias("x"))
    # A group of copies stands in a list with its first k + 1 numbers.
    spread = lists.select("g", F.explode("x").alias("x")).select("g", F.col("x.s").alias("s"), F.col("x.o").alias("o"))
    held = _checked(groups.select(F.col("g").alias("o"), "first"))
    spread = spread.join(held, "o", "left").select("g", "s", F.explode(F.coalesce("first", F.array("o"))).alias("o"))
    lists = spread.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "o"))), 1, k + 1).alias("x"))
    lists = stored(lists)  # read twice: for the points and for their copies
    members = lists.select(F.col("g").alias("n"), "x").unionByName(copies.join(lists, "g").select("n", "x"))
    others = F.slice(F.filter("x", lambda e: e["o"] != F.col("n")), 1, k)
    pairs = members.select("n", F.explode(others).alias("x")).select("n", F.col("x.o").alias("m"), (-F.col("x.s")).alias("similarity"))
    return pairs, points.select("n", "id")


def similar_vectors(
    rows: DataFrame,
    key: str = "symbol_id",
    vector: str = "embedding",
    version: str = "indexed_at",
    width: int = 72,
    k: int = 5,
) -> DataFrame:
    """(id, neighbour, similarity): the ``k`` most similar others of every key, by cosine.

    Of several rows of a key the latest version counts; it takes part if its vector has ``width``
    values, all finite and not all zero. Ties go to the smaller id. Copies, whatever their lengths, are searched once: a
    group of equal directions is one point, and its first k + 1 ids stand for it in all lists, which is
    exact. Null ids, null vectors and an empty table give nothing; other columns are ignored.
    """
    pairs, ids = _neighbours(rows, key, vector, version, width, k)
    a = ids.select("n", _unpacked(F.col("id")).alias("id"))
    b = ids.select(F.col("n").alias("m"), _unpacked(F.col("id")).alias("neighbour"))
    return pairs.join(a, "n").join(b, "m").select("id", "neighbour", "similarity")


def neighbour_pairs(rows: DataFrame, key: str = "symbol_id", vector: str = "embedding", version: str = "indexed_at", width: int = 72, k: int = 5) -> DataFrame:
    """(symbol_id_a, symbol_id_b), a < b: one row per pair in which one is among the other's nearest."""
    pairs, ids = _neighbours(rows, key, vector, version, width, k)
    pairs = pairs.select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct()
    a = ids.select(F.col("n").alias("a"), F.col("id").alias("id_a"))
    b = ids.select(F.col("n").alias("b"), F.col("id").alias("id_b"))
    both = pairs.join(a, "a").join(b, "b")
    return both.select(_unpacked(F.col("id_a")).alias("symbol_id_a"), _unpacked(F.col("id_b")).alias("symbol_id_b"))
