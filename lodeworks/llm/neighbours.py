"""Most similar vectors by additive quantisation (problem 2).

A vector is the sum of one codeword from each of several full-dimensional residual codebooks, chosen by beam search;
its reconstruction's norm is stored beside the codes. Scores come from lookup tables of query-codeword products, and
the best by score are ranked again on the exact vectors. The first codebook doubles as the coarse index: a vector is
stored in the cell of its first codeword (beyond ``COARSE`` cells: of its first two) and probes every cell whose wall
is near enough for a partner to stand behind it.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors); every vector is encoded and searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.plans.lineage import cut

#: Vectors the codebooks are fitted on, at most.
SAMPLE = 40_000
#: Codewords of the residual codebooks after the first, and how many such books.
WORDS, BOOKS = 64, 8
#: Vectors a cell holds on average, and the most that one task compares at once; larger cells are split.
CELL, BLOCK = 128, 4_096
#: Codewords of the first book at most; more cells than that are pairs of a first and a second codeword.
COARSE = 4_096
#: Standard deviations of a partner's step that a vector looks beyond the walls of its cell.
SIGMAS = 2.0
BEAM = 4


class Codebooks:
    """``first`` (coarse) and ``rest`` residual codebooks over whole vectors.

    ``spread`` is the number of dimensions the sample effectively fills; ``deep`` says that cells are pairs of codewords.
    """

    def __init__(self, first: np.ndarray, rest: list[np.ndarray], spread: float = 1.0, deep: bool = False):
        self.first, self.rest, self.spread, self.deep = first, rest, spread, deep and bool(rest)
        self.books = [first, *rest]
        self.norms = [np.einsum("kd,kd->k", b, b) for b in self.books]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the reconstructions) of the rows of ``x``, by beam search over the books."""
        n = len(x)
        left = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), np.int32)
        for book, norm in zip(self.books, self.norms):
            b = left.shape[1]
            cost = np.einsum("nbd,nbd->nb", left, left)[:, :, None] - 2 * left.reshape(-1, x.shape[1]).dot(book.T).reshape(n, b, -1) + norm
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            top = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, word = top // len(book), top % len(book)
            rows = np.arange(n)[:, None]
            left = left[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.int32)], axis=2)
        best = np.argmin(np.einsum("nbd,nbd->nb", left, left), axis=1)
        pick = np.arange(n)
        back = x - left[pick, best]
        return codes[pick, best], np.einsum("nd,nd->n", back, back)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The reconstructions of encoded vectors."""
        return sum(b[codes[:, m]] for m, b in enumerate(self.books))

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of each query with each codeword, by book."""
        return [q.dot(b.T) for b in self.books]


def products(books: Codebooks, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Products of queries with reconstructions, by lookups; of the first book only the codewords in use are looked at."""
    used, place = np.unique(codes[:, 0], return_inverse=True)
    total = q.dot(books.first[used].T)[:, place]
    for m in range(1, codes.shape[1]):
        total += np.take(q.dot(books.books[m].T), codes[:, m], axis=1)
    return total


def scores(tables: list[np.ndarray], codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Approximate cosine of unit queries with encoded vectors: summed lookups over the stored norm."""
    total = tables[0][:, codes[:, 0]]
    for m in range(1, len(tables)):
        total += np.take(tables[m], codes[:, m], axis=1)
    return total / np.sqrt(np.maximum(norms, 1e-12))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part.dot(centres.T) - 0.5 * np.einsum("kd,kd->k", centres, centres), axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        groups, at = np.unique(near[order], return_index=True)
        centres[groups] = np.add.reduceat(x[order], at, axis=0) / np.diff([*at, len(x)])[:, None]
    return centres


def fit(x: np.ndarray, cells: int, words: int = WORDS, books: int = BOOKS, seed: int = 7, deep: int = 0) -> Codebooks:
    """Codebooks from sample rows: the residual of each book is what the next is fitted on. ``deep`` words in the second make cells of two books."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    across = np.linalg.eigvalsh(np.cov(x.T) if len(x) > 1 else np.eye(x.shape[1])) if x.shape[1] > 1 else np.ones(1)
    spread = float(across.sum() ** 2 / max((across**2).sum(), 1e-30))
    first = _means(x, cells, 5, rng)
    left = x - first[np.argmax(x.dot(first.T) - 0.5 * np.einsum("kd,kd->k", first, first), axis=1)]
    rest = []
    for size in [*([deep] if deep else []), *[words] * books]:
        part = left[rng.choice(len(left), min(len(left), 8_192), replace=False)]
        book = _means(part, size, 6, rng)
        left = left - book[np.argmax(left.dot(book.T) - 0.5 * np.einsum("kd,kd->k", book, book), axis=1)]
        rest.append(book)
    return Codebooks(first, rest, spread, bool(deep))


def sound(vector: Column, length: int) -> Column:
    """Whether a vector has ``length`` finite entries that are not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == length) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def distinct_vectors(table: DataFrame, key: str, vector: str, group: Column) -> DataFrame:
    """(rep, group, vector, copies): one row per distinct vector of a group under its least key.

    A key with repeated rows counts once; ``copies`` counts keys. Null keys and groups are left out.
    """
    rows = table.select(F.col(key).alias("key"), group.alias("group"), F.col(vector).cast("array<float>").alias("vector")).filter(F.col("key").isNotNull() & F.col("group").isNotNull())
    return rows.groupBy("group", "vector").agg(F.min("key").alias("rep"), F.count_distinct("key").alias("copies"))


def members(table: DataFrame, key: str, vector: str, group: Column, vectors: DataFrame) -> DataFrame:
    """(rep, key): every key under the representative of its exact vector, for the ``vectors`` given.

    An equi-join on the vector, whose hot keys the adaptive plan splits; no task holds a whole class of copies.
    """
    rows = table.select(F.col(key).alias("key"), group.alias("_g"), F.col(vector).cast("array<float>").alias("_v")).filter(F.col("key").isNotNull() & F.col("_g").isNotNull()).distinct()
    reps = vectors.select("rep", "group", "vector")
    return rows.join(reps, (F.col("_g") == F.col("group")) & (F.col("_v") == F.col("vector"))).select("key", "rep")


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float32) if len(rows) else np.zeros((0, 1), np.float32)
    x64 = x.astype(np.float64)
    return (x64 / np.maximum(np.sqrt(np.einsum("nd,nd->n", x64, x64)), 1e-300)[:, None]).astype(np.float32)


def codebooks(vectors: DataFrame, cell: int = CELL, sample: int = SAMPLE, words: int = WORDS, books: int = BOOKS) -> Codebooks | None:
    """Codebooks fitted on at most ``sample`` of the vectors. The number of cells is in proportion to the vectors: up to
    ``COARSE`` codewords (an eighth of the sample), and beyond that pairs with the words of the second book, of which there are as many as it takes.
    """
    n = vectors.count()
    if not n:
        return None
    part = vectors if n <= sample else vectors.filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * sample / n * 1.1) + 1)
    x = _unit(part.select("vector").limit(sample).toPandas()["vector"])
    cells, coarse = max(1, n / cell), min(len(x) / 8 + 1, COARSE)
    if cells <= coarse:
        return fit(x, int(cells), words, books)
    return fit(x, int(coarse), words, books, deep=int(min(np.ceil(cells / coarse), len(x) / 8 + 1)))


SIDES = "side int, cell long, part int, id long, group string, data binary, scale float"
PAIRS = "rep string, other string, similarity double"


def margin(books: Codebooks, least: float) -> float:
    """How far beyond the wall of its own cell a vector looks for partners of at least ``least`` cosine.

    Two unit vectors that similar lie ``sqrt(2 - 2 least)`` apart; in ``books.spread`` effective dimensions that step has
    this share of it, times ``SIGMAS``, along the normal of any one wall.
    """
    return SIGMAS * float(np.sqrt(2 - 2 * least) / np.sqrt(max(1.0, books.spread)))


def _walls(x: np.ndarray, centres: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance of each row to the wall between its nearest centre and each other one)."""
    cost = norms - 2 * x.dot(centres.T)
    own = np.argmin(cost, axis=1)
    apart = np.sqrt(np.maximum(norms + norms[own][:, None] - 2 * centres[own].dot(centres.T), 1e-9))
    return own, (cost - cost[np.arange(len(x)), own][:, None]) / (2 * apart)


def cells_of(books: Codebooks, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own cell of each row, row, cell): every cell within ``reach`` of each row, its own among them.

    A cell is a codeword of the first book or, where ``books.deep``, one of the first and one of the second.
    """
    own, rows, cells = [], [], []
    for at in range(0, len(x), 1_024):
        part = x[at : at + 1_024]
        first, wall = _walls(part, books.first, books.norms[0])
        r, c = np.nonzero(wall <= reach)
        if not books.deep:
            own.append(first)
            rows.append(r + at)
            cells.append(c)
            continue
        second, deep = _walls(part[r] - books.first[c], books.books[1], books.norms[1])
        mine = np.flatnonzero(c == first[r])
        own.append(first * len(books.books[1]) + second[mine])
        k, w = np.nonzero(deep <= reach)
        rows.append(r[k] + at)
        cells.append(c[k] * len(books.books[1]) + w)
    return np.concatenate(own), np.concatenate(rows), np.concatenate(cells)


def reachable(x: np.ndarray, back: np.ndarray, least: float) -> np.ndarray:
    """The least product with the reconstruction ``back`` that a unit query of cosine ``least`` or more with ``x`` can have.

    The query is cos times x plus sin times a unit vector across; the residual's part along x is known, and what is
    left of it bounds the rest. No query is lost by leaving out products below.
    """
    left = x.astype(np.float64) - back
    along = np.einsum("nd,nd->n", x, left)
    across = np.sqrt(np.maximum(np.einsum("nd,nd->n", left, left) - along**2, 0))
    return np.minimum(least * (1 - along) - np.sqrt(1 - least**2) * across, 1 - along) - 1e-5


def _packed(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Rows as signed bytes with one scale each: what a probe carries to the cells."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
    return [r.tobytes() for r in np.rint(x / scale[:, None]).astype(np.int8)], scale.astype(np.float32)


def pairs_within(spark, vectors: DataFrame, least: float, books: Codebooks | None = None, partitions: int | None = None) -> DataFrame:
    """(rep, other, similarity), rep < other: the distinct vectors of one group with at least ``least`` cosine.

    Every vector is stored in its own cell and probes all cells within ``margin`` of it, as eight-bit numbers. In a
    cell each probe is scored by lookup against the codes, and every candidate that the bound of ``reachable`` leaves
    is compared with the stored vector; no number of candidates or partners is fixed. What may pass is ranked on both
    exact vectors, fetched by an equi-join on ids. Cells above ``BLOCK`` vectors are split into parts by a hash of the
    id, and what probes such a cell probes all its parts, so that no task holds an unbounded cell.
    """
    books = books or codebooks(vectors)
    if books is None:
        return spark.createDataFrame([], PAIRS)
    if "id" not in vectors.columns:
        vectors = cut(vectors.withColumn("id", F.monotonically_increasing_id()))
    reach = margin(books, least)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 4_096):
                part = b.iloc[at : at + 4_096]
                x = _unit(part["vector"])
                own, row, cell = cells_of(books, x, reach)
                data, scale = _packed(x)
                ids, groups = part["id"].to_numpy(), part["group"].to_numpy()
                yield pd.DataFrame({"side": np.repeat(np.array([0, 1], np.int32), [len(x), len(row)]), "cell": np.concatenate([own, cell]), "part": np.int32(0), "id": np.concatenate([ids, ids[row]]), "group": np.concatenate([groups, groups[row]]), "data": [v.tobytes() for v in x] + [data[r] for r in row], "scale": np.concatenate([np.zeros(len(x), np.float32), scale[row]])})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _by_cell(batches):
            base, asked = block[block["side"] == 0], block[block["side"] == 1]
            if not len(base) or not len(asked):
                continue
            x = np.frombuffer(b"".join(base["data"]), np.float32).reshape(len(base), -1)
            codes, _ = books.encode(x)
            back = books.decode(codes)
            floor, size = reachable(x, back, least), np.sqrt(np.einsum("nd,nd->n", back, back))
            ids, groups = base["id"].to_numpy(), base["group"].to_numpy()
            for at in range(0, len(asked), 512):
                part = asked.iloc[at : at + 512]
                scale = part["scale"].to_numpy()
                q = np.frombuffer(b"".join(part["data"]), np.int8).reshape(len(part), -1).astype(np.float32) * scale[:, None]
                blur = scale * np.float32(0.5 * np.sqrt(q.shape[1]) * 1.001)  # the most that rounding took
                row, col = np.nonzero(products(books, q, codes) >= floor - blur[:, None] * size)
                mine, their = part["id"].to_numpy()[row], ids[col]
                keep = (mine != their) & (part["group"].to_numpy()[row] == groups[col])
                row, col, mine, their = row[keep], col[keep], mine[keep], their[keep]
                for k in range(0, len(row), 1 << 16):
                    r, c = row[k : k + (1 << 16)], col[k : k + (1 << 16)]
                    near = np.einsum("nd,nd->n", q[r], x[c]) >= least - blur[r] - 1e-5
                    yield pd.DataFrame({"a": np.minimum(mine[k : k + (1 << 16)], their[k : k + (1 << 16)])[near], "b": np.maximum(mine[k : k + (1 << 16)], their[k : k + (1 << 16)])[near]})

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.einsum("nd,nd->n", _unit(b["x"]).astype(np.float64), _unit(b["y"]).astype(np.float64))
            keep = s >= least - 1e-7
            first, second = b["ra"][keep].to_numpy(object), b["rb"][keep].to_numpy(object)
            turn = np.array([p > q for p, q in zip(first, second)], bool)
            yield pd.DataFrame({"rep": np.where(turn, second, first), "other": np.where(turn, first, second), "similarity": s[keep]})

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, count = np.unique(cells_of(books, _unit(b["vector"]), 0.0)[0], return_counts=True)
            yield pd.DataFrame({"cell": cell, "n": count})

    placed = vectors.select("id", F.col("group").cast("string").alias("group"), "vector").mapInPandas(place, SIDES)
    stored = vectors.select("vector").mapInPandas(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("count"))
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = _split_cells(placed, stored)
    found = sized.repartition(n, "cell", "part").sortWithinPartitions("cell", "part").mapInPandas(search, "a long, b long").distinct()
    left = vectors.select(F.col("id").alias("a"), F.col("rep").alias("ra"), F.col("vector").alias("x"))
    right = vectors.select(F.col("id").alias("b"), F.col("rep").alias("rb"), F.col("vector").alias("y"))
    return found.join(left, "a").join(right, "b").select("ra", "rb", "x", "y").mapInPandas(rank, PAIRS)


def _split_cells(placed: DataFrame, stored: DataFrame) -> DataFrame:
    """Cells with more than ``BLOCK`` stored vectors, by the counts of ``stored``, in parts.

    There are at most as many such cells as vectors / ``BLOCK``; they are counted and broadcast while they are few.
    """
    sizes = cut(stored.filter(F.col("count") > BLOCK).select(F.col("cell").alias("_cell"), F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    few = sizes.count() <= 1_000_000
    joined = placed.join(F.broadcast(sizes) if few else sizes, F.col("cell") == F.col("_cell"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    to = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return joined.select("side", "cell", F.explode(to).alias("part"), "id", "group", "data", "scale")


def _by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (cell, part) blocks from batches sorted by them."""
    held: list[pd.DataFrame] = []
    for b in batches:
        while len(b):
            last = (b["cell"].iat[-1], b["part"].iat[-1])
            if held and (held[0]["cell"].iat[0], held[0]["part"].iat[0]) != (b["cell"].iat[0], b["part"].iat[0]):
                yield pd.concat(held)
                held = []
            edge = np.flatnonzero(((b["cell"] != b["cell"].iat[0]) | (b["part"] != b["part"].iat[0])).to_numpy())
            if not len(edge):
                held.append(b)
                break
            held.append(b.iloc[: edge[0]])
            yield pd.concat(held)
            held, b = [], b.iloc[edge[0] :]
            del last
    if held:
        yield pd.concat(held)


def nearest(spark, vectors: DataFrame, queries: DataFrame, k: int, books: Codebooks | None = None, rerank: int = 30) -> DataFrame:
    """(rep, other, similarity): for each query vector its k most similar of the same group among all vectors.

    The queries are a stated set, read to the driver in blocks of 20,000; each block passes once over all vectors,
    which are encoded, scored by lookup and reranked where they lie. Only the k best of each part are shuffled.
    """
    books = books or codebooks(vectors, words=256)
    asked = queries.select("rep", F.col("group").cast("string").alias("group"), "vector").toLocalIterator()
    out, block = None, []

    def add(out: DataFrame | None, block: list) -> DataFrame:
        names, groups = np.array([r[0] for r in block], object), np.array([r[1] for r in block], object)
        q = _unit(pd.Series([r[2] for r in block]))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _unit(b["vector"])
                codes, norms = books.encode(x)
                other, group = b["rep"].to_numpy(), b["group"].to_numpy()
                take = min(len(x), k * rerank)
                for at in range(0, len(q), 256):
                    part = q[at : at + 256]
                    s = scores(books.tables(part), codes, norms)
                    s[groups[at : at + 256, None] != group[None, :]] = -9
                    s[names[at : at + 256, None] == other[None, :]] = -9
                    top = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
                    exact = np.einsum("qd,qtd->qt", part.astype(np.float64), x[top].astype(np.float64))
                    exact[np.take_along_axis(s, top, 1) <= -9] = -9
                    best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(part)), best.shape[1])
                    col = best.ravel()
                    keep = exact[row, col] > -9
                    yield pd.DataFrame({"rep": names[at + row[keep]], "other": other[top[row[keep], col[keep]]], "similarity": exact[row[keep], col[keep]]})

        found = vectors.select("rep", F.col("group").cast("string").alias("group"), "vector").mapInPandas(scan, PAIRS)
        return found if out is None else out.unionByName(found)

    for r in asked:
        block.append(r)
        if len(block) == 20_000:
            out, block = add(out, block), []
    if block:
        out = add(out, block)
    if out is None or books is None:
        return spark.createDataFrame([], PAIRS + ", rank int")
    w = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
