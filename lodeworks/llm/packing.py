"""Documents of varying token length put whole into containers of equal capacity (problem 8).

Bulk-synchronous best fit. Sizes are whole numbers up to the capacity, so sorted documents and sorted gaps fall into
as many classes as the capacity has tokens, whatever the number of documents. Each round sweeps the size classes
from large to small, sends each to the class of the smallest gap that takes it (its successor among the gaps),
settles conflicts by rank - as many documents as there are gaps of that class, the lowest ranks first - updates the
gaps and repeats; what finds no gap opens new containers. The sweep works on class counts and yields intervals of
ranks; the documents themselves are ranked within their class on the cluster and joined to the intervals.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.plans.lineage import cut

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern of the vocabulary. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer whose ranks lie at ``path``, one per worker."""
    if path not in _encodings:
        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of each document, over its whole text. Null and empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, "id long, tokens long")


def pieces(counted: DataFrame, capacity: int) -> DataFrame:
    """(id, part, start, size): a document within the capacity is one piece, a longer one is cut at multiples of it.

    Only documents above the capacity are cut; a document of 0 tokens takes no room and gives no piece. A document
    id that comes several times is several documents.
    """
    starts = F.sequence(F.lit(0), F.col("tokens") - 1, F.lit(capacity).cast("long"))
    cut_up = counted.filter("tokens > 0").select("id", "tokens", F.posexplode(starts).alias("part", "start"))
    return cut_up.select("id", "part", "start", F.least(F.col("tokens") - F.col("start"), F.lit(capacity)).cast("int").alias("size"))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Intervals (size, first rank, number, first container) that place every size class, and the containers used.

    ``counts`` has the number of pieces by size. Containers with the same gap that were filled alike are one run
    of consecutive numbers, split only where a class ends inside it.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []
    rank = dict.fromkeys(counts, 0)
    left = dict(counts)
    out: list[tuple[int, int, int, int]] = []
    containers = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap > 0 and number > 0:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, number))

    for size in sorted(counts, reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at < len(open_gaps):  # the successor: the smallest gap that takes the class
                gap = open_gaps[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
                take = min(number, left[size])
                leave(gap, first + take, number - take)
            else:  # new containers, each filled with as many of the class as it holds
                fit = capacity // size
                take = max(1, left[size] // fit)
                first, gap = containers, capacity
                containers += take
                per = min(fit, left[size])
                for _ in range(per - 1):
                    out.append((size, rank[size], take, first))
                    rank[size] += take
                    left[size] -= take
                    gap -= size
            out.append((size, rank[size], take, first))
            rank[size] += take
            left[size] -= take
            leave(gap - size, first, take)
    return out, containers


def pack(spark: SparkSession, items: DataFrame, capacity: int, chunk: int = 50_000) -> DataFrame:
    """(container, id, part, start, size): every piece in one container, none above ``capacity``.

    Only the number of pieces per size reaches the driver: at most ``capacity`` rows. Ranks within a size class are
    counted per hash bucket of the id first, so that a class with a third of all pieces is spread over many tasks;
    buckets follow the largest class.
    """
    held = cut(items)
    counts = {r["size"]: r["count"] for r in held.groupBy("size").count().collect()}
    if not counts:
        return spark.createDataFrame([], "container long, id long, part int, start long, size int")
    buckets = max(1, max(counts.values()) // chunk)
    spread = held.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).cast("int"))
    local = spread.withColumn("n", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "part")) - 1)
    sizes = spread.groupBy("size", "bucket").count()
    shift = sizes.select(F.col("size").alias("_s"), F.col("bucket").alias("_b"), (F.sum("count").over(Window.partitionBy("size").orderBy("bucket")) - F.col("count")).alias("shift"))
    ranked = local.join(shift, (F.col("size") == F.col("_s")) & (F.col("bucket") == F.col("_b"))).select("id", "part", "start", "size", (F.col("n") + F.col("shift")).alias("rank"))
    placed, _ = plan(counts, capacity)
    # one sorted key for (size, rank): a size has fewer pieces than 2 ** 44
    edges = np.array(sorted(((s << 44) + first, number) for s, first, _, number in placed), np.int64)

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        key = (size.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        k = np.searchsorted(edges[:, 0], key, "right") - 1
        return pd.Series(edges[k, 1] + key - edges[k, 0])

    return ranked.select(container("size", "rank").alias("container"), "id", "part", "start", "size")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents packed by their tokens; one without tokens takes no room and comes with a null container."""
    counted = cut(token_counts(docs, key, text, tokenizer))
    packed = pack(docs.sparkSession, pieces(counted, capacity), capacity)
    none = counted.filter("tokens = 0").select(F.lit(None).cast("long").alias("container"), "id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("size"))
    return packed.unionByName(none)
