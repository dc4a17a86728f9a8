"""Approximate nearest neighbours by cross-polytope hashing.

Largest inner products are searched as smallest angles: vectors are put into bands of norms (two to an octave), scaled by
the longest of the band and given one more coordinate that fills them up to unit length (left out where all of
a band are equally long). A hash function rotates a unit vector by three rounds of random signs and fast
Hadamard transforms and takes the nearest signed axis. A table's code joins as many functions as give
about ``PER_BUCKET`` vectors a bucket at any size of the corpus; the last one may look at fewer axes. Each of
``TABLES`` tables indexes every vector. A query probes, in every table and band of its dimension, the buckets
whose axes lie nearest to it, in order of what they lose against the nearest, and all vectors in them are reranked
by exact inner products in double precision.

How many buckets are probed is not guessed: for ``SAMPLE`` queries, drawn by hash, the true neighbours
are found by brute force over all vectors, and the number of probes is the least that finds ``RECALL``
of them. If ``MOST_PROBES`` do not, the tables are doubled, twice at most, and then one bucket holds all, which is exact.

Scale: equal vectors are one class, of which the k + 1 smallest ids can matter, and equal queries are
searched once, so a vector that a third of all rows share costs as much as any other. Buckets and probes
meet in parts of ``PART_ROWS`` rows; a bucket with more than ``BLOCK`` vectors or probes is cut into a grid of
blocks that go to different parts. Nothing else caps a bucket.

Defined results: rows whose id or vector is null, or whose vector is empty, zero or holds a null, NaN or infinity, take no
part. Vectors of different dimensions never meet. Rows that repeat id and vector count once; a row with a query's id
and another vector is another row. Ties go to the smaller id. With at most k other rows all of them that were found come. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators.staging import discard, stage

TABLES, PER_BUCKET, SEED = 8, 512, 11
SAMPLE, RECALL, MOST_PROBES = 256, 0.96, 1024
BLOCK, PART_ROWS = 4096, 32_768
#: Relative error of a matrix product against the sum in order; what it can't tell apart is kept.
SLACK = 1e-11


def usable(vector: str) -> Column:
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _norm(vector: str) -> Column:
    """Scaled by the largest component, so that no square overflows."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / most, 2))
    return most * F.sqrt(squares)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


# --- hashing ---------------------------------------------------------------------------------


def _rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Three rounds of random signs and the fast Hadamard transform, of rows padded to a power of two."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, function, n]).choice([-1.0, 1.0], (3, n))
    for row in signs:
        out *= row
        half = 1
        while half < n:
            pairs = out.reshape(len(out), n // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(
                len(x), n
            )
            half *= 2
        out /= np.sqrt(n)
    return out


def axes(bits: int, dim: int) -> list[int]:
    """How many axes each function of a code of so many bits chooses from; both signs count."""
    most = max(0, int(dim - 1).bit_length())
    out = []
    while bits > 0:
        out.append(1 << min(most, bits - 1))
        bits -= 1 + min(most, bits - 1)
    return out


def _unit(x: np.ndarray, top: np.ndarray, flat: bool) -> np.ndarray:
    x = x / top[:, None]
    if flat:
        return x
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def codes(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for f, n in enumerate(axes(bits, x.shape[1])):
        y = _rotated(x, table, f)[:, :n]
        best = np.abs(y).argmax(axis=1)
        out = out * (2 * n) + 2 * best + (y[np.arange(len(y)), best] < 0)
    return out


def probes(x: np.ndarray, table: int, bits: int, most: int) -> np.ndarray:
    """The codes of the ``most`` nearest buckets (all, if fewer), nearest first."""
    loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for f, n in enumerate(axes(bits, x.shape[1])):
        y = _rotated(x, table, f)[:, :n]
        signed = np.stack([y, -y], axis=2).reshape(len(y), 2 * n)
        order = np.argsort(-signed, axis=1, kind="stable")[:, :most]
        lost = np.square(signed.max(axis=1)[:, None] - np.take_along_axis(signed, order, 1))
        # Of two lists in order, a pair can only be among the first ``most`` if its ranks' product is.
        a, b = np.meshgrid(np.arange(loss.shape[1]), np.arange(order.shape[1]), indexing="ij")
        a, b = (r[(a + 1) * (b + 1) <= most] for r in (a, b))
        total = loss[:, a] + lost[:, b]
        joined = code[:, a] * (2 * n) + order[:, b]
        first = np.argsort(total, axis=1, kind="stable")[:, :most]
        loss, code = np.take_along_axis(total, first, 1), np.take_along_axis(joined, first, 1)
    return code


def _groups(*columns: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of the rows that agree in all columns."""
    keys = np.column_stack(columns)
    _, inverse = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(inverse[order])) + 1) if len(order) else []


def _hasher(tables: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, bits, flat = (np.array(batch.column(c)) for c in ("dim", "bits", "flat"))
            top = np.array(batch.column("top"))
            out = np.zeros((batch.num_rows, tables), np.int64)
            for rows in _groups(dim, bits, flat):
                x = matrix(batch.column("vector").take(pa.array(rows)), int(dim[rows[0]]))
                x = _unit(x, top[rows], bool(flat[rows[0]]))
                for t in range(tables):
                    out[rows, t] = codes(x, t, int(bits[rows[0]]))
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel())
            )
            named = [batch.column(c) for c in ("class", "vector", "dim", "band")]
            yield pa.RecordBatch.from_arrays([*named, keys], ["class", "vector", "dim", "band", "codes"])

    return add


def _prober(tables: int, most: int):
    """A row per table and bucket to look into."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                dim, bits, flat = (np.array(batch.column(c)) for c in ("dim", "bits", "flat"))
                for rows in _groups(dim, bits, flat):
                    x = matrix(batch.column("vector").take(pa.array(rows)), int(dim[rows[0]]))
                    x = x / np.abs(x).max(axis=1)[:, None]
                    x = _unit(x / np.linalg.norm(x, axis=1)[:, None], np.ones(len(x)), True)
                    if not flat[rows[0]]:
                        x = np.column_stack([x, np.zeros(len(x))])
                    for t in range(tables):
                        found = probes(x, t, int(bits[rows[0]]), most)
                        take = pa.array(np.repeat(rows, found.shape[1]))
                        named = [batch.column(c).take(take) for c in ("class", "vector", "dim", "band")]
                        yield pa.RecordBatch.from_arrays(
                            [*named, pa.array(np.full(found.size, t, np.int32)), pa.array(found.ravel())],
                            ["class", "vector", "dim", "band", "table", "bucket"],
                        )

    return add


# --- exact inner products ----------------------------------------------------------------------


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in order, so that equal pairs get equal sums everywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, vector row) that may be among a query's k largest products."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
        if s.shape[1] <= k:
            return np.nonzero(np.ones(s.shape, bool))
        least = np.partition(s, -k, axis=1)[:, -k]
        slack = SLACK * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        return np.nonzero(~(s < (least - slack)[:, None]))


def _best(query: np.ndarray, cls: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each query's k best distinct classes."""
    order = np.lexsort((cls, -score, query))
    q, c, s = query[order], cls[order], score[order]
    new = np.ones(len(order), bool)
    new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    order, q = order[new], q[new]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[place < k]


KEY = ["dim", "band", "table", "bucket", "row_block", "probe_block"]
_PAIRS = "query_class long, class long, score double"


def _matcher(k: int):
    def match(data: pa.Table, asked: pa.Table) -> pa.Table:
        keys = np.column_stack([np.r_[np.array(data[c]), np.array(asked[c])] for c in KEY])
        _, inverse = np.unique(keys, axis=0, return_inverse=True)
        own, probing = inverse[: data.num_rows], inverse[data.num_rows :]
        dims = np.r_[np.array(data["dim"]), np.array(asked["dim"])]
        found = []
        for dim in np.unique(dims):
            a, b = (np.flatnonzero(np.array(t["dim"]) == dim) for t in (data, asked))
            x, q = (
                matrix(t["vector"].combine_chunks().take(pa.array(rows)), int(dim))
                for t, rows in ((data, a), (asked, b))
            )
            a, b = a[(i := np.argsort(own[a], kind="stable"))], b[(j := np.argsort(probing[b], kind="stable"))]
            x, q = x[i], q[j]
            ids, qids = np.array(data["class"])[a], np.array(asked["class"])[b]
            for g in np.intersect1d(own[a], probing[b]):
                r0, r1 = np.searchsorted(own[a], [g, g + 1])
                p0, p1 = np.searchsorted(probing[b], [g, g + 1])
                qi, xi = _nearest(q[p0:p1], x[r0:r1], k)
                found.append((qids[p0 + qi], ids[r0 + xi], _product(q[p0 + qi], x[r0 + xi])))
        query, cls, score = (
            np.concatenate(c) if found else np.zeros(0, t)
            for c, t in zip(zip(*found) if found else [()] * 3, (np.int64, np.int64, float), strict=True)
        )
        keep = _best(query, cls, score, k)
        return pa.table({"query_class": query[keep], "class": cls[keep], "score": score[keep]})

    return match


def _brute(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Each batch's nearest vectors of the sampled queries, by brute force."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids = np.array(batch.column("dim")), np.array(batch.column("class"))
            for dim, (qids, q) in sample.items():
                rows = np.flatnonzero(dims == dim)
                if len(rows):
                    x = matrix(batch.column("vector").take(pa.array(rows)), dim)
                    qi, xi = _nearest(q, x, k)
                    score = _product(q[qi], x[xi])
                    keep = _best(qids[qi], ids[rows[xi]], score, k)
                    qi, xi, score = qi[keep], xi[keep], score[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qids[qi]), pa.array(ids[rows[xi]]), pa.array(score)],
                        ["query_class", "class", "score"],
                    )

    return scan


# --- the search --------------------------------------------------------------------------------


def _calibrated(queries: DataFrame, banded: DataFrame, k: int) -> tuple[int, int | None]:
    """(tables, probes) that find RECALL of the sampled queries' true neighbours; probes None: search all."""
    sample = queries.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).collect()
    by_dim = {
        dim: (np.array([r["class"] for r in rows]), np.array([r["vector"] for r in rows], np.float64))
        for dim in {len(r["vector"]) for r in sample}
        if (rows := [r for r in sample if len(r["vector"]) == dim])
    }
    near = Window.partitionBy("query_class").orderBy(F.col("score").desc(), "class")
    # Bounded: SAMPLE queries times k + 1 neighbours.
    true = (
        banded.select("class", "vector", "dim")
        .mapInArrow(_brute(by_dim, k + 1), _PAIRS)
        .withColumn("place", F.row_number().over(near))
        .filter((F.col("place") <= k + 1) & (F.col("query_class") != F.col("class")))
        .join(banded, "class")
        .select("query_class", "vector", "dim", "bits", "flat", "top")
        .collect()
    )
    vectors = {int(c): v for ids, q in by_dim.values() for c, v in zip(ids, q, strict=True)}
    rows = [(r["dim"], r["bits"], r["flat"], vectors[r["query_class"]], r["vector"], r["top"]) for r in true]
    if not rows:
        return TABLES, 1
    for tables in (TABLES, 2 * TABLES, 4 * TABLES):
        rank = np.full(len(rows), MOST_PROBES)
        for kind in {r[:3] for r in rows}:
            at = np.array([i for i, r in enumerate(rows) if r[:3] == kind])
            q = np.array([rows[i][3] for i in at])
            x = _unit(np.array([rows[i][4] for i in at], np.float64), np.array([rows[i][5] for i in at]), kind[2])
            q = q / np.linalg.norm(q, axis=1)[:, None]
            if not kind[2]:
                q = np.column_stack([q, np.zeros(len(q))])
            # One row of probes per query, not per neighbour.
            once, back = np.unique(q, axis=0, return_inverse=True)
            for t in range(tables):
                hit = probes(once, t, kind[1], MOST_PROBES)[back.ravel()] == codes(x, t, kind[1])[:, None]
                first = np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES)
                rank[at] = np.minimum(rank[at], first)
        needed = int(np.sort(rank)[int(np.ceil(RECALL * len(rank))) - 1]) + 1
        if needed <= MOST_PROBES:
            return tables, needed
    return 1, None


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row that ``queries`` selects."""
    spark = rows.sparkSession
    read = rows.filter(usable(vector_col) & F.col(id_col).isNotNull())
    members = stage(
        read.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), queries.alias("asks"))
        .groupBy("id", "vector")
        .agg(F.max("asks").alias("asks")),
        "nearest_members",
    )
    # A class of equal vectors is named by its smallest id and, as ids may repeat, a number.
    classes = stage(
        members.groupBy("vector").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks")).select(
            F.monotonically_increasing_id().alias("class"), "vector", "asks", F.size("vector").alias("dim"),
            _norm("vector").alias("norm"),
        ),
        "nearest_classes",
    )
    schema = T.StructType(
        [
            T.StructField("query_id", rows.schema[id_col].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("vec_id", rows.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if classes.filter("asks").isEmpty():
        return spark.createDataFrame([], schema)
    in_band = F.floor(F.log2("norm") * 2 + 0.5).cast("int")
    bands = stage(
        classes.groupBy("dim", in_band.alias("band")).agg(
            F.greatest(F.lit(1), F.round(F.log2(F.count(F.lit(1)) / PER_BUCKET))).cast("int").alias("bits"),
            F.max("norm").alias("top"),
            (F.min("norm") > F.max("norm") * (1 - 1e-5)).alias("flat"),
        ),
        "nearest_bands",
    )
    banded = classes.withColumn("band", in_band).join(bands, ["dim", "band"])
    asking = classes.filter("asks").select("class", "vector", "dim")
    tables, most = _calibrated(asking, banded, k)
    if most is None:
        bands, most = bands.withColumn("bits", F.lit(0)), 1
        banded = classes.withColumn("band", in_band).join(bands, ["dim", "band"])

    kinds = "class long, vector array<{0}>, dim int, band int".format(
        rows.schema[vector_col].dataType.elementType.simpleString()
    )
    wanted = ["class", "vector", "dim", "band", "bits", "top", "flat"]
    hashed = stage(
        banded.select(*wanted).mapInArrow(_hasher(tables), f"{kinds}, codes array<long>"), "nearest_hashed"
    )
    data = hashed.select("class", "vector", "dim", "band", F.posexplode("codes").alias("table", "bucket"))
    probing = stage(
        asking.join(bands, "dim").select(*wanted).mapInArrow(
            _prober(tables, most), f"{kinds}, table int, bucket long"
        ),
        "nearest_probes",
    )
    bucket = ["dim", "band", "table", "bucket"]
    counts = (
        data.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n_rows"))
        .join(probing.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n_probes")), bucket)
        .filter((F.col("n_rows") > BLOCK) | (F.col("n_probes") > BLOCK))
    )
    hot = stage(
        counts.select(
            *bucket,
            F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("row_blocks"),
            F.ceil(F.col("n_probes") / BLOCK).cast("int").alias("probe_blocks"),
        ),
        "nearest_hot",
    )
    parts = max(1, (tables * hashed.count() + probing.count()) // PART_ROWS)

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one block of its own side and in all of the other's."""
        block = F.pmod(F.xxhash64("class"), F.coalesce(f"{own}s", F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(f"{other}s", F.lit(1)) - 1)
        return (
            df.join(hot, bucket, "left")
            .select("class", "vector", *bucket, block.alias(own), F.explode(every).alias(other))
            .withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int"))
        )

    left, right = placed(data, "row_block", "probe_block"), placed(probing, "probe_block", "row_block")
    pairs = (
        left.groupBy("part")
        .cogroup(right.select("part", "class", "vector", *KEY).groupBy("part"))
        .applyInArrow(_matcher(k + 1), _PAIRS)
    )
    # Of a class, the k + 1 smallest ids: one may be the query itself.
    own = Window.partitionBy("vector").orderBy("id")
    few = members.select("id", "vector").withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k + 1)
    few = few.join(classes.select("class", "vector"), "vector").select(F.col("id").alias("vec_id"), "class")
    near = Window.partitionBy("query_class").orderBy(F.col("score").desc(), "vec_id", "class")
    # A class found in several tables has one score; its best k + 1 rows hold k besides the query.
    lists = stage(
        pairs.dropDuplicates(["query_class", "class", "score"])
        .join(few, "class")
        .withColumn("place", F.row_number().over(near))
        .filter(F.col("place") <= k + 1)
        .select("query_class", "class", "vec_id", "score"),
        "nearest_lists",
    )
    asked = (
        members.filter("asks")
        .join(classes.select("class", "vector"), "vector")
        .select(F.col("id").alias("query_id"), F.col("class").alias("query_class"))
    )
    turn = Window.partitionBy("query_id", "query_class").orderBy(F.col("score").desc(), "vec_id", "class")
    itself = (F.col("class") == F.col("query_class")) & (F.col("vec_id") == F.col("query_id"))
    out = stage(
        asked.join(lists, "query_class")
        .filter(~itself)
        .withColumn("rank", F.row_number().over(turn))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score"),
        "nearest_found",
    )
    discard(members, classes, bands, hashed, probing, hot, lists)
    return out
