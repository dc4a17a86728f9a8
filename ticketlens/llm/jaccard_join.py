"""Near-duplicate classes: an exact Jaccard self-join on word shingles with adaptive prefixes.

**Prefixes.** Tokens (hashed shingles) have one global order, rare first. Two sets whose overlap
is at least o share at least l tokens among the first |set| - o + l of each. A document picks its
own l: a longer prefix costs more postings but asks a partner for more shared tokens, so fewer
candidates are verified. The choice minimises an estimate, postings + their expected partners +
VERIFY_COST * partners / l, from token frequencies. A pair is a candidate if it shares at least
the smaller l of the two. Frequencies only steer cost; any order gives the same links. They come
from a count sketch of ``CELLS`` cells over all documents, whose size does not depend on them.

**Hot groups.** Documents with equal sets are one class. A token that N near copies share would
give N * N / 2 pairs. Instead every class first meets one hub, the class that is most often the
best-connected one of its tokens, if the two share a good part of the prefix. The classes of a
hub are its star, and are verified against it:

* two classes of a star that both link to the hub are connected, and need no look at each other;
* a class that does not link is compared with the rest of its star by *differences from the hub*.
  |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy| for D = symmetric difference with the hub, so a link needs
  a large overlap of the differences, which are small and, inside the star, rare tokens: the
  prefix filter works there, with bounds from the triangle inequality;
* classes of different stars are compared by their prefix tokens. Per token the largest star
  is only met from outside, never with itself.

Every candidate is verified on the whole sets, and links are closed to components by
alternating star operations on written edge tables.

Nothing is sampled or capped: all classes, tokens and pairs that can link are looked at.

Defined results: null and empty texts, and texts without a word, have an empty set, link with
nothing and are their own component; a text with fewer words than a shingle has its whole sequence
as one. Ties and repeated rows fall in one class; a null id counts as larger than all others. An
empty table gives no rows. Other columns of the input are not read. Where rows are kept, one row of
every component stays: the one with the smallest id (null last), then the smallest digest of its
text; of rows that repeat id and text any one. Rows without a word all stay. All columns are kept
but ``_near_id`` and ``_near_text``, names that the operator reserves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import id_text, slices, text_of
from ticketlens.llm.shingles import shingle_sets
from ticketlens.operators.staging import discard, stage

WORDS, PERCENT = 5, 80
#: Cells of the frequency sketch: two megabytes, whatever the corpus.
CELLS = 1 << 18
#: Longest step of the multi-match prefix, and the cost of a verification in postings.
MOST_MATCHES, VERIFY_COST = 12, 8.0
#: A class joins the star of a hub that shares one in so many tokens of its prefix.
STAR_SHARE = 8
#: Tokens of average frequency meet about so many partners.
RARE = 0.05


# --- in the tasks ------------------------------------------------------------------------


def _sketch(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = np.concatenate(shingle_sets(part.column("text"), width))
                cells += np.bincount((tokens % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    return run


def prefix_of(tokens: np.ndarray, load: np.ndarray, base: float, percent: int) -> tuple[int, np.ndarray]:
    """The number of matches a document asks for, and its prefix in the global order."""
    n = len(tokens)
    seen = load[(tokens % np.uint64(CELLS)).astype(np.int64)]
    order = np.lexsort((tokens, seen))
    least = -(-percent * n // 100)
    most = min(MOST_MATCHES, least)
    partners = np.cumsum(np.maximum(seen[order][: n - least + most] - base, RARE))
    matches = np.arange(1, most + 1)
    lengths = n - least + matches
    cost = lengths + partners[lengths - 1] * (1 + VERIFY_COST / matches)
    best = int(np.argmin(cost))
    return best + 1, tokens[order][: lengths[best]]


def _prefixes(
    width: int, percent: int, load: np.ndarray, base: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                found = [prefix_of(s, load, base, percent) if len(s) else (0, s) for s in sets]
                ends = np.cumsum([0] + [len(p) for _, p in found])
                values = np.concatenate([p for _, p in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_digest"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([m for m, _ in found], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                    ],
                    ["doc_id", "text_digest", "n", "digest", "matches", "prefix"],
                )

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                wanted = part.column("digest").to_pylist()
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, wanted, strict=True)]
                ends = np.cumsum([0] + [len(s) for s in sets])
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                    ["cls", "tokens"],
                ).filter(pa.array(same))

    return run


# --- steps of the join -------------------------------------------------------------------


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Overlap that sets of sizes a and b need."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - F.lit(1e-9))


def _slack(a: Column, b: Column, percent: int) -> Column:
    """Tokens that two linked sets of sizes a and b may have apart."""
    return F.floor((a + b) * (100 - percent) / F.lit(100 + percent) + F.lit(1e-9))


def frequency_sketch(rows: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """How often the tokens of each cell occur, and the load of a common cell."""
    counted = rows.select("text").mapInArrow(_sketch(width), "cell int, n bigint")
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    load = np.zeros(CELLS, dtype=np.int64)
    load[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return load, float(np.median(load))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b)."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    enough = both >= _needed(F.size("ta"), F.size("tb"), percent)
    return stage(pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b"), "jaccard_links")


def _hubs(shared: DataFrame, facts: DataFrame) -> DataFrame:
    """(cls, hub): the best-connected class of most of the tokens of each class.

    Only where the two share enough tokens to be candidates, and a good part of the prefix, so
    that the differences inside a star stay small.
    """
    rank = stage(shared.groupBy("cls").agg(F.count(F.lit(1)).alias("rank")), "jaccard_rank")
    ranked = shared.join(rank, "cls")
    heads = stage(
        ranked.groupBy("token").agg(F.max(F.struct("rank", -F.col("cls")))["col2"].alias("minus")), "jaccard_heads"
    )
    met = stage(shared.join(heads, "token").select("cls", (-F.col("minus")).alias("hub")), "jaccard_met")
    times = met.groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = times.filter("cls <> hub").groupBy("cls").agg(
        F.max(F.struct("times", -F.col("hub"))).alias("best")
    ).select("cls", (-F.col("best.col2")).alias("hub"), "best.times")
    best = stage(best, "jaccard_best")
    own = facts.select("cls", "matches", "length")
    other = facts.select(F.col("cls").alias("hub"), F.col("matches").alias("hub_matches"))
    enough = (F.col("times") >= F.least("matches", "hub_matches")) & (
        F.col("times") * STAR_SHARE >= F.col("length")
    )
    return _to_the_last(
        stage(best.join(own, "cls").join(other, "hub").filter(enough).select("cls", "hub"), "jaccard_hubs")
    )


def _to_the_last(hubs: DataFrame) -> DataFrame:
    """Follow hubs of hubs to the last one, so that a group has one star and not many small ones.

    A hub is better connected than its classes (or as well, with a smaller number), so there are
    no circles; every round doubles the steps taken.
    """
    while True:
        further = hubs.select(F.col("cls").alias("hub"), F.col("hub").alias("next"))
        jumped = stage(hubs.join(further, "hub", "left"), "jaccard_hubs")
        hubs = jumped.select("cls", F.coalesce("next", "hub").alias("hub"))
        if jumped.filter("next is not null").isEmpty():
            return hubs


def _stars(hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cls, hub, n, n_hub, linked, and size and head of the difference with the hub, per class with a hub.

    The order of a difference is: tokens that the hub lacks, which few classes share, then those
    of the hub. Only as much of it is kept as a prefix can need.
    """
    own = sets.select("cls", F.col("tokens").alias("t"))
    hub = sets.select(F.col("cls").alias("hub"), F.col("tokens").alias("th"))
    compared = hubs.join(own, "cls").join(hub, "hub").select(
        "cls",
        "hub",
        F.size("t").alias("n"),
        F.size("th").alias("n_hub"),
        F.size(F.array_intersect("t", "th")).alias("common"),
        F.concat(
            F.sort_array(F.array_except("t", "th")), F.sort_array(F.array_except("th", "t"))
        ).alias("away"),
    )
    longest = _slack(F.col("n"), F.floor(100 * F.col("n") / F.lit(percent)), percent) + 1
    linked = F.col("common") >= _needed(F.col("n"), F.col("n_hub"), percent)
    return stage(
        compared.select(
            "cls",
            "hub",
            "n",
            "n_hub",
            linked.alias("linked"),
            F.size("away").alias("size"),
            F.slice("away", 1, longest.cast("int")).alias("away"),
        ),
        "jaccard_stars",
    )


def _members(stars: DataFrame) -> DataFrame:
    """(star, cls, n, linked, size, away): the stars with their hubs, where some class does not link."""
    hubs = stars.groupBy("hub").agg(
        F.first("n_hub").alias("n"),
        F.min(F.when(~F.col("linked"), F.col("size"))).alias("nearest"),
        F.max("n").alias("largest"),
    )
    open_stars = stage(hubs.filter("nearest is not null"), "jaccard_open")
    facts = open_stars.select("hub", "nearest", F.greatest("largest", "n").alias("largest"))
    rays = stars.select("hub", "cls", "n", "linked", "size", "away").join(facts, "hub")
    middles = open_stars.select(
        "hub",
        F.col("hub").alias("cls"),
        "n",
        F.lit(True).alias("linked"),
        F.lit(0).alias("size"),
        F.array().cast("array<bigint>").alias("away"),
        "nearest",
        F.greatest("largest", "n").alias("largest"),
    )
    return stage(rays.unionByName(middles).withColumnRenamed("hub", "star"), "jaccard_members")


def _inside_stars(members: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of one star of which at least one does not link to the hub."""
    # Sizes of partners lie between percent / 100 of n and 100 / percent of it.
    partner = F.least(F.col("largest"), F.floor(100 * F.col("n") / F.lit(percent)))
    slack = _slack(F.col("n"), partner, percent)
    size = F.col("size")
    # A link needs |Da & Db| >= (|Da| + |Db| - slack) / 2, and |Db| >= |Da| - slack. Every set
    # gets one common last token, as differences may also be disjoint.
    as_query = F.greatest(F.lit(0), size - slack)
    as_partner = F.greatest(as_query, F.ceil((F.col("nearest") + size - slack) / 2))

    def prefixes(rows: DataFrame, spared: Column) -> DataFrame:
        length = F.greatest(F.lit(0), size + 1 - spared).cast("int")
        own = F.transform(
            F.slice("away", 1, F.least(length, size)), lambda t: F.struct(t.alias("token"), F.lit(False).alias("last"))
        )
        common = F.array(F.struct(F.lit(0).cast("bigint").alias("token"), F.lit(True).alias("last")))
        tokens = F.when(length > size, F.concat(own, common)).otherwise(own)
        return rows.select("star", "cls", "n", "linked", "size", F.inline(tokens))

    queries = prefixes(members.filter("not linked"), as_query).select(
        "star", "token", "last", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("size").alias("sa")
    )
    partners = prefixes(members, as_partner).select(
        "star", "token", "last", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("size").alias("sb"),
        F.col("linked").alias("fixed"),
    )
    most = F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), percent)
    met = queries.join(partners, ["star", "token", "last"]).filter(
        (F.col("a") != F.col("b"))
        & (F.col("fixed") | (F.col("a") < F.col("b")))
        & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (F.abs(F.col("sa") - F.col("sb")) <= most)
    )
    return met.select("a", "b").distinct()


def _between_stars(shared: DataFrame, facts: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different stars that share enough prefix tokens."""
    star_of = hubs.select("cls", F.col("hub").alias("star"))
    placed = stage(
        shared.join(star_of, "cls", "left")
        .join(facts.select("cls", "n", "matches"), "cls")
        .withColumn("star", F.coalesce("star", "cls")),
        "jaccard_placed",
    )
    sizes = placed.groupBy("token", "star").agg(F.count(F.lit(1)).alias("found"))
    mixed = stage(
        sizes.groupBy("token")
        .agg(F.max(F.struct("found", "star"))["star"].alias("major"), F.count(F.lit(1)).alias("stars"))
        .filter("stars > 1")
        .select("token", "major"),
        "jaccard_mixed",
    )
    open_rows = stage(placed.join(mixed, "token"), "jaccard_crossing")
    minor = open_rows.filter("star <> major").select(
        "token", F.col("cls").alias("x"), F.col("star").alias("sx"), F.col("n").alias("nx"), F.col("matches").alias("mx")
    )
    every = open_rows.select(
        "token", F.col("cls").alias("y"), F.col("star").alias("sy"), F.col("n").alias("ny"), F.col("matches").alias("my"),
        (F.col("star") == F.col("major")).alias("in_major"),
    )
    met = minor.join(every, "token").filter(
        (F.col("sx") != F.col("sy"))
        & (F.col("in_major") | (F.col("x") < F.col("y")))
        & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    )
    return (
        met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .agg(F.count(F.lit(1)).alias("found"), F.first(F.least("mx", "my")).alias("asked"))
        .filter("found >= asked")
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) of every class with an edge (a, b); the root is the smallest class."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = stage(now, "jaccard_edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), "jaccard_low")
        large = stage(
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "jaccard_large"
        )
        low = stage(large.groupBy("a").agg(F.min("b").alias("low")), "jaccard_low")
        hooked = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = stage(hooked.unionByName(low.withColumnRenamed("low", "b")).distinct(), "jaccard_edges")
        # Done when every class has one edge and it leads to a root.
        split = now.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low <> high")
        if split.isEmpty() and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return now.select(F.col("a").alias("cls"), F.col("b").alias("root"))


def text_digest(text: Column) -> Column:
    """Tells texts under one id apart: 16 bytes of their SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_digest, n, digest of the set), and the component of every set.

    A component is its root class, its smallest id and the first of its rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    load, base = frequency_sketch(texts, width)
    rows = stage(
        texts.withColumn("text_digest", text_digest(F.col("text"))).mapInArrow(
            _prefixes(width, percent, load, base),
            f"doc_id {kind}, text_digest binary, n bigint, digest binary, matches int, prefix array<bigint>",
        ),
        "jaccard_rows",
    )
    first_row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_digest")
    all_classes = stage(
        rows.filter("n > 0")
        .groupBy("digest")
        .agg(F.min(first_row).alias("first"), F.first(F.struct("n", "matches", "prefix")).alias("f"))
        .select(F.monotonically_increasing_id().alias("cls"), "digest", "first", "f.*"),
        "jaccard_classes",
    )
    postings = all_classes.select("cls", F.explode("prefix").alias("token"))
    tokens = stage(
        postings.groupBy("token").agg(F.count(F.lit(1)).alias("found")).filter("found > 1").select("token"), "jaccard_tokens"
    )
    shared = stage(postings.join(tokens, "token"), "jaccard_shared")
    # The prefixes have done their work; what follows reads the tables without them.
    members = stage(rows.select("doc_id", "text_digest", "n", "digest"), "jaccard_members")
    classes = stage(
        all_classes.select("cls", "digest", "first", "n", "matches", F.size("prefix").alias("length")), "jaccard_facts"
    )
    discard(rows, all_classes, tokens)
    facts = classes.select("cls", "n", "matches", "length")
    hubs = _hubs(shared, facts)
    crossing = stage(_between_stars(shared, facts, hubs, percent), "jaccard_candidates")

    # Whole sets, only of classes that are verified against another: of the first row of each,
    # known by its id and text, so that rows that share an id do not meet.
    asked = hubs.select("cls").union(hubs.select("hub")).union(crossing.select("a")).union(crossing.select("b"))
    meeting = classes.select(
        "cls", "digest", id_text(F.col("first.doc_id")).alias("_key"), F.col("first.text_digest").alias("_same")
    ).join(asked.distinct(), "cls", "left_semi")
    sets = stage(
        texts.select(id_text(F.col("doc_id")).alias("_key"), text_digest(F.col("text")).alias("_same"), "text")
        .join(meeting, ["_key", "_same"])
        .groupBy("_key", "_same", "cls", "digest")
        .agg(F.first("text").alias("text"))
        .select("cls", "digest", "text")
        .mapInArrow(_sets(width), "cls bigint, tokens array<bigint>"),
        "jaccard_sets",
    )
    stars = _stars(hubs, sets, percent)
    links = stars.filter("linked").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    links = links.unionByName(_verified(_inside_stars(_members(stars), percent), sets, percent))
    links = links.unionByName(_verified(crossing, sets, percent))

    roots = components(links)
    discard(sets)
    rooted = classes.select("cls", "digest", "first").join(roots, "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    rooted = stage(rooted, "jaccard_rooted")
    lowest = stage(rooted.groupBy("root").agg(F.min("first").alias("first")), "jaccard_lowest")
    named = stage(rooted.select("digest", "root").join(lowest, "root").select("digest", "first"), "jaccard_named")
    return members, named


def near_duplicates(
    docs: DataFrame,
    width: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id of the component) of every row."""
    members, named = _grouped(docs, width, percent, id_col, text_col)
    alone = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    grouped = members.filter("n > 0").join(named, "digest").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id")
    )
    return grouped.unionByName(alone)


def kept_documents(
    docs: DataFrame,
    width: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay: one of every component, and all rows without a word."""
    members, named = _grouped(docs, width, percent, id_col, text_col)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_digest") == F.col("first.text_digest"))
    # By id and text: whether the rows go, stay, or stay as one.
    judged = stage(
        members.filter("n > 0")
        .join(named, "digest")
        .groupBy(id_text(F.col("doc_id")).alias("_near_id"), F.col("text_digest").alias("_near_text"))
        .agg(F.bool_or(is_first).alias("stays"), F.count(F.lit(1)).alias("copies")),
        "jaccard_judged",
    )
    keyed = docs.withColumns(
        {"_near_id": id_text(F.col(id_col)), "_near_text": text_digest(text_of(F.col(text_col)))}
    )
    key = ["_near_id", "_near_text"]
    repeated = judged.filter("stays and copies > 1").select(*key)
    out = keyed.join(judged.filter("not stays or copies > 1").select(*key), key, "left_anti")
    # Rows that repeat id and text are dropped down to one where they are read.
    out = out.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates(key))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
