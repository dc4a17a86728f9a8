"""Prefix trie of conversations, built as a burst trie.

A trie head is a node that has been split off; under it hangs a container of suffixes: the turns that its
conversations still have to go. All conversations start in the container of the root. A container with more than
``CONTAINER`` turns is burst: the turns that all of its conversations share become a path of nodes, and the next turn id
splits the rest into heads with containers of their own. Bursting is one aggregation and two joins over the turns of
oversized containers only, which Spark can split; a round ends each common path however long it is, so the
number of rounds is the number of forks in a row that oversized containers have. The other containers are dealt
to shards and swept: a container's suffixes are sorted, neighbours compared, and its nodes come out in one
pass over the sorted list. What a subtree holds is then carried up from containers to heads, round by round.

A turn's id is the SHA-256 of role and text, computed where the row is read, so texts never travel. What a task holds is
bounded by ``CONTAINER`` turns. The digest of the conversations that end in a node is taken in one pass over
their sorted ids, in constant memory; as SHA-256 can't be split, the ids of one node go through one task.

Defined results: turns are ordered by turn, null first, and within a turn by their ids; null role or text is
empty. Rows without a conversation id belong to no conversation. A conversation without turns (in ``rebuilt``, one
that the rule leaves none) ends in the root. Repeated turns are turns. Without any conversation there is no node. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.ordering import ordered_prefix, row_numbers
from ticketlens.operators.staging import discard, stage

#: Turns in a container that is swept.
CONTAINER = 20_000
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()
HEAD = ["head", "head_depth"]


def turn_id(role: Column, text: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    text = F.coalesce(text, F.lit(""))
    # The length keeps the border between role and text.
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_of(
    conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"
) -> DataFrame:
    """conv, pos (from 1), tid and chars of every turn."""
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("turn"),
        turn_id(F.col(role_col), F.col(text_col)).alias("tid"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written, so that the row numbers are the same wherever they are read.
    read = stage(rows, "trie_rows")
    out = row_numbers(read, ["turn", "tid", "row"], ["conv"], "pos").select("conv", "pos", "tid", "chars")
    out = stage(out, "trie_turns")
    discard(read)
    return out


def rebuilt(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where the first ``heads`` (``most`` at most) turns of a conversation are those of ``base``.

    What the base has of them replaces the conversation's own.
    """
    convs = turns.filter("pos = 1").select("conv").withColumns({"base": base, "h": heads})
    first = turns.filter(F.col("pos") <= most)
    # A base's few first turns go to the conversations that name it.
    given = stage(
        convs.join(first.withColumnRenamed("conv", "base"), "base")
        .filter(F.col("pos") <= F.col("h"))
        .select("conv", "pos", "tid", "chars"),
        "trie_given",
    )
    taken = given.groupBy("conv").agg(F.count(F.lit(1)).alias("taken"))
    shifted = convs.select("conv", "h").join(taken, "conv", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    own = (
        turns.join(shifted, "conv")
        .filter(F.col("pos") > F.col("h"))
        .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "chars")
    )
    return convs.select("conv"), given.unionByName(own)


# --- sweeping ----------------------------------------------------------------------------------


def _digest(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest() if convs else _NO_ENDS


def sweep(head: int, depth: int, suffixes: list[tuple[list[bytes], int, list[int]]]) -> list[tuple]:
    """Nodes under a head from its (turn ids, conversation, code points) suffixes; the last row sums them up."""
    suffixes.sort(key=lambda s: s[:2])
    # Open nodes: [smallest member, first suffix, children, leaves, saved below, code points, conversations that end]
    path: list[list] = [[head, 0, 0, 0, 0, 0, []]]
    out: list[tuple] = []
    waiting: list[list[int]] = [[]]

    def close(at: int) -> None:
        """Pop the deepest open node; its row gets its parent's name when the parent closes."""
        least, start, children, leaves, saved, chars, ends = path.pop()
        n = at - start
        saved += (n - 1) * chars
        for i in waiting.pop():
            out[i] = (*out[i][:2], least, *out[i][3:])
        up = path[-1]
        up[0] = min(up[0], least) if len(path) > 1 else head
        up[2] += 1
        up[3] += leaves or 1
        up[4] += saved
        waiting[-1].append(len(out))
        out.append((least, depth + len(path), None, n, children, leaves or 1, saved, _digest(ends)))

    before: list[bytes] = []
    for i, (tids, conv, chars) in enumerate(suffixes):
        shared = 0
        for a, b in zip(before, tids, strict=False):
            if a != b:
                break
            shared += 1
        while len(path) > shared + 1:
            close(i)
        for j in range(shared, len(tids)):
            path.append([conv, i, 0, 0, 0, chars[j], []])
            waiting.append([])
        for node in path[1 : shared + 1]:
            node[0] = min(node[0], conv)
        path[-1][6].append(conv)
        before = tids
    while len(path) > 1:
        close(len(suffixes))
    for i in waiting[0]:
        out[i] = (*out[i][:2], head, *out[i][3:])
    _, _, children, leaves, saved, _, _ = path[0]
    return [*out, (head, depth, None, 0, children, leaves, saved, "head")]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of container, conversation and position; a container at a time."""
    schema = pa.schema(
        [pa.field(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in
         ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    )
    key: tuple | None = None
    suffixes: list[tuple[list[bytes], int, list[int]]] = []
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema
        )

    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in (*HEAD, "conv", "tid", "chars")]
        for head, depth, conv, tid, chars in zip(*columns, strict=True):
            if (head, depth) != key:
                if key is not None:
                    done += sweep(*key, suffixes)
                    if len(done) > 50_000:
                        yield batch()
                        done = []
                key, suffixes = (head, depth), []
            if not suffixes or suffixes[-1][1] != conv:
                suffixes.append(([], conv, []))
            suffixes[-1][0].append(tid)
            suffixes[-1][2].append(chars)
    if key is not None:
        done += sweep(*key, suffixes)
    if done:
        yield batch()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the conversations of each node, from rows in order of node and conversation."""
    key, digest = None, None
    for rows in batches:
        out: list[tuple] = []
        for node, depth, conv in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
            if (node, depth) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if out:
            yield _ends_batch(out)
    if key is not None:
        yield _ends_batch([(*key, digest.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    node, depth, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())],
        ["conv_id", "depth", "ends"],
    )


# --- bursting ----------------------------------------------------------------------------------


def _burst(big: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over the turns of oversized containers: (paths, heads, ends, turns of the new containers)."""
    at_pos = (
        big.groupBy(*HEAD, "pos")
        .agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("lo"), F.max("tid").alias("hi"))
        .withColumn("next", F.col("pos") == F.col("head_depth") + 1)
    )
    at_pos = stage(at_pos, "trie_positions")
    members = big.filter(F.col("pos") == F.col("head_depth") + 1).groupBy(*HEAD).agg(F.min("conv").alias("least"))
    all_of = at_pos.filter("next").select(*HEAD, F.col("n").alias("k"))
    fork = (
        at_pos.join(all_of, HEAD)
        .groupBy(*HEAD, "k")
        .agg(
            F.coalesce(
                F.min(F.when((F.col("n") < F.col("k")) | (F.col("lo") != F.col("hi")), F.col("pos"))),
                F.max("pos") + 1,
            ).alias("fork")
        )
        .join(members, HEAD)
        # Where a path was found its end is the parent of what follows.
        .withColumn("above", F.when(F.col("fork") > F.col("head_depth") + 1, F.col("least")).otherwise(F.col("head")))
    )
    fork = stage(fork, "trie_forks")
    forked = stage(big.join(fork, HEAD), f"trie_burst_{turn}")
    paths = stage(
        forked.filter((F.col("conv") == F.col("least")) & (F.col("pos") < F.col("fork"))).select(
            *HEAD, "pos", "chars", "k", "least", "fork"
        ),
        f"trie_paths_{turn}",
    )
    at_fork = forked.filter(F.col("pos") == F.col("fork"))
    heads = stage(
        at_fork.groupBy(*HEAD, "above", "pos", "tid").agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars")
        ),
        f"trie_heads_{turn}",
    )
    moved = stage(
        at_fork.select(*HEAD, "conv", "tid", "last")
        .join(heads.select(*HEAD, "tid", "conv_id", F.col("pos").alias("at")), [*HEAD, "tid"])
        .select("conv", F.col("conv_id").alias("to"), "at", "last"),
        f"trie_moved_{turn}",
    )
    ends = forked.filter((F.col("pos") == F.col("fork") - 1) & F.col("last")).select(
        F.col("least").alias("conv_id"), F.col("pos").alias("depth"), "conv"
    )
    ends = stage(
        ends.unionByName(moved.filter("last").select(F.col("to").alias("conv_id"), F.col("at").alias("depth"), "conv")),
        f"trie_ends_{turn}",
    )
    rest = stage(
        forked.filter(F.col("pos") > F.col("fork"))
        .select("conv", "pos", "tid", "chars", "last")
        .join(moved.select("conv", F.col("to").alias("head"), F.col("at").alias("head_depth")), "conv"),
        f"trie_rest_{turn}",
    )
    discard(at_pos, fork, forked, moved)
    return paths, heads, ends, rest


def _sizes(rows: DataFrame, container: int) -> tuple[DataFrame, bool]:
    big = rows.groupBy(*HEAD).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > container).select(*HEAD)
    big = stage(big, "trie_big")
    return big, not big.isEmpty()


def nodes(convs: DataFrame, turns: DataFrame, container: int = CONTAINER) -> DataFrame:
    """All nodes of the trie of (conv) and their turns (conv, pos, tid, chars); positions run from 1 without a gap."""
    spark = convs.sparkSession
    convs = stage(convs.distinct(), "trie_convs")
    n_all, least = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    if not n_all:
        return spark.createDataFrame([], _NODE)
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    rows = stage(
        turns.join(lengths, "conv").select(
            "conv", "pos", "tid", "chars", (F.col("pos") == F.col("len")).alias("last"),
            F.lit(least).cast("bigint").alias("head"), F.lit(0).cast("bigint").alias("head_depth"),
        ),
        "trie_all",
    )
    turnless = convs.join(rows.filter("pos = 1").select("conv"), "conv", "left_anti")
    root = F.lit(least).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth")
    ends, small, rounds, spent = [turnless.select(*root, "conv")], [], [], [rows]
    while True:
        big, found = _sizes(rows, container)
        if not found:
            small.append(rows)
            break
        small.append(rows.join(big, HEAD, "left_anti"))
        paths, heads, ended, rows = _burst(rows.join(big, HEAD, "left_semi"), len(rounds))
        rounds.append((paths, heads, big))
        ends.append(ended)
        spent.append(rows)

    left = small[0]
    for df in small[1:]:
        left = left.unionByName(df)
    swept = stage(
        left.select(*HEAD, "conv", "pos", "tid", "chars")
        .repartition(*HEAD)
        .sortWithinPartitions(*HEAD, "conv", "pos")
        .mapInArrow(_shard, _NODE),
        "trie_swept",
    )
    inner = swept.filter(F.col("ends_sha256") != "head")
    summed = ["n_children", "n_leaves", "saved_tokens"]
    below = swept.filter(F.col("ends_sha256") == "head").select(
        F.col("conv_id").alias("head"), F.col("depth").alias("head_depth"), *summed
    )
    out = []
    for turn, (paths, heads, big) in reversed(list(enumerate(rounds))):
        sums = below.withColumnsRenamed({"head": "conv_id", "head_depth": "pos"})
        full = stage(
            heads.join(sums, ["conv_id", "pos"], "left").select(
                *HEAD, "above", "conv_id", "pos", "n_convs",
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
            ),
            f"trie_full_{turn}",
        )
        out.append(
            full.select(
                "conv_id", F.col("pos").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", *summed
            )
        )
        under = full.groupBy(*HEAD).agg(
            F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        # A path has one number of members, so what it saves is a difference of running totals.
        run = stage(ordered_prefix(paths, ["pos"], {"to_here": F.col("chars")}, HEAD, "trie_prefix"), f"trie_run_{turn}")
        whole = run.groupBy(*HEAD, "k").agg(F.sum("chars").alias("path"), F.count(F.lit(1)).alias("steps"))
        end = stage(
            big.join(under, HEAD, "left").join(whole, HEAD, "left").select(
                *HEAD,
                F.coalesce("children", F.lit(0)).alias("children"),
                F.coalesce("leaves", F.lit(1)).alias("leaves"),
                F.coalesce("saved", F.lit(0)).alias("saved"),
                F.coalesce("path", F.lit(0)).alias("path"),
                F.coalesce("steps", F.lit(0)).alias("steps"),
                F.coalesce((F.col("k") - 1) * F.col("path"), F.lit(0)).alias("path_saved"),
            ),
            f"trie_below_{turn}",
        )
        is_end = F.col("pos") == F.col("fork") - 1
        out.append(
            run.join(end, HEAD).select(
                F.col("least").alias("conv_id"),
                F.col("pos").alias("depth"),
                F.when(F.col("pos") == F.col("head_depth") + 1, F.col("head")).otherwise(F.col("least")).alias(
                    "parent_conv_id"
                ),
                F.col("k").alias("n_convs"),
                F.when(is_end, F.col("children")).otherwise(1).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                ((F.col("k") - 1) * (F.col("path") - F.col("to_here") + F.col("chars")) + F.col("saved")).alias(
                    "saved_tokens"
                ),
            )
        )
        below = below.unionByName(
            end.select(
                *HEAD,
                F.when(F.col("steps") > 0, 1).otherwise(F.col("children")).alias("n_children"),
                F.col("leaves").alias("n_leaves"),
                (F.col("saved") + F.col("path_saved")).alias("saved_tokens"),
            )
        )
    top = below.filter("head_depth = 0").agg(*[F.sum(c).alias(c) for c in summed]).select(
        *root,
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(n_all).cast("bigint").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    heads = top
    for df in out:
        heads = heads.unionByName(df)
    ended = ends[0]
    for df in ends[1:]:
        ended = ended.unionByName(df)
    digests = (
        ended.repartition("conv_id", "depth")
        .sortWithinPartitions("conv_id", "depth", "conv")
        .mapInArrow(_ends, "conv_id long, depth long, ends string")
    )
    named = heads.join(digests, ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS))
    )
    every = inner.unionByName(named.drop("ends"))
    result = stage(every.select(*[c.split()[0] for c in _NODE.split(", ")]), "trie_nodes")
    discard(*spent, convs, swept, *[t for r in rounds for t in r], *ends[1:])
    return result
