"""The prefix trie of conversations, by prefix-doubling naming.

Turns become dense names: equal (role, text), equal name. Aligned blocks of two, four, eight ... turns get dense names in one join round a
power of two, from the names of their halves. A prefix of ``d`` turns splits by the binary digits of ``d`` into aligned blocks, so it is the
prefix that lacks the last of them plus that block; prefixes are named from the largest last block to the smallest, again one join
round a power of two. Equal prefixes then share a name, and a node is a group of rows. Sums over subtrees double their reach each round,
by links to the ancestor 1, 2, 4 ... levels up.

No round needs the rows of one conversation, one turn or one node together: naming sums before its shuffle and joins can be split where
a key is hot. Texts don't leave the first stage; after it their SHA-256 stands for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import discard, map_batches, materialise, numbered

#: Ids that are joined to one piece of text before pieces of a node meet in one task.
PIECE = 4096


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, mark, words): every turn with its place from 0, by ``turn_col`` (null first; equal turns by mark). The mark is the
    SHA-256 of role and text, null as empty; words are runs of other than ASCII white space. Rows without an id take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("mark"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    # A conversation may span many ranges; rows that are equal in all columns are dealt by chance.
    rows, _ = numbered(rows, "trie-turns", F.col("conv"), F.asc_nulls_first("turn"), F.col("mark"), F.rand(1))
    first = rows.groupBy("conv").agg(F.min("number").alias("first"))
    placed = materialise(rows.join(first, "conv").select("conv", (F.col("number") - F.col("first")).alias("place"), "mark", "words"), "trie-places")
    discard(rows)
    return placed


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, length): the number of turns of each conversation."""
    return turns.groupBy("conv").agg(F.count("*").alias("length"))


def share_openings(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with shared openings, as (turns, lengths): the first h turns of conversation ``c - c % every`` (all if it has
    fewer, none if it is absent) and then c's own turns after its first h; h is the unsigned CRC-32 of the decimal c modulo ``most``."""
    own = lengths(turns)
    convs = own.select("conv", "length", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.col("conv") % every).alias("source"))
    sources = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("source"), F.col("length").alias("had"))
    convs = convs.join(sources, "source", "left").withColumn("taken", F.least("h", F.coalesce("had", F.lit(0))))
    convs = materialise(convs.select("conv", "source", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    tails = turns.join(convs.select("conv", "h", "taken"), "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "mark", "words")
    heads = turns.where((F.col("conv") % every == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv", "source")
    heads = heads.join(convs.where("taken > 0").select("conv", "source", "taken"), "source").where("place < taken").select("conv", "place", "mark", "words")
    return tails.unionByName(heads), convs.select("conv", "length")


def _named(rows: DataFrame, keys: list[str], label: str, keep: list[str], start: int = 0) -> tuple[DataFrame, int]:
    """``keep`` of the rows and ``name``, a dense number from ``start`` for each value of ``keys``; and the next free number."""
    names, n = numbered(rows.select(*keys).distinct(), "trie-names", name="name")
    out = materialise(rows.join(names.withColumn("name", F.col("name") + start), keys).select(*keep, "name"), label)
    discard(names)
    return out, start + n


def prefixes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, depth, name) for each prefix of each conversation, the empty one included; equal prefixes share a name, and the stored
    tables it reads. ``turns`` has conv, place and mark."""
    longest = lengths.agg(F.max("length")).first()[0] or 0
    level, _ = _named(turns, ["mark"], "trie-blocks", ["conv", "place"])
    levels = [level]
    while 2 << len(levels) - 1 <= longest:
        left = F.when(F.col("place") % 2 == 0, F.col("name"))
        right = F.when(F.col("place") % 2 == 1, F.col("name"))
        halves = levels[-1].groupBy("conv", F.shiftright("place", 1).alias("place")).agg(F.max(left).alias("a"), F.max(right).alias("b")).where("a is not null and b is not null")
        halves = materialise(halves, "trie-halves")
        level, _ = _named(halves, ["a", "b"], "trie-blocks", ["conv", "place"])
        discard(halves)
        levels.append(level)
    parts = [materialise(lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name")), "trie-prefixes")]
    free, known = 1, parts[0]
    for k in range(len(levels) - 1, -1, -1):
        last = levels[k].where("place % 2 = 0").select("conv", (F.col("place") * (1 << k)).alias("depth"), F.col("name").alias("block"))
        pairs = known.withColumnRenamed("name", "before").join(last, ["conv", "depth"]).select("conv", (F.col("depth") + (1 << k)).alias("depth"), "before", "block")
        pairs = materialise(pairs, "trie-pairs")
        part, free = _named(pairs, ["before", "block"], "trie-prefixes", ["conv", "depth"], free)
        discard(pairs)
        parts.append(part)
        known = known.unionByName(part)
    discard(*levels)
    return known, parts


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, first, piece) of sorted (name, conv): up to PIECE ids of a node in decimals, comma-joined."""
    for batch in batches:
        names, convs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero(np.diff(names)) + 1
        starts = [i for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True) for i in range(a, b, PIECE)]
        ends = [*starts[1:], len(names)]
        text = [",".join(map(str, convs[a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
        yield pa.record_batch([pa.array(names[starts]), pa.array(convs[starts]), pa.array(text, pa.string())], names=["name", "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, digest) of sorted pieces, hashed as they come: a node's list is never held whole."""
    now, state = None, None

    def row(name, digest):
        return pa.record_batch([pa.array(name, pa.int64()), pa.array(digest, pa.string())], names=["name", "digest"])

    for batch in batches:
        done, hexes = [], []
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if name != now:
                if state is not None:
                    done.append(now)
                    hexes.append(state.hexdigest())
                now, state = name, hashlib.sha256(piece.encode())
            else:
                state.update(f",{piece}".encode())
        yield row(done, hexes)
    if state is not None:
        yield row([now], [state.hexdigest()])


def id_digests(ends: DataFrame) -> DataFrame:
    """(name, digest): SHA-256 of the ascending, comma-joined ids ``conv`` of each name. Ids are sorted and joined to pieces by ranges of
    (name, conv), whatever the size of a name; the digest itself is sequential, so a name's pieces meet in one task, which streams them."""
    pieces = ends.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").transform(map_batches, _pieces, "name long, first long, piece string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").transform(map_batches, _digests, "name long, digest string")


def _subtrees(nodes: DataFrame, deepest: int) -> DataFrame:
    """(name, leaves, saved) summed over the subtree of each node; each round doubles the depth that is covered."""
    sums = nodes.select("name", "leaves", "saved")
    up = nodes.where("depth > 0").select("name", F.col("parent").alias("up"))
    reach = 1
    while reach <= deepest:
        more = up.join(sums, "name").select(F.col("up").alias("name"), "leaves", "saved")
        summed = materialise(sums.unionByName(more).groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-sums")
        further = None
        if 2 * reach <= deepest:
            further = materialise(up.join(up.select(F.col("name").alias("up"), F.col("up").alias("top")), "up").select("name", F.col("top").alias("up")), "trie-up")
        if reach > 1:
            discard(sums, up)
        sums, up, reach = summed, further, 2 * reach
    return sums


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves
    (nodes without a child in the subtree, itself included), saved_tokens (summed over the subtree: (members - 1) times the words of the
    node's last turn) and ends_sha256 (of the ascending, comma-joined ids of the members that end there; of the empty text if none do).

    ``turns`` has conv, place (from 0, without gaps), mark and words; ``lengths`` has conv and length for every conversation, those without
    turns too, which are members of the root alone. Equal turns have equal marks. Without conversations there is no node.
    """
    turns, lengths = materialise(turns, "trie-rebuilt"), materialise(lengths, "trie-lengths")
    known, parts = prefixes(turns, lengths)
    groups = known.groupBy("name").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"))
    above = known.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    words = turns.select("conv", (F.col("place") + 1).alias("depth"), "words")
    nodes = groups.join(above, ["conv", "depth"], "left").join(words, ["conv", "depth"], "left")
    nodes = materialise(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))), "trie-groups")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialise(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = _subtrees(nodes, deepest)
    ends = id_digests(lengths.select("conv", F.col("length").alias("depth")).join(known, ["conv", "depth"]))
    found = nodes.select("name", "conv", "depth", "parent", "n_convs", "n_children").join(sums, "name").join(ends, "name", "left")
    found = materialise(found, "trie-found")
    discard(turns, lengths, *parts)
    parents = found.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    digest = F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest()))
    return found.join(parents, "parent", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256")
    )


def brute_force(rows: list[tuple], every: int = 20, most: int = 4) -> list[tuple]:
    """``trie`` of ``share_openings`` by plain loops, for tests: rows are (conv, turn, role, text)."""
    import re
    import zlib
    from collections import defaultdict

    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        source = c - int(c - every * int(c / every))
        whole = turns.get(source, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c, last in who if last))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in who), len(node), parent, len(who), sum(len(x) == len(node) + 1 for x in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out
