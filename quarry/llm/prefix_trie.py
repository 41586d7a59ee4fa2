"""The prefix trie of conversations: which first turns they share, and what sharing saves.

A turn is (role, text), told by the first 128 bits of the SHA-256 of both; texts themselves are never shuffled. A conversation is the array of its turns.
The arrays are sorted by ranges over the whole table, equal ones by conv_id, so that a group of copies, however large, is spread over as many partitions as
its size asks for. Each partition is swept once: the stack holds the nodes of the array at hand, the LCP with the next array says which of them are
closed, and what a node has gathered (members, children, leaves, saved words) goes to its parent then. Memory is one path.

Nodes on a partition's first or last path may go on in its neighbours and stay open. Their open stacks are stitched: FAN_IN neighbours are merged from left to right by the LCP of
one's last path and the next one's first, round by round until one stack is left. A node's parent is known by its smallest member only after the
parent is closed; partitions are therefore read back from their last node to their first, when parents come before their children.

The ids that end at a node are hashed as they come; the first and last array of a partition leave theirs in blocks of BLOCK ids, which are strung together in order
for each node. Nodes are named by (smallest member, depth); stitched ones meanwhile by a 128-bit hash chained over their turns.

A null role or text counts as empty. Turns follow their numbers, null first, then the hash of role and text. Repeated rows are turns of their own. Rows
without a conversation id are no conversation and are left out. An empty table gives no rows; extra columns are ignored. A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of, prepare, stored

FAN_IN, BLOCK, TASK_MB, BATCH = 64, 8192, 32.0, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [c.split()[0] for c in NODE.split(", ")]
_PIECE = "struct<n:long,least:long,children:long,leaves:long,saved:long,words:long,ends:string>"
#: What sweeps and stitching rounds give: nodes, places of open nodes, blocks of ids, open stacks.
SWEPT = f"kind string, part long, seq long, {NODE}, key binary, parent binary, ids string, first_path array<binary>, last_path array<binary>, shared long, left_pieces array<{_PIECE}>, right_pieces array<{_PIECE}>"
_INT, _TEXT, _PATH = pa.int64(), pa.string(), pa.list_(pa.binary())
_PIECES = pa.list_(pa.struct([(c, _TEXT if c == "ends" else _INT) for c in ("n", "least", "children", "leaves", "saved", "words", "ends")]))
SCHEMA = pa.schema([
    ("kind", _TEXT), ("part", _INT), ("seq", _INT), *((c, _TEXT if c == "ends_sha256" else _INT) for c in NAMES), ("key", pa.binary()), ("parent", pa.binary()), ("ids", _TEXT),
    ("first_path", _PATH), ("last_path", _PATH), ("shared", _INT), ("left_pieces", _PIECES), ("right_pieces", _PIECES),
])


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, path, words: the hashes of a conversation's turns in order and the number of words of their texts."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda x: x["digest"]).alias("path"), F.transform("t", lambda x: x["words"]).alias("words"))


def with_shared_starts(convs: DataFrame, source: Column, head: Column, most: int) -> DataFrame:
    """Conversations that begin with the first `head` (at most `most`) turns of another one, if there is such, and go on with their own turns after as many."""
    heads = convs.select(F.col("conv_id").alias("_source"), F.slice("path", 1, most).alias("_path"), F.slice("words", 1, most).alias("_words"))
    joined = convs.join(heads, source == F.col("_source"), "left")

    def spliced(own: str) -> Column:
        start, rest = F.slice(F.col(f"_{own}"), F.lit(1), head), F.slice(F.col(own), head + 1, F.size(own))
        return F.when(F.col("_source").isNull(), rest).otherwise(F.concat(start, rest)).alias(own)

    return joined.select("conv_id", spliced("path"), spliced("words"))


@dataclass
class Piece:
    """What a node has gathered so far: its members, the smallest one, closed children, their leaves and what their subtrees save; the words of its turn; who ends there."""

    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    words: int = 0
    ends: str | None = None

    def count(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def merge(self, other: Piece) -> None:
        """The same node in the next segment."""
        self.count(other.n, other.least)
        self.children, self.leaves, self.saved, self.ends = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved, self.ends or other.ends

    def close_into(self, parent: Piece | None) -> tuple:
        """Its row of NODE but for the depth; the parent gathers it."""
        leaves, saved = self.leaves if self.children else 1, self.saved + (self.n - 1) * self.words
        if parent is not None:
            parent.count(self.n, self.least)
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        return self.least, self.n, self.children, leaves, saved, self.ends


def chained(path: list[bytes]) -> list[bytes]:
    """A name for every prefix of a path."""
    out, last = [], b""
    for turn in path:
        last = hashlib.blake2b(last + turn, digest_size=16).digest()
        out.append(last)
    return out


def lcp(a: list[bytes], b: list[bytes]) -> int:
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


@dataclass
class Stack:
    """A run of sorted paths: the nodes of the last one, from the root, and those nodes of the first one that only the left neighbour can still share.

    `closed` is called with (path, depth, row) of a node that is complete, `left_open` with a depth when a node of the first path leaves the stack.
    """

    closed: object
    left_open: object = None
    first: list[bytes] | None = None
    path: list[bytes] = field(default_factory=list)
    shared: int = 0  # so many turns the first and the last path have in common
    right: list[Piece] = field(default_factory=lambda: [Piece()])
    left: list[Piece] = field(default_factory=list)  # of the first path, from its end to depth shared + 1

    def shrink(self, depth: int) -> None:
        """The run goes on with paths that share only `depth` turns with the last one."""
        while len(self.path) > depth:
            d, piece = len(self.path), self.right.pop()
            if d <= self.shared:
                self.left.append(piece)
                self.shared = d - 1
                if self.left_open is not None:
                    self.left_open(d)
            else:
                self.closed(self.path, d, piece.close_into(self.right[-1]))
            self.path.pop()

    def add(self, path: list[bytes], words: list[int], conv: int) -> None:
        """The next conversation."""
        if self.first is None:
            self.first, self.shared, k = path, len(path), 0
        else:
            k = lcp(self.path, path)
            self.shrink(k)
        self.path += path[k:]
        self.right += [Piece(words=w) for w in words[k:]]
        self.right[-1].count(1, conv)

    def follow(self, other: Stack) -> None:
        """The next run, whose paths are not before this one's."""
        if self.first is None:
            self.first, self.path, self.shared, self.right, self.left = other.first, other.path, other.shared, other.right, other.left
            return
        m = lcp(self.path, other.first)
        self.shrink(m)
        pieces = other.right[: other.shared + 1] + other.left[::-1]  # of its first path, by depth
        for d in range(len(other.first), max(m, other.shared), -1):
            self.closed(other.first, d, pieces[d].close_into(pieces[d - 1]))
        for d in range(m + 1):
            self.right[d].merge(pieces[d])
        k = min(m, other.shared)
        self.shrink(k)
        self.path[k:] = other.path[k:]
        self.right[k + 1 :] = other.right[k + 1 :]

    def finish(self) -> None:
        """No neighbours are left."""
        self.shrink(0)
        for d, piece in zip(range(len(self.first), 0, -1), self.left, strict=True):
            self.closed(self.first, d, piece.close_into(self.left[len(self.first) - d + 1] if d > 1 else self.right[0]))
        self.closed([], 0, self.right[0].close_into(None))


def _batches(rows):
    """Rows in record batches of SWEPT."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, SCHEMA)


def _open_row(stack: Stack, part: int) -> dict:
    show = lambda pieces: [vars(p) for p in pieces]
    return dict(kind="open", part=part, first_path=stack.first, last_path=stack.path, shared=stack.shared, left_pieces=show(stack.left), right_pieces=show(stack.right))


def _node(depth: int, row: tuple) -> dict:
    least, n, children, leaves, saved, ends = row
    return dict(depth=depth, conv_id=least, n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=ends)


def sweep(part: int, convs):
    """Rows of SWEPT from one partition's sorted (path, words, conv_id): its nodes children first, open ones as places with their key, blocks of ids, and its open stack."""
    out, places = [], 0

    def emit(kind: str, **row) -> None:
        nonlocal places
        out.append(dict(kind=kind, part=part, seq=places, **row))
        places += 1

    stack = Stack(lambda path, d, row: emit("node", **_node(d, row)), lambda d: emit("place", depth=d, key=names[d - 1]))
    digest, ids, names = None, [], []

    def block() -> None:
        if not ids:
            return
        key = chained(stack.path)[-1] if stack.path else b""
        out.append(dict(kind="ids", part=part, key=key, conv_id=ids[0], ids=",".join(map(str, ids))))
        ids.clear()

    for path, words, conv in convs:
        if stack.first is None:
            names = chained(path)
        elif path == stack.path:
            digest.update(b",")
        else:  # the array before was the last of its kind: blocks of an inner one are not needed
            if stack.path == stack.first:
                block()
            else:
                stack.right[-1].ends = digest.hexdigest()
            ids.clear()
            digest = None
        digest = digest or hashlib.sha256()
        digest.update(str(conv).encode())
        stack.add(path, words, conv)
        ids.append(conv)
        if len(ids) == BLOCK:
            block()
        yield from out
        out.clear()
    if stack.first is None:
        return
    block()
    last = chained(stack.path)
    for d in range(len(stack.path), -1, -1):
        emit("place", depth=d, key=last[d - 1] if d else b"")
    stack.first, stack.path = names, last
    out.append(_open_row(stack, part))
    yield from out


def stitch(part: int, stacks, final: bool):
    """Rows of SWEPT from neighbouring open stacks in order: the nodes that are closed between them, and the open stack of all of them unless they are the last."""
    out = []
    name = lambda path, d: path[d - 1] if d else b""
    merged = Stack(lambda path, d, row: out.append(dict(kind="node", part=part, key=name(path, d), parent=name(path, d - 1) if d else None, **_node(d, row))))
    for s in stacks:
        merged.follow(s)
        yield from out
        out.clear()
    if final:
        merged.finish()
    else:
        out.append(_open_row(merged, part))
    yield from out


def _stack_of(row: dict) -> Stack:
    pieces = lambda c: [Piece(**p) for p in row[c]]
    return Stack(None, None, row["first_path"], row["last_path"], row["shared"], pieces("right_pieces"), pieces("left_pieces"))


def swept(convs: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        def rows():
            for b in batches:
                yield from zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_pylist(), strict=True)

        yield from _batches(sweep(TaskContext.get().partitionId(), rows()))

    ranged = convs.select("conv_id", "path", "words").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return stored(ranged.mapInArrow(run, SWEPT), "trie-swept")


def stitched(opened: DataFrame, parts: int) -> list[DataFrame]:
    """The nodes that went over partition boundaries, by round."""
    rounds = []
    while True:
        final, group = parts <= FAN_IN, F.floor(F.col("part") / FAN_IN).cast("long")

        def run(batches, final=final):
            def stacks():
                for b in batches:
                    yield from b.to_pylist()

            def by_group():
                held, at = [], None
                for row in stacks():  # at most FAN_IN stacks of one group
                    if at is not None and row["joined"] != at:
                        yield from stitch(at, map(_stack_of, held), final)
                        held = []
                    at = row["joined"]
                    held.append(row)
                if held:
                    yield from stitch(at, map(_stack_of, held), final)

            yield from _batches(by_group())

        dealt = opened.select("part", "first_path", "last_path", "shared", "left_pieces", "right_pieces", group.alias("joined"))
        dealt = dealt.repartition(-(-parts // FAN_IN), "joined").sortWithinPartitions("joined", "part")
        done = stored(dealt.mapInArrow(run, SWEPT), "trie-stitched")
        rounds.append(done.filter("kind = 'node'"))
        if final:
            return rounds
        opened, parts = done.filter("kind = 'open'"), -(-parts // FAN_IN)


def strung(blocks: DataFrame, parts: int) -> DataFrame:
    """key, ends_sha256 from blocks of ids (key, conv_id, ids): the digest of all ids of a key in ascending order. A task reads one block at a time."""

    def run(batches):
        key, digest, keys, ends = None, None, [], []
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is not None and k == key:
                    digest.update(b",")
                else:
                    if digest is not None:
                        keys.append(key), ends.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256()
                digest.update(ids.encode())
        if digest is not None:
            keys.append(key), ends.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends"])

    return blocks.select("key", "conv_id", "ids").repartition(parts, "key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(run, "key binary, ends string")


def under_parents(rows: DataFrame, parts: int) -> DataFrame:
    """Inner nodes with parent_conv_id, from each partition's nodes and open nodes (part, seq, NODE, key): read backwards, parents come first."""

    def run(batches):
        above, at = [], None
        for b in batches:
            cols = b.to_pydict()
            parents = []
            for part, depth, conv in zip(cols["part"], cols["depth"], cols["conv_id"], strict=True):
                if part != at:
                    at, above = part, []
                parents.append(above[depth - 1] if depth else None)
                above[depth:] = [conv]
            inner = pa.array([k is None for k in cols["key"]], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in NAMES), pa.array(parents, pa.int64())], [*NAMES, "parent_conv_id"]).filter(inner)

    ordered = rows.repartition(parts, "part").sortWithinPartitions(F.col("part"), F.col("seq").desc())
    return ordered.select("part", *NAMES, "key").mapInArrow(run, f"{NODE}, parent_conv_id long")


def trie(convs: DataFrame, task_mb: float = TASK_MB, parts: int | None = None) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of conversations (conv_id, path, words)."""
    prepare(convs.sparkSession)
    convs = stored(convs, "trie-conversations")
    found = swept(convs, parts or parts_of(convs, task_mb, 2))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    open_nodes = None
    for part in stitched(found.filter("kind = 'open'"), parts):
        open_nodes = part if open_nodes is None else open_nodes.unionByName(part)
    ends = strung(found.filter("kind = 'ids'"), parts)
    open_nodes = open_nodes.select(*NAMES, "key", "parent").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "ends")).drop("ends")
    open_nodes = stored(open_nodes, "trie-open")  # a path for each partition boundary
    above = open_nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    outer = open_nodes.join(above, "parent", "left").select(*NAMES, "parent_conv_id")
    places = found.filter("kind = 'place'").select("part", "seq", "key").join(open_nodes, "key").select("part", "seq", *NAMES, "key")
    nodes = found.filter("kind = 'node'").select("part", "seq", *NAMES, F.lit(None).cast("binary").alias("key"))
    every = under_parents(nodes.unionByName(places), parts).unionByName(outer)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
