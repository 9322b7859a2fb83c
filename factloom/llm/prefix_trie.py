"""Prefix trie of conversations, from adaptive radix trees that tasks build and Spark merges.

A turn is named by sixteen bytes, the MD5 of its role and text, and a conversation by the
names of its turns in order: a key of fixed-width big-endian ids.  Every task inserts its
keys into an adaptive radix tree: inner nodes have room for 4, 16, 48 or 256 children and
grow as needed, chains without a branch are kept as one compressed path, and only depths
that are whole turns become trie nodes.  A node leaves a task once, however many keys run
through it, as the MD5 of its prefix with what its keys add up to; sums over these make
the node of the whole table, so a prefix that all conversations share is one row per tree.

What a subtree needs is added without a walk over it.  The smallest member of a node, its
owner, owns all nodes further down its own path, so one number per conversation (the
depth where it starts to own) says which nodes it stands for.  Children and leaves are
counted by their owner, and every other conversation through a node saves that node's
text; a second pass adds this up from the ends to the root.

Turns and prefixes are compared by 128-bit hashes.  Rows without conv_id are left out;
a NULL role or text is empty; a NULL turn comes first; turns of one number are ordered by
role, then by the hash of role and text, and repeated rows are turns of their own.
Conversations without turns are members of the root alone; an empty table has no nodes.
Other columns are ignored.  The turn ids of one conversation (about 40 bytes a turn) are
one row; no group of conversations is ever gathered in one row or task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import saved

ID_BYTES = 16
FAMILY, HEADS = 5, 9  # conversations that share a head, and the possible lengths of a head
TREE_BYTES = 16 << 20  # a tree is emitted and begun anew after so many bytes of keys
SALTS = 64
BLOCK_BITS = 12  # ids are joined to text in blocks of 4,096 numbers
NOBODY = 1 << 62  # the start of a conversation that owns no node
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE_SCHEMA = (
    "node binary, parent binary, depth long, n_convs long, conv_id long, longest long, start long, "
    "n_children long, n_leaves long, saved_tokens long"
)


class Sorted:
    """Up to 4 or 16 children, found by a scan of their bytes."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4):
        self.keys, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node):
        """The layout that holds the node: this one, or the next larger one."""
        if len(self.keys) == self.room:
            grown = Sorted(16) if self.room == 4 else Indexed()
            for k, n in zip(self.keys, self.nodes):
                grown.put(k, n)
            return grown.put(byte, node)
        self.keys.append(byte)
        self.nodes.append(node)
        return self

    def children(self) -> list:
        return self.nodes


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node):
        if len(self.nodes) == 48:
            grown = Direct()
            for k in range(256):
                if self.index[k]:
                    grown.put(k, self.nodes[self.index[k] - 1])
            return grown.put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def children(self) -> list:
        return self.nodes


class Direct:
    """A place for each of the 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def children(self) -> list:
        return [n for n in self.nodes if n is not None]


class Ends:
    """What the conversations that end at a key add up to."""

    __slots__ = ("key", "sizes", "count", "smallest", "start", "leaves")

    def __init__(self, key: bytes, sizes: list[int]):
        self.key, self.sizes = key, sizes
        self.count, self.smallest, self.start, self.leaves = 0, NOBODY, NOBODY, 0

    def add(self, conv_id: int, start: int, leaf: int) -> None:
        self.count += 1
        self.smallest = min(self.smallest, conv_id)
        self.start = min(self.start, start)
        self.leaves += leaf


class Node:
    __slots__ = ("path", "ends", "layout")

    def __init__(self, path: bytes, ends: Ends | None = None, layout=None):
        self.path, self.ends, self.layout = path, ends, layout


class RadixTree:
    """An adaptive radix tree over keys of whole ids."""

    def __init__(self):
        self.root = Node(b"")

    def ends(self, key: bytes, sizes: list[int]) -> Ends:
        """The place of a key, made if it is new."""
        node, at = self.root, 0
        while True:
            path = node.path
            same = len(path) if key.startswith(path, at) else _same(path, key, at)
            if same < len(path):  # the path splits here
                lower = Node(path[same + 1 :], node.ends, node.layout)
                node.path, node.ends, node.layout = path[:same], None, Sorted().put(path[same], lower)
            at += same
            if at == len(key):
                if node.ends is None:
                    node.ends = Ends(key, sizes)
                return node.ends
            child = node.layout.get(key[at]) if node.layout is not None else None
            if child is None:
                ends = Ends(key, sizes)
                node.layout = (node.layout or Sorted()).put(key[at], Node(key[at + 1 :], ends))
                return ends
            node, at = child, at + 1

    def rows(self) -> Iterator[tuple]:
        """The trie nodes, each after all nodes below it, as NODE_SCHEMA names them."""
        order, waiting = [], [(self.root, None, 0)]
        while waiting:  # parents before children; walked backwards below
            node, above, begin = waiting.pop()
            end = begin + len(node.path)
            total = Total()
            order.append((node, above, begin - (above is not None), end, total))
            if node.layout is not None:
                waiting += [(child, total, end + 1) for child in node.layout.children()]
        for node, above, begin, end, total in reversed(order):
            if node.ends is not None:
                total.close(node.ends, end // ID_BYTES)
            if total.key is None:
                return  # a tree without keys
            first = 0 if above is None else begin // ID_BYTES + 1
            yield from total.climb(first, end // ID_BYTES)
            if above is not None:
                above.take(total)


class Total:
    """What the keys below a place in the tree add up to."""

    __slots__ = ("key", "sizes", "count", "smallest", "longest", "start", "children", "leaves", "saved")

    def __init__(self):
        self.key = self.sizes = None
        self.count, self.smallest, self.longest, self.start = 0, NOBODY, 0, NOBODY
        self.children = self.leaves = self.saved = 0

    def close(self, ends: Ends, depth: int) -> None:
        self.key, self.sizes = ends.key, ends.sizes
        self.count += ends.count
        self.smallest, self.longest = min(self.smallest, ends.smallest), max(self.longest, depth)
        self.start = min(self.start, ends.start)
        self.leaves += ends.leaves

    def take(self, below: Total) -> None:
        self.key, self.sizes = below.key, below.sizes
        self.count += below.count
        self.smallest, self.longest = min(self.smallest, below.smallest), max(self.longest, below.longest)
        self.start = min(self.start, below.start)
        self.children += below.children
        self.leaves += below.leaves
        self.saved += below.saved

    def climb(self, first: int, last: int) -> Iterator[tuple]:
        """Emits the nodes of depths ``last`` to ``first`` on one compressed path."""
        names = _names(self.key, max(first - 1, 0), last)
        for depth in range(last, first - 1, -1):
            owned = self.start <= depth
            if depth:
                self.saved += (self.count - owned) * self.sizes[depth - 1]
            yield (
                names[depth], names[depth - 1] if depth else None, depth, self.count, self.smallest, self.longest,
                self.start, self.children, self.leaves, self.saved,
            )
            self.children = int(owned)


def _same(path: bytes, key: bytes, at: int) -> int:
    for k, (a, b) in enumerate(zip(path, key[at : at + len(path)])):
        if a != b:
            return k
    return min(len(path), len(key) - at)


def _names(key: bytes, first: int, last: int) -> dict[int, bytes]:
    """The MD5 of the prefixes of ``first`` to ``last`` ids."""
    digest = hashlib.md5(key[: first * ID_BYTES])
    names = {first: digest.digest()}
    for depth in range(first + 1, last + 1):
        digest.update(key[(depth - 1) * ID_BYTES : depth * ID_BYTES])
        names[depth] = digest.digest()
    return names


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie nodes of the conversations of one task, tree by tree."""
    tree, held = RadixTree(), 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "key", "sizes", "start", "leaf")]
        for conv_id, key, sizes, start, leaf in zip(*columns):
            tree.ends(key, sizes).add(conv_id, start, leaf)
            held += len(key) + 64
            if held >= TREE_BYTES:
                yield from _batches(tree)
                tree, held = RadixTree(), 0
    yield from _batches(tree)


def _batches(tree: RadixTree, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary()] * 2 + [pa.int64()] * 8
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for row in tree.rows():
        rows.append(row)
        if len(rows) == size:
            yield packed()
            rows.clear()
    if rows:
        yield packed()


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the hash and text size of every turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.octet_length(text).alias("size"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "id", "size")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first of their family.

    ``family`` ids share the turns of the first of them; how many follows from the
    checksum of the id.  A conversation goes to at most ``FAMILY`` others.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    heads = paths.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, HEADS - 1).alias("head")
    )
    own = paths.withColumn("head_size", head).withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    none = F.slice("turns", 1, 0)
    met = own.join(heads, own["family"] == heads["first_id"], "left")
    return met.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("head_size")),
        F.slice("turns", F.col("head_size") + 1, F.greatest(F.size("turns") - F.col("head_size"), F.lit(0))),
    ).alias("turns"))


def _tree_nodes(paths: DataFrame, start: Column, leaf: Column) -> DataFrame:
    rows = paths.select("conv_id", "key", "sizes", start.cast("long").alias("start"), leaf.cast("long").alias("leaf"))
    return rows.mapInArrow(_merged, NODE_SCHEMA).groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.max("longest").alias("longest"), F.min("start").alias("start"),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the SHA-256 of the sorted, joined ids.

    Ids are sorted and joined in blocks of numbers, which bounds each group; the blocks
    of a node then run through one hash in order, read as a stream.
    """
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    pieces = ends.groupBy("node", block).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

        node = digest = None
        for batch in batches:
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        yield row()
                    node, digest = name, hashlib.sha256()
                digest.update(ids.encode())
        if node is not None:
            yield row()

    return pieces.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(
        stream, "node binary, ends_sha256 string"
    )


def trie_nodes(paths: DataFrame) -> DataFrame:
    """The trie of (conv_id, turns): one row per distinct prefix.

    Columns: node (MD5 of the prefix), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    keys = paths.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    keys = saved(keys, "paths")
    first = _tree_nodes(keys, F.lit(NOBODY), F.lit(0))
    owners = first.groupBy(F.col("conv_id").alias("owner")).agg(
        F.min("depth").alias("start"), F.max(F.when(F.col("depth") == F.col("longest"), 1).otherwise(0)).alias("leaf")
    )
    owned = keys.join(owners, keys["conv_id"] == owners["owner"], "left")
    nodes = saved(_tree_nodes(owned, F.coalesce("start", F.lit(NOBODY)), F.coalesce("leaf", F.lit(0))), "nodes")

    # the parent is the owner's own unless the owner starts here; a parent with many
    # children is looked up once per salt, and each salt serves its part of them
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")
    starting = nodes.where("depth > 0 AND depth = start").select("node", "parent", salt)
    asked = starting.select("parent", "salt").distinct()
    known = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    answers = asked.join(known, "parent")
    parents = starting.join(answers, ["parent", "salt"]).select("node", "parent_conv_id")
    ends = end_hashes(keys.select(F.unhex(F.md5("key")).alias("node"), "conv_id"))
    above = F.when(F.col("depth") > F.col("start"), F.col("conv_id")).otherwise(F.col("parent_conv_id"))
    return nodes.join(parents, "node", "left").join(ends, "node", "left").select(
        "node", "conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie_nodes(rebuilt(turn_paths(conversations)))


def trie_sql() -> str:
    """The same nodes in SQL, for small tables."""
    table = list(range(16))  # the checksum of four bits
    for _ in range(4):
        table = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in table]
    half = f"xor(c >> 4, list_extract({table}, (xor(c, b) & 15) + 1)::BIGINT)"
    byte = f"xor({half} >> 4, list_extract({table}, (xor({half}, b >> 4) & 15) + 1)::BIGINT)"
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS turns
    FROM rows GROUP BY conv_id),
sized AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: {byte}), 4294967295) % {HEADS} AS h FROM own),
seqs AS (SELECT o.conv_id, coalesce(f.turns, [])[1:o.h] || o.turns[o.h + 1:] AS seq
    FROM sized o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % {FAMILY}),
prefixes AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM seqs),
members AS (SELECT conv_id, n, depth, seq[1:depth] AS node FROM prefixes),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf,
    coalesce((count(*) - 1) * strlen(node[depth].text), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM members GROUP BY node, depth),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
climbing AS (SELECT node, leaf, saved, unnest(range(0, depth + 1)) AS up FROM nodes),
below AS (SELECT node[1:up] AS node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM climbing GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves,
    b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.node = n.node
    LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]"""
