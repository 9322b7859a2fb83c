"""Documents whose sets of word 5-grams have a Jaccard similarity of 0.75 or more.

1. Every text becomes the set of its shingle hashes; texts with equal sets form
   one class, and only one text of a class goes on.
2. A set x that links with y has at most a quarter of its shingles outside y.
   Half of all shingle hashes (those with the top bit clear) are dealt to buckets; a
   set with more than a quarter of its size among them that no other set has
   can link with nothing and leaves.  This loses no link.
3. The remaining sets are put in one global order, common shingles first.  Two
   sets that link share a shingle within the last (rarest) quarter plus one of
   each, so pairs come from equal shingles there.
4. Sets compared with the same set are walked as a prefix tree (in order, each
   resuming at the place where it leaves the path of the one before), sharing the
   overlap counted so far, and left as soon as what remains cannot suffice.
5. Only connectivity is asked for, so a few rounds first compare each set with the
   one set of another component that shares most of its prefix; all sets that
   share a prefix shingle across components are compared afterwards, as trees of
   bounded blocks of sets, and every two blocks meet at most once.

Equality of shingles and sets is that of 64-bit and 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import wordhash
from factloom.llm.components import connected_components
from factloom.llm.tables import saved, text_bytes

SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4  # the least similarity
PIECE_BYTES = 1 << 20  # text hashed at once, which takes some fifty times as much memory
DEALT_BYTES = 8 << 20  # text whose sets are dealt at once
BUCKET_BYTES = 32 << 20  # text behind one bucket
ROUNDS = 2
TREE_ROWS = 500  # sets walked together
BLOCK_ROWS = 1_500  # sets of a block that are compared with another block at once
LEVELS = 256  # levels of the tree taken together
FILTER_BITS = 1 << 24

_INK = np.ones(256, bool)
_INK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    texts = wordhash.texts_of(pc.ascii_lower(pc.fill_null(text, "")))
    words = wordhash.run_hashes(texts.data, _INK[texts.data], texts.offsets)
    h, out = words.hashes, []
    with np.errstate(over="ignore"):
        code = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(code)]
        code = wordhash.mix(code)
    for i, j in zip(words.first[:-1], words.first[1:]):
        if j - i >= SHINGLE:
            out.append(np.unique(code[i : j - SHINGLE + 1]))
        elif j > i:
            whole = hashlib.blake2b(h[i:j].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in wordhash.pieces(batch.column("text"), PIECE_BYTES):
            part = batch.slice(a, b - a)
            sets = shingle_sets(part.column("text"))
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_id, sets), pa.binary())],
                names=["doc_id", "n_shingles", "set_id"],
            )


def _deal(buckets: int):
    """Half of the shingles of each set, as one row per bucket and piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in wordhash.pieces(batch.column("text"), DEALT_BYTES):
                text, sets = batch.column("text").slice(a, b - a), {}
                for c, d in wordhash.pieces(text, PIECE_BYTES):  # sets are small, making them is not
                    sets |= {set_id(s): s for s in shingle_sets(text.slice(c, d - c)) if len(s)}
                if not sets:
                    continue
                ids = list(sets)
                codes = np.concatenate(list(sets.values()))
                whose = np.repeat(np.arange(len(ids), dtype=np.int32), [len(s) for s in sets.values()])
                sets.clear()
                half = codes < np.uint64(1 << 63)
                codes, whose = codes[half], whose[half]
                place = ((codes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(place, kind="stable")
                codes, whose, place = codes[order].astype(np.uint32), whose[order], place[order]
                cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
                rows = []
                for i, j in zip(cuts[:-1], cuts[1:]):
                    own, counts = np.unique(whose[i:j], return_counts=True)
                    rows.append((int(place[i]), b"".join(ids[k] for k in own), counts.astype(np.uint32).tobytes(), codes[i:j].tobytes()))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("bucket", "sets", "counts", "codes"), row)) for row in rows],
                    schema=pa.schema([("bucket", pa.int32()), ("sets", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())]),
                )

    return run


def _alone(table: pa.Table) -> pa.Table:
    """Per set the number of its shingles in this bucket that no other set has."""
    names, counts, codes, seen = [], [], [], set()
    for sets, sizes, part in zip(*(table.column(c).to_pylist() for c in ("sets", "counts", "codes"))):
        sizes, part = np.frombuffer(sizes, np.uint32), np.frombuffer(part, np.uint32)
        ends = np.cumsum(sizes)
        for k, end in enumerate(ends):
            name = sets[16 * k : 16 * k + 16]
            if name not in seen:
                seen.add(name)
                names.append(name)
                counts.append(int(sizes[k]))
                codes.append(part[end - sizes[k] : end])
    # code and owner in one number, sorted in place
    owned = np.concatenate(codes).astype(np.uint64) << np.uint64(32)
    owned |= np.repeat(np.arange(len(names), dtype=np.uint32), counts)
    owned.sort()
    fresh = np.r_[True, owned[1:] >> np.uint64(32) != owned[:-1] >> np.uint64(32), True]
    alone = np.bincount((owned[fresh[:-1] & fresh[1:]] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
    told = np.flatnonzero(alone)
    return pa.table({"set_id": pa.array([names[k] for k in told], pa.binary()), "alone": pa.array(alone[told], pa.int64())})


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the texts that still have the set they were chosen for."""
    for batch in batches:
        for a, b in wordhash.pieces(batch.column("text"), PIECE_BYTES):
            part = batch.slice(a, b - a)
            sets = shingle_sets(part.column("text"))
            keep = [i for i, (s, name) in enumerate(zip(sets, part.column("set_id").to_pylist())) if set_id(s) == name]
            chosen = part.take(pa.array(keep, pa.int64()))
            yield pa.record_batch(
                [chosen.column("doc_id"), chosen.column("n"), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                names=["id", "n", "shingles"],
            )


def walk(leader: np.ndarray, size: int, members: list[np.ndarray], sizes: list[int]) -> list[bool]:
    """Which members link with the leader; all sets in the global order.

    ``size`` and ``sizes`` are the whole sizes, of which the arrays leave out
    shingles that no other set has.
    """
    leader = np.sort(leader)
    linked = [False] * len(members)
    path, overlap = np.zeros(0, np.int64), np.zeros(1, np.int64)
    for i in sorted(range(len(members)), key=lambda i: members[i].tobytes()):
        own = members[i]
        need = -(-NUMERATOR * (size + sizes[i]) // (NUMERATOR + DENOMINATOR))
        m = min(len(path), len(own))
        differ = np.flatnonzero(path[:m] != own[:m])
        shared = int(differ[0]) if len(differ) else m
        done = [overlap[: shared + 1]]
        reached, count = shared, int(overlap[shared])
        while reached < len(own) and count + len(own) - reached >= need:
            part = own[reached : reached + 64]
            at = np.minimum(np.searchsorted(leader, part), len(leader) - 1)
            run = count + np.cumsum(leader[at] == part)
            done.append(run)
            reached, count = reached + len(part), int(run[-1])
        path, overlap = own[:reached], np.concatenate(done)
        linked[i] = reached == len(own) and count >= need
    return linked


def _verify(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """Pairs (a, b) that link; each a is a leader, its partners form a tree."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TREE_ROWS).cast("int").alias("parts"))
    members = (
        pairs.join(counts, "a")
        .withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .join(ordered.select(F.col("id").alias("b"), "n", "shingles"), "b")
        .select("a", "part", F.col("b").alias("id"), "n", "shingles")
        .toDF("leader", "slot", "id_m", "n_m", "shingles_m")
    )
    leaders = (
        counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(ordered.select(F.col("id").alias("a"), "n", "shingles"), "a")
        .select("a", "part", "n", "shingles")
        .toDF("leader_l", "slot_l", "n_l", "shingles_l")
    )

    def tree(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            sets = [x.values.to_numpy() for x in right.column("shingles_m")]
            linked = walk(left.column("shingles_l")[0].values.to_numpy(), left.column("n_l")[0].as_py(), sets, right.column("n_m").to_pylist())
            found = [x for x, ok in zip(right.column("id_m").to_pylist(), linked) if ok]
        leader = left.column("leader_l")[0].as_py() if left.num_rows else None
        return pa.table({"a": pa.array([leader] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return leaders.groupBy("leader_l", "slot_l").cogroup(members.groupBy("leader", "slot")).applyInArrow(tree, "a long, b long")


def _within(n: str, m: str):
    """The sizes allow a link."""
    small, large = F.least(n, m), F.greatest(n, m)
    return small * DENOMINATOR >= large * NUMERATOR


def _best_partner(prefix: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """For each set one set of another component that shares most of its prefix.

    In every group of equal shingles the two components with the smallest
    drawn sets stand for the group; a set meets the one that is not its own.
    """
    marked = prefix.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    drawn = marked.groupBy("shingle", "component").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "id"), "id", "n")).alias("d"))
    # the two smallest of a group, by two aggregates with partial results
    first = drawn.groupBy("shingle").agg(F.min(F.struct("d", "component")).alias("first"))
    second = (
        drawn.join(first, "shingle").where(F.col("component") != F.col("first.component"))
        .groupBy("shingle").agg(F.min("d").alias("second"))
    )
    heads = first.join(second, "shingle")
    met = marked.join(heads, "shingle").withColumn(
        "d", F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first.d"))
    )
    pairs = met.where(_within("n", "d.n")).groupBy(F.col("id").alias("b"), F.col("d.id").alias("a")).count()
    return pairs.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select("best.a", "b")


def cross_links(
    ids: list[int], sizes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links between different parts (and both ``sides``) among some sets, enough to connect them.

    The prefix tree of all sets is walked level by level, common shingles first:
    each level adds its shingles to the overlaps of all pairs at once, and a pair
    is left as soon as what remains of both cannot suffice.
    """
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, level, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[level] > 1
    level, owner, count = level[shared], owner[shared], count
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    order = np.argsort(rank[level], kind="stable")
    column, owner = rank[level][order], owner[order]
    sizes = sizes.astype(np.float32)
    rest = np.bincount(owner, minlength=len(sets)).astype(np.float32)
    # only cells of pairs that may link are made: all pairs once, or those of one side with the other
    left = right = np.arange(len(sets))
    if sides is not None:
        left, right = np.flatnonzero(sides == sides[0]), np.flatnonzero(sides != sides[0])
    n, m = sizes[left, None], sizes[None, right]
    need = np.ceil(NUMERATOR * (n + m) / (NUMERATOR + DENOMINATOR))
    alive = np.minimum(n, m) * DENOMINATOR >= np.maximum(n, m) * NUMERATOR
    alive &= parts[left, None] < parts[None, right] if sides is None else parts[left, None] != parts[None, right]
    overlap = np.zeros(alive.shape, np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, LEVELS):
        i, j = np.searchsorted(column, [begin, begin + LEVELS])
        x = np.zeros((len(sets), LEVELS), np.float32)
        x[owner[i:j], column[i:j] - begin] = 1
        overlap += x[left] @ x[right].T
        rest -= x.sum(axis=1)
        alive &= overlap + np.minimum(rest[left, None], rest[None, right]) >= need
        if not alive.any():
            return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    found = np.nonzero(alive & (overlap >= need))
    for i, j in zip(left[found[0]].tolist(), right[found[1]].tolist()):
        a, b = find(int(parts[i])), find(int(parts[j]))
        if a != b:
            root[a] = b
            links.append((ids[i], ids[j]))
    return links


def _meetings(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, component, block, x, y): the sets that meet in a task of their own, by pairs of blocks.

    Only sets matter that share a prefix shingle across components.  The home of a set is
    the largest such group that it is in, so that sets which share a passage are
    together; a home is cut into blocks of ``BLOCK_ROWS`` sets.  A set meets every block
    that has a set of one of its groups, once, however many shingles they share.  If
    the next rarer prefix shingle (``rarer``) is the same for all sets of a group, these are
    in the group of that one as well, which then stands for both.
    """
    marked = prefix.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = (
        marked.groupBy("shingle")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("sets"),
            F.count_if(F.col("rarer").isNull()).alias("rarest"), F.min("rarer").alias("first"), F.max("rarer").alias("last"),
        )
        .where("low <> high AND (rarest > 0 OR first <> last)").select("shingle", "sets")
    )
    members = saved(marked.join(groups, "shingle").select("shingle", "id", "component", "sets"), "members")
    homes = members.groupBy("id").agg(F.max(F.struct("sets", "shingle")).alias("home"))
    part = F.pmod(F.xxhash64("id", F.lit(9)), F.ceil(F.col("home.sets") / BLOCK_ROWS))
    homes = homes.select(F.col("id").alias("owner"), F.xxhash64("home.shingle", part).alias("block"))
    placed = saved(members.join(homes, members["id"] == homes["owner"]).select("shingle", "id", "component", "block"), "placed")
    present = placed.select("shingle", F.col("block").alias("other")).distinct()
    met = placed.join(present, "shingle").select(
        "id", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    )
    met = saved(met.distinct(), "met")
    crossing = met.groupBy("x", "y").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return met.join(crossing.select("x", "y"), ["x", "y"])


def _crossing(prefix: DataFrame, labels: DataFrame, ordered: DataFrame) -> DataFrame:
    """Links (a, b) among sets that share a prefix shingle and are still in two components.

    Two blocks of sets meet once, and no pair of sets is ever a row.
    """
    rows = _meetings(prefix, labels).join(ordered, "id")

    def cross(table: pa.Table) -> pa.Table:
        sides = table.column("block").to_numpy() if table.column("x")[0] != table.column("y")[0] else None
        found = cross_links(
            table.column("id").to_pylist(), table.column("n").to_numpy(), table.column("component").to_numpy(),
            [x.values.to_numpy() for x in table.column("shingles")], sides,
        )
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("x", "y").applyInArrow(cross, "a long, b long")


def _bitmap_filter(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be among the chosen ones.

    The bitmap has ``FILTER_BITS`` bits whatever the data, so it can go to every
    task; it only spares the join that follows the texts it need not move.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = chosen.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    marked = docs.withColumn("bit", bit).withColumn("part", F.bitmap_bucket_number("bit"))
    hit = F.expr("shiftright({}, cast(bitmap_bit_position(bit) % 8 as int)) & 1 = 1".format("byte"))
    return marked.join(F.broadcast(maps), "part").withColumn("byte", byte).where(hit).select(*docs.columns)


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id), one row per input row.

    Texts without words (NULL, empty) have no shingles and their own id as
    component; equal sets are always in one component.  Rows with a NULL id
    are kept, belong to no component and link nothing; rows that repeat an id
    share the component of each of their texts.  Other columns are ignored.
    """
    rows = _documents(docs)
    sizes = saved(rows.mapInArrow(_sizes, "doc_id long, n_shingles long, set_id binary"), "sizes")
    classes = sizes.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n")
    )
    buckets = max(12, text_bytes(rows) // BUCKET_BYTES)
    dealt = rows.mapInArrow(_deal(buckets), "bucket int, sets binary, counts binary, codes binary")
    alone = dealt.groupBy("bucket").applyInArrow(_alone, "set_id binary, alone long")
    alone = alone.groupBy("set_id").agg(F.sum("alone").alias("alone"))
    spare = DENOMINATOR - NUMERATOR
    chosen = classes.join(alone, "set_id", "left").where(
        F.coalesce("alone", F.lit(0)) * DENOMINATOR <= F.col("n") * spare
    )
    chosen = saved(chosen.select("doc_id", "n", "set_id"), "chosen")

    sets = _bitmap_filter(rows, chosen).join(chosen, "doc_id").mapInArrow(_shingles, "id long, n long, shingles array<long>")
    sets = saved(sets, "sets")
    listed = sets.select("id", "n", F.explode("shingles").alias("shingle"))
    counts = listed.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    listed = listed.join(counts, "shingle")
    # the global order: common first, ties by hash
    place = F.sort_array(F.collect_set(F.struct("df", "shingle")), asc=False)
    ordered = listed.groupBy("id").agg(F.first("n").alias("n"), place.alias("place"))
    ordered = saved(
        ordered.select("id", "n", F.transform("place", lambda x: x["shingle"]).alias("shingles"))
        .where(F.size("shingles") * DENOMINATOR >= F.col("n") * NUMERATOR),
        "ordered",
    )
    # the rarest quarter plus one; shingles of one set only are the rarest of all
    head = F.floor(F.col("n") * spare / DENOMINATOR) + 1 - (F.col("n") - F.size("shingles"))
    rare = F.slice("shingles", F.greatest(F.size("shingles") - head + 1, F.lit(1)).cast("int"), head.cast("int"))
    prefix = ordered.select("id", "n", rare.alias("rare")).select("id", "n", "rare", F.posexplode("rare").alias("place", "shingle"))
    prefix = saved(prefix.select("id", "n", "shingle", F.get("rare", F.col("place") + 1).alias("rarer")), "prefix")

    links = labels = None
    for turn in range(ROUNDS + 1):
        known = labels if labels is not None else prefix.limit(0).select("id", F.col("id").alias("component"))
        if turn < ROUNDS:
            found = _verify(saved(_best_partner(prefix, known, turn), "pairs"), ordered)
        else:
            found = _crossing(prefix, known, ordered)
        found = saved(found, "linked")
        links = found if links is None else links.union(found)
        labels = connected_components(links)

    component = classes.join(labels, classes["doc_id"] == labels["id"], "left").select(
        "set_id", F.coalesce("component", "doc_id").alias("component_id")
    )
    return sizes.join(component, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "set_id",
    )
