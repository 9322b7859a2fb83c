import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from factloom.llm import prefix_trie, queries

COLUMNS = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, name, text))
    own = {c: [(t[1], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def brute(seqs):
    members = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    rows = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        childless = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members)]
        ends = sorted(c for c in convs if len(seqs[c]) == len(node))
        rows.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(x) == len(node) + 1 and x[: len(node)] == node for x in members), len(childless),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        df = queries.queries()["op12_prefix_trie"](spark, sf)
        assert oracle.compare(df, oracle.connect(sf), queries.oracle_sql()["op12_prefix_trie"]) is None


def test_odd_rows_against_brute_force(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t if c % 3 else c % 7}") for c in range(60) for t in range(c % 12)]
    rows += [(100, None, None, None), (100, 1, "user", ""), (100, 1, "user", ""), (100, 1, "tool", "é漢🙂"), (-7, 0, "user", "minus"),
             (-5, 0, "user", "first"), (-5, 3, "a", "b:"), (-5, 3, "a:", "b"), (None, 0, "user", "lost"), (104, 0, "user", "long " * 30_000)]
    rows += [(1000 + c, t, "user", "same") for c in range(300) for t in range(3)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS node", "1 AS depth", "2 AS start", "3 AS key", "4 AS size")
    assert found(prefix_trie.conversation_trie(df)) == brute(rebuild(rows))
    assert found(prefix_trie.conversation_trie(df.limit(0))) == []
    assert found(prefix_trie.conversation_trie(df.where("conv_id IS NULL"))) == []


def test_many_small_trees_merge_to_the_same_trie(spark, monkeypatch):
    rows = [(c, t, "user", f"{(c * 7919 + t * t * (c % 4)) % 5}") for c in range(200) for t in range(1 + c % 9)]
    df = spark.createDataFrame(rows, COLUMNS)
    seqs = rebuild(rows)
    monkeypatch.setattr(prefix_trie, "TREE_BYTES", 1)  # a tree for every conversation
    assert found(prefix_trie.conversation_trie(df.repartition(7))) == brute(seqs)


def test_ids_are_hashed_in_numeric_order_over_blocks(spark):
    ids = [5, 10, 9, 100, 4095, 4096, 40_000, -1, -5000, 1 << 40]
    df = spark.createDataFrame([(b"a", i) for i in ids] + [(b"b", 7)], "node binary, conv_id long")
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie.end_hashes(df).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=4), min_size=1, max_size=120))
def test_tree_against_a_dictionary_of_prefixes(paths):
    """Layouts of every size, paths that split anywhere, keys that are prefixes of others."""
    tree, members = prefix_trie.RadixTree(), {}
    for c, path in enumerate(paths):
        key = b"".join(x.to_bytes(16, "big") for x in path)
        tree.ends(key, [1] * len(path)).add(c, prefix_trie.NOBODY, 0)
        for d in range(len(path) + 1):
            members.setdefault(key[: 16 * d], []).append((c, len(path)))
    wanted = {
        hashlib.md5(k).digest(): (hashlib.md5(k[:-16]).digest() if k else None, len(k) // 16, len(v), min(v)[0], max(n for _, n in v))
        for k, v in members.items()
    }
    got = [(r[0], r[1:6]) for r in tree.rows()]
    assert len(got) == len(wanted) and dict(got) == wanted


def test_layouts_grow():
    layout, kinds = prefix_trie.Sorted(), []
    for k in range(256):
        layout = layout.put(k, str(k))
        kinds.append((type(layout).__name__, getattr(layout, "room", None)))
    assert [kinds[k] for k in (3, 4, 15, 16, 47, 48)] == [
        ("Sorted", 4), ("Sorted", 16), ("Sorted", 16), ("Indexed", None), ("Indexed", None), ("Direct", None)
    ]
    assert all(layout.get(k) == str(k) for k in range(256))
