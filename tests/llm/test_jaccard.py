import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.llm import jaccard


def brute(rows):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def corpus(seed, groups, copies):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 6)))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        words = [word() for _ in range(draw.randint(1, 120))]
        if draw.random() < 0.4:
            words += passage
        for _ in range(draw.randint(1, copies)):
            own = list(words)
            for _ in range(draw.randint(0, max(1, len(own) // 30))):
                own[draw.randrange(len(own))] = word()
            rows.append(" ".join(own))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark, documents):
    for seed in (1, 2):
        rows = corpus(seed, 40, 8)
        got = jaccard.link_documents(documents(rows)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_walk_shares_paths_and_prunes():
    draw = np.random.default_rng(2)
    for _ in range(50):
        leader = np.unique(draw.integers(0, 40, 20))
        members = [np.unique(draw.integers(0, 40, draw.integers(1, 25))) for _ in range(10)]
        spare = [int(draw.integers(0, 3)) for _ in members]
        sizes = [len(m) + s for m, s in zip(members, spare)]
        got = jaccard.walk(leader, len(leader), members, sizes)
        for m, n, ok in zip(members, sizes, got):
            both = len(np.intersect1d(m, leader))
            assert ok == (100 * both >= 75 * (len(leader) + n - both))


def test_blocks_of_sets_are_connected():
    draw = np.random.default_rng(4)
    for _ in range(30):
        sets = [np.unique(draw.integers(0, 30, draw.integers(1, 30))) for _ in range(25)]
        sizes = np.array([len(s) + draw.integers(0, 2) for s in sets])
        parts = draw.integers(0, 8, len(sets))
        root = {int(p): int(p) for p in parts}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if i < j and 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                    root[find(parts[i])] = find(parts[j])
        want = {p: find(p) for p in root}
        root = {int(p): int(p) for p in parts}
        for i, j in jaccard.cross_links(list(range(len(sets))), sizes, parts, sets):
            assert find(parts[i]) != find(parts[j])
            root[find(parts[i])] = find(parts[j])
        same = lambda m: {frozenset(q for q in m if m[q] == m[p]) for p in m}
        assert same({p: find(p) for p in root}) == same(want)


def test_odd_rows(spark, documents, odd):
    got = jaccard.link_documents(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert by_id[None].component_id is None and by_id[8].n_shingles == 1
    assert all(r.component_id == r.doc_id for r in got)
    assert jaccard.link_documents(documents([])).collect() == []
    rows = [(9, "one two"), (3, "One  TWO"), (4, "one"), (5, "a b c d e f"), (1, "a b c d e f"), (7, "")]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_documents(documents(rows)).collect()) == brute(rows)


def test_dealing_takes_little_memory():
    draw = np.random.default_rng(4)
    words = np.array([f"{w:05x}" for w in range(60_000)])
    texts = [" ".join(draw.choice(words, 30_000)) for _ in range(60)]
    batch = pa.record_batch([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    dealt = pa.Table.from_batches(jaccard._deal(12)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 << 20
    codes = {}
    for names, counts, part in zip(*(dealt.column(c).to_pylist() for c in ("sets", "counts", "codes"))):
        ends = np.cumsum(np.frombuffer(counts, np.uint32))
        for k, own in enumerate(np.split(np.frombuffer(part, np.uint32), ends[:-1])):
            codes.setdefault(names[16 * k : 16 * k + 16], []).extend(own.tolist())
    for s in jaccard.shingle_sets(pa.array(texts)):
        assert sorted(codes[jaccard.set_id(s)]) == sorted(s[s < np.uint64(1 << 63)].astype(np.uint32).tolist())
    alone = jaccard._alone(dealt.filter(pc.equal(dealt.column("bucket"), 3)))
    count = Counter(c for own in codes.values() for c in own)
    assert sum(alone.column("alone").to_pylist()) <= sum(n == 1 for n in count.values())


def test_links_between_two_sides():
    draw = np.random.default_rng(5)
    base = [draw.choice(1 << 20, 40, replace=False) for _ in range(4)]
    sets = [np.r_[draw.choice(base[i % 4], 37, replace=False), draw.integers(1 << 21, 1 << 30, 2)] for i in range(30)]
    sizes, parts, sides = np.array([len(s) for s in sets]), draw.integers(0, 20, 30), draw.integers(7, 9, 30)
    found = jaccard.cross_links(list(range(30)), sizes, parts, sets, sides)
    root = list(range(20))
    for i, j in found:
        assert sides[i] != sides[j] and root[parts[i]] != root[parts[j]]
        assert 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))
        root = [root[parts[j]] if r == root[parts[i]] else r for r in root]
    for i in range(30):
        for j in range(i):
            if sides[i] != sides[j] and 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j])):
                assert root[parts[i]] == root[parts[j]]
    assert found
    # two sides of 400 need cells for their own pairs only
    sets = [draw.choice(1 << 20, 30) for _ in range(800)]
    tracemalloc.start()
    jaccard.cross_links(list(range(800)), np.full(800, 30), np.arange(800), sets, np.repeat([1, 2], 400))
    assert tracemalloc.get_traced_memory()[1] < 6 << 20
    tracemalloc.stop()
