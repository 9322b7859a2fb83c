import random
import tracemalloc

import numpy as np

from factloom.llm import decontaminate


def test_planted_items(spark, documents):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8)))
    items = [[word() for _ in range(n)] for n in (20, 35, 70, 3)]
    benchmark = spark.createDataFrame(
        [(i, " ".join(w)) for i, w in enumerate(items)] + [(8, ""), (9, None), (None, "x y z")], "item_id long, text string"
    )
    prose = lambda n: [word() for _ in range(n)]
    changed = list(items[1])
    for k in (3, 11, 19, 27):
        changed[k] = "other"
    half = prose(40) + items[1][:15] + prose(40)
    rows = [
        prose(200) + items[0] + prose(100), ["UPPER"] + [w.upper() + "," for w in items[2]], prose(90) + changed, half, prose(300),
        prose(20) + items[3] + prose(5), items[3][:2] + ["x"] + items[3][2:], items[0] + prose(7) + items[2],
    ]
    found = decontaminate.contaminated(documents([(i, " ".join(w)) for i, w in enumerate(rows)]), benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, 0), (1, 2), (2, 1), (5, 3), (7, 0), (7, 2)}


def test_common_subsequence():
    draw = np.random.default_rng(3)
    for _ in range(200):
        a, b = draw.integers(0, 6, draw.integers(1, 12)), draw.integers(0, 6, draw.integers(0, 15))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == t[-1, -1]


def test_basis_is_that_of_the_singular_value_decomposition(spark):
    draw = np.random.default_rng(5)
    a = draw.normal(size=(60, 4)) @ draw.normal(size=(4, 30))
    rows = spark.createDataFrame([(list(range(30)), r.tolist()) for r in a], "places array<int>, values array<double>")

    def sparse(batches):
        for batch in batches:
            places = batch.column("places").flatten().to_numpy()
            yield places, batch.column("values").flatten().to_numpy(), np.arange(0, len(places), 30)

    basis = decontaminate.latent_basis(rows, sparse, 30, 10)
    assert basis.shape[1] == 4 and np.allclose(a @ basis @ basis.T, a)


def test_odd_rows_and_empty_tables(spark, odd, documents):
    benchmark = spark.createDataFrame([(1, "no id at all but some words here"), (1, "no id at all but some words here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, benchmark).collect()] == [(None, 1)]
    assert decontaminate.contaminated(odd, benchmark.limit(0)).collect() == []
    assert decontaminate.contaminated(documents([]), benchmark).collect() == []


def test_paraphrases_without_the_rarest_words(spark, documents):
    draw = random.Random(9)
    common = ["".join(draw.choice("etaoinshrdlu") for _ in range(5)) for _ in range(60)]
    rare = [f"rare{i}" for i in range(400)]
    # a quarter of an item's words is rare and carries most of its weight
    items = [[draw.choice(common) for _ in range(n)] for n in (24, 40, 100)]
    for i, item in enumerate(items):
        for j in range(len(item) // 4):
            item[4 * j + 1] = rare[30 * i + j]
    prose = lambda n: [draw.choice(common) if draw.random() < 0.5 else draw.choice(rare[120:]) for _ in range(n)]
    rows = [prose(150) + [w if w in common else "other" for w in item] + prose(150) for item in items]
    spread = [w for j, w in enumerate(items[1][:24] + items[1][24:]) for w in ([w, "between"] if j % 2 else [w])]
    rows += [prose(90) + spread + prose(90), prose(60), [w for w in items[0] if w not in common] + prose(80)]
    rows += [prose(120) for _ in range(60)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(documents([(i, " ".join(w)) for i, w in enumerate(rows)]), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1), (2, 2), (3, 1)}


def test_gate_keeps_what_a_subsequence_can_cover():
    draw = np.random.default_rng(6)
    for _ in range(300):
        words = np.sort(draw.choice(1 << 62, 40, replace=False).astype(np.uint64))
        item = draw.choice(words, draw.integers(1, 30))
        vocabulary = decontaminate.Vocabulary(np.unique(item))
        (gate,) = decontaminate._gates([item], vocabulary, draw.integers(0, 9, len(vocabulary.hashes)))
        kept = np.unique(item[draw.permutation(len(item))[: int(np.ceil(decontaminate.COVERED_WITH_ANSWER * len(item) - 1e-9))]])
        number = np.searchsorted(vocabulary.hashes, kept)
        mass = sum(gate.positions[gate.indptr[w] : gate.indptr[w + 1]].sum() for w in number)
        assert mass >= gate.shared[0] >= 1


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def brute(rows, items):
    """All places of all documents against all items: the rule, and nothing else."""
    d = decontaminate
    out = set()
    for doc, words in enumerate(rows):
        for k, item in enumerate(items):
            n = len(item)
            for start in range(0, len(words), d.STEP):
                region = words[max(0, start - n) : start + d.PASSAGE + n]
                share = longest(item, region) / n
                tail = item[-d.ANSWER_WORDS :]
                holds = any(region[i : i + len(tail)] == tail for i in range(len(region)))
                if share >= d.COVERED or (share >= d.COVERED_WITH_ANSWER and holds):
                    out.add((doc, k))
    return out


def test_against_brute_force_and_recall_of_the_cosine_search(spark, documents):
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("etaoinshrdlu") for _ in range(6)) for _ in range(400)]
    prose = lambda n: [vocabulary[int(399 * draw.random() ** 2)] for _ in range(n)]
    items = [prose(draw.choice([12, 24, 40, 75])) for _ in range(12)]
    rows = []
    for i in range(80):
        own = prose(draw.choice([0, 30, 90]))
        item = list(draw.choice(items))
        for _ in range(int(len(item) * draw.choice([0, 0.1, 0.2, 0.3, 0.45, 0.6]))):
            item[draw.randrange(len(item) - draw.choice([0, 5]))] = draw.choice(vocabulary)
        rows.append(own + item + prose(draw.choice([0, 40])))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(documents([(i, " ".join(w)) for i, w in enumerate(rows)]), benchmark).collect()
    wanted = brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in found} == wanted and 20 < len(wanted) < 80
    assert sum(r.by_cosine for r in found) >= 0.9 * len(wanted)


def test_long_documents_and_parts(spark, documents, monkeypatch):
    draw = random.Random(13)
    item = [f"w{draw.randrange(900)}" for _ in range(50)]
    prose = lambda n: [f"w{draw.randrange(900)}" for _ in range(n)]
    rows = [(1, prose(60_000) + item + prose(9)), (2, prose(20)), (3, item), (4, item[:20])]
    monkeypatch.setattr(decontaminate, "PART_WORDS", 1000)
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(documents([(i, " ".join(w)) for i, w in rows]), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.coverage, r.by_cosine) for r in found} == {(1, 5, 1.0, True), (3, 5, 1.0, True)}


def test_covered_items_are_those_of_each_place(monkeypatch):
    draw = np.random.default_rng(9)
    size = 30
    words = [draw.integers(0, size, n) for n in (5, 12, 40)]
    items = decontaminate.Items([1, 2, 3], words, size, np.zeros((size, 1)), np.zeros((3, 1)), np.arange(3), [])
    lengths = np.array([10, 0, 200, 3, 90])
    first = np.concatenate([[0], np.cumsum(lengths)])
    number = draw.integers(0, 4 * size, first[-1]).clip(max=size)
    marked = decontaminate.Marked(first, number, np.flatnonzero(number < size))
    places = [(t, int(first[t]) + d) for t in (0, 2, 3, 4) for d in range(0, int(lengths[t]) + 24, 32)]  # some begin behind the text
    rows = [(t, p, k) for t, p in places for k in sorted(draw.choice(3, draw.integers(1, 4), replace=False).tolist())]
    wanted = []
    for t, p, _k in rows:
        n = max(len(words[k]) for u, q, k in rows if (u, q) == (t, p))
        region = set(number[max(first[t], p - n) : min(first[t + 1], p + 2 * decontaminate.PASSAGE + n)].tolist())
        wanted.append(sum(w in region for w in words[_k].tolist()) / len(words[_k]) >= decontaminate.COVERED_WITH_ANSWER)
    for cells in (1, 1 << 20):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        assert decontaminate._covered(marked, items, *np.array(rows).T).tolist() == wanted
    assert any(wanted) and not all(wanted)


def test_search_makes_no_large_tables():
    draw = np.random.default_rng(10)
    size, n = 2000, 1 << 17
    items = [draw.integers(0, size, 30) for _ in range(300)]
    basis = draw.normal(size=(size, 96)).astype(np.float32)
    passages = np.stack([basis[w].sum(axis=0) for w in items])
    passages /= np.linalg.norm(passages, axis=1)[:, None]
    chunk = decontaminate.Items(list(range(300)), items, size, basis, passages, np.arange(300), [])
    assert decontaminate.PART_WORDS <= n
    marked = decontaminate.Marked(np.array([0, n]), draw.integers(0, size, n), np.arange(n))
    tracemalloc.start()
    near = decontaminate._near_passages(marked, chunk)
    assert len(near[0]) == len(decontaminate._covered(marked, chunk, *near))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
