import numpy as np

from tempora.llm import near_dup as N
from tempora.llm.components import connected_components
from tests.llm.conftest import words


def shingles(text):
    w = (text or "").encode().lower().split(None) if text else []
    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs))


def edit(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = "z%d" % rng.randrange(10 ** 6)
    return " ".join(w)


def fixture(rng):
    texts = [words(rng, rng.choice([1, 3, 5, 6, 12, 40, 120])) for _ in range(40)]
    for size, copies, edits in ((120, 30, 2), (200, 25, 4), (37, 12, 1), (36, 8, 1)):
        base = words(rng, size)
        texts += [edit(rng, base, rng.randrange(edits + 1)) for _ in range(copies)]
    line = words(rng, 17)
    texts += [line + "\n" + words(rng, rng.choice([2, 10, 60])) for _ in range(20)]
    texts += [texts[0], texts[1].upper(), None, "", " \t\n", "one", "One", "a\x0bb", "a b", "é", "É", "a b c d e f", "x" * 5000]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_groups_match_brute_force(spark, rng, monkeypatch):
    docs = fixture(rng)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs)
    for small, rows in ((96, 512), (3, 5)):      # the second forces long lists and several blocks
        monkeypatch.setattr(N, "SMALL", small)
        monkeypatch.setattr(N, "BLOCK_ROWS", rows)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.groups(d).collect())
        assert got == want


def test_drop_copies_and_defined_cases(spark):
    rows = [(5, "a b c d e f g", "x", 1), (2, "A b c d e f g", None, 2), (None, "a b c d e f g", "y", 3), (None, None, "z", 4),
            (7, "", "x", 5), (8, None, "x", 6), (9, "other text", "x", 7), (9, "other text", "x", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_shingles int")
    out = N.drop_copies(d)
    assert out.columns == d.columns
    assert sorted(r.n_shingles for r in out.collect()) == [2, 4, 5, 6, 7]      # one row of each group, and all without words
    got = {r.n: (r.component_id, r.kept) for r in N.groups(d).selectExpr("*", "doc_id as n").collect()}
    assert got[5] == (2, False) and got[2] == (2, True) and got[None][0] in (2, None) and got[8] == (8, True)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.groups(empty).count() == 0


def test_a_row_without_id_links_its_neighbours(spark, rng):
    base = ["w%d" % i for i in range(200)]
    a, n, c = " ".join(base[:-20]), " ".join(base), " ".join(base[20:])
    s = [shingles(t) for t in (a, n, c)]
    linked = [100 * len(x & y) >= 85 * len(x | y) for x, y in ((s[0], s[1]), (s[1], s[2]), (s[0], s[2]))]
    assert linked == [True, True, False]
    d = spark.createDataFrame([(2, a), (None, n), (3, c), (9, "far " + " ".join("q%d" % i for i in range(50)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.groups(d).collect()}
    assert got == {2: 2, None: 2, 3: 2, 9: 9}


def test_rows_of_one_id_are_told_apart(spark):
    x, clean = "a b c d e f g h", "quite another text of some words"
    d = spark.createDataFrame([(1, x, 1), (2, clean, 2), (2, x, 3), (4, "third text here", 4), (4, "third text here", 4), (4, "third text here", 5),
                               (None, "fourth text", 6), (None, "fourth text", 6)], "doc_id long, text string, k int")
    assert sorted((r.doc_id or 0, r.text) for r in N.drop_copies(d).collect()) == sorted(
        [(1, x), (2, clean), (4, "third text here"), (0, "fourth text")])


def test_need_bounds_the_missed_links():
    import math
    for percent in (50, 70, 80, 85, 95):
        m, p = N.need(percent), percent / 100
        tail = [sum(math.comb(N.K, i) * p ** i * (1 - p) ** (N.K - i) for i in range(k)) for k in (m, m + 1)]
        assert tail[0] < N.MISS <= tail[1]
    assert N.need(85) == 12


def test_block_links_are_a_spanning_forest(rng):
    sets = [np.array(sorted(rng.sample(range(30), 26)), np.uint64) for _ in range(40)]
    keys, side = np.arange(40), np.zeros(40, bool)
    forest = N.block_links(keys, side, sets)
    links = {(i, j) for i in range(40) for j in range(i) if N._similar(len(set(sets[i]) & set(sets[j])), 26, 26, 85)}
    assert all((max(p), min(p)) in links for p in forest)

    def parts(edges):
        p = list(range(40))
        for a, b in edges:
            p = [p[b] if x == p[a] else x for x in p]
        return [sorted(i for i in range(40) if p[i] == x) for x in sorted(set(p))]
    assert sorted(parts(forest)) == sorted(parts(links))


def test_components(spark, rng):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 301), (300, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[249] == 100 and got[301] == 300 and len(got) == 61 + 51 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
