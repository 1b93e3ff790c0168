import math
import re
from collections import Counter

import numpy as np
import pytest

from tempora.llm import bytewords as bw
from tempora.llm import ranked_search as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for i, own in asked.items():
        rows = []
        for d, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in own if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        best = [(r, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)]
        if best:
            out[i] = best
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int").repartition(2)
    got = {}
    for r in R.search(d, q, **kw).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in got.items()}


def corpus(rng, n):
    def words(k):
        return " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(k))
    docs = [(i, words(rng.choice([1, 5, 40, 400]))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)]                          # copies
    docs += [(5 * n + i, f"only {i} Rare{i} rare{i} RARE{i}") for i in range(20)]
    return docs, [(i, words(25)) for i in range(30)]


def test_against_brute_force(spark, rng):
    docs, items = corpus(rng, 500)
    items += [(100, docs[3][1]), (101, "rare4 Rare7"), (102, "nowhere"), (103, ""), (104, None), (None, "rare1 é"), (105, "rare3"), (105, "rare5")]
    docs += [(None, "rare1 é É"), (None, ""), (7, "rare7 twice the id"), (9000, None), (9001, "... !?"), (9002, "w1 " * 30_000 + "rare4")]
    assert run(spark, docs, items) == brute(docs, items)


def test_items_in_blocks_and_long_key_lists(spark, rng, monkeypatch):
    docs, items = corpus(rng, 150)
    monkeypatch.setattr(R, "ITEM_BYTES", 400)
    monkeypatch.setattr(R, "BROADCAST_KEYS", 0)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == {}
    assert run(spark, [(1, "a")], []) == {}
    assert run(spark, [(1, None), (2, "?")], [(1, "a")]) == {}
    assert run(spark, [(1, "a"), (2, "b")], [(1, "a c")]) == brute([(1, "a"), (2, "b")], [(1, "a c")])


def test_bounds_are_never_below_the_scores(spark, rng):
    docs, items = corpus(rng, 300)
    block = R._items([(i, [t]) for i, t in items])
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    counts = {i: Counter(terms(t)) for i, t in docs}
    n, total = len(docs), sum(sum(c.values()) for c in counts.values())
    df = Counter(t for c in counts.values() for t in c)
    weights = np.array([R.weight(n, df[t.decode()]) for t in block.terms], np.int64)
    assert R.frequencies(d, "text", block).tolist() == [df[t.decode()] for t in block.terms]
    c = R.Corpus(n, total, weights)
    above, seen, tight = R.Bounds(block, c), 0, []
    for b in R.index(d).collect():
        lengths = np.array(b.lengths, np.int64)
        assert lengths.tolist() == [sum(counts[i].values()) for i in b.ids]
        bound = above.of(b.width, b.slices, lengths)
        norms = c.norms(lengths)
        seen += len(b.ids)
        for k, i in enumerate(b.ids):
            for row, own in enumerate(block.rows):
                exact = sum(int(weights[t]) * int(R.gain(counts[i][w], norms[k])) for t in own if (w := block.terms[t].decode()) in counts[i])
                assert bound[row, k] >= exact
                tight.append(bound[row, k] <= 1.5 * exact)
    assert seen == n and np.mean(tight) > 0.8


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bw.Words, "hashes", lambda self, prefix=None: np.zeros(len(self.starts), np.uint64))
    t = R.Terms([b"aa", b"bb", b"c"])
    text = np.frombuffer(b"bb x c aa ab", np.uint8)
    w = bw.Words(text, np.array([0, len(text)]), bw.ALNUM)
    word, number = t.found(w, w.hashes())
    assert sorted(zip(word.tolist(), number.tolist())) == [(0, 1), (2, 2), (3, 0)]


def test_query_equals_its_sql(spark):
    import duckdb
    from tempora.llm import queries as Q
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.sql(Q.SQL["op12_ranked_search"]).fetchall())
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in Q.op12_ranked_search(spark, sf).collect())
    assert got == want
