import hashlib

import numpy as np

from tempora.llm import suffix_dedup as S
from tests.llm.conftest import words


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(data):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], []).append((i, s))
    cover = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s:s + length] = True
    out = []
    for b, c in zip(data, cover):
        kept = np.frombuffer(b, np.uint8)[~c].tobytes() if b else b""
        runs = int((np.diff(np.concatenate(([0], c.view(np.int8)))) == 1).sum()) if len(b) else 0
        out.append((len(b), int(c.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fixture(rng):
    texts = [words(rng, rng.randrange(20, 260), 10 ** 6) for _ in range(30)]
    passage = words(rng, 70, 10 ** 6)                         # over 400 bytes
    exact = words(rng, 200, 10 ** 6).encode()[:400].decode()  # exactly one window
    for i in range(25):
        texts.append(words(rng, rng.randrange(5, 60), 10 ** 6) + (" " if i % 2 else "é") + passage[rng.randrange(0, 30):] + words(rng, 20, 10 ** 6))
    for i in range(4):
        texts.append(f"{i}" + exact + "xyzw"[i])
    for i in range(12):                                        # near copies: a letter changed here and there
        t = list(texts[3] + texts[4])
        for _ in range(i % 4):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [texts[0]] * 3 + ["a" * 1500, "a" * 399, "ab" * 700, "b" + "ab" * 300, "ß☃" * 400, "☃" * 400]
    texts += [texts[1] + texts[1], exact, exact[:-1], None, "", "short", None]
    return texts


def test_matches_brute_force(spark, rng):
    texts = fixture(rng)
    d = spark.createDataFrame([(i, t, b"x", 0) for i, t in enumerate(texts)], "doc_id long, text string, kept binary, rid int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed) // 2, hashlib.sha256(bytes(r.kept)).hexdigest())
           for r in S.dedup(d).collect()}
    want = brute(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_several_ranges(spark, rng, monkeypatch):
    monkeypatch.setattr(S, "RANGE_BYTES", 20_000)     # many ranges and buckets on a small input
    monkeypatch.setattr(S, "BUCKET_BYTES", 4_000)
    texts = fixture(rng)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_bytes - len(r.kept) for r in S.dedup(d).collect()}
    assert [got[i] for i in range(len(texts))] == [w[1] for w in brute(texts)]


def test_null_and_repeated_ids(spark, rng):
    t = words(rng, 120, 10 ** 6)
    d = spark.createDataFrame([(None, t), (None, "x" + t), (4, t), (4, "alone"), (4, t)], "doc_id long, text string")
    got = sorted((r.n_bytes, len(r.kept)) for r in S.dedup(d).collect())
    assert got == sorted([(len(t), 0), (len(t) + 1, 1), (len(t), 0), (5, 5), (len(t), 0)])
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_front_coded_runs_merge_in_order(rng):
    alphabet = b"ab"
    for _ in range(60):
        runs = [sorted((bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))), b"L%d" % j, i, j)
                       for j in range(rng.randrange(0, 9))) for i in range(rng.randrange(1, 7))]
        coded = [S.front_code(r) for r in runs if r]
        assert [[(a, c, d, e) for a, _, c, d, e in S.read_run(x)] for x in coded] == [r for r in runs if r]
        out = list(S.merge_runs([S.read_run(x) for x in coded]))
        flat = [e[0] for e, _ in out]
        assert flat == sorted(x[0] for r in runs for x in r)
        for k, (e, shared) in enumerate(out):
            assert shared == (S.shared_prefix(flat[k - 1], flat[k]) if k else 0)


def test_known_prefixes_are_never_compared_again(monkeypatch):
    """Each byte beyond a known prefix is looked at; the bytes before it are not."""
    looked = []
    plain = S.shared_prefix
    runs = [sorted((b"p" * 300 + b"%04d" % (7 * i + r), b"", r, i) for i in range(40)) for r in range(6)]
    coded = [S.front_code(r) for r in runs]
    monkeypatch.setattr(S, "shared_prefix", lambda a, b, known=0: looked.append(known) or plain(a, b, known))
    assert len(list(S.merge_runs([S.read_run(x) for x in coded]))) == 240
    assert sum(k < 300 for k in looked) <= 5          # only the first heads meet without a known prefix
