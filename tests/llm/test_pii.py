import math
import re
from collections import Counter, defaultdict

from tempora.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    d = [int(c) for c in reversed(digits(s))]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base(text):
    text = text or ""
    plan = ((EMAIL, lambda v: True), (IP, lambda v: all(int(p) <= 255 for p in v.split("."))),
            (CARD, lambda v: 12 <= len(digits(v)) <= 19 and luhn(v)), (PHONE, lambda v: 9 <= len(digits(v)) <= 15))
    return sorted((m.start(), k, m.end(), m[0]) for k, (p, ok) in enumerate(plan) for m in p.finditer(text) if ok(m[0]))


def words(text):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]


def terms(docs):
    """The disclosing terms by definition, per distinct row: spans of every occurrence."""
    n, df, stem = len(docs), Counter(), Counter()
    for _, text in docs:
        for w in {w for w in re.split(r"[^\w]|_", (text or "").lower()) if w}:
            df[w] += 1
            stem[w[:P.STEM]] += 1
    both, entity, names = Counter(), Counter(), {}
    for key in set(docs):
        text = key[1] or ""
        spans = base(text)
        if not spans:
            continue
        names[key] = {f"{P.KINDS[k]}:{v.lower()}" for _, k, _, v in spans}
        covered = {i for s, _, e, _ in spans for i in range(s, e)}
        # a word is cut by a span beside it
        own = {w for a, b, w in words("".join("\u2603" if i in covered else c for i, c in enumerate(text)))
               if a - 1 not in covered and b not in covered}
        for e in names[key]:
            entity[e] += 1
            for t in own:
                both[e, t] += 1
    kinds = {}
    for (e, t), k in both.items():
        share = entity[e] / n
        known = P.SHARE * math.log(n / entity[e])

        def told(d):
            return math.log((k + P.PRIOR * share) / ((d + P.PRIOR) * share))
        if entity[e] < n and told(df[t]) >= known:
            kinds[e, t] = 4 if len(t) > P.STEM and told(min(stem[t[:P.STEM]], n)) < known else 5
    out = {}
    for key in set(docs):
        text, got = key[1] or "", []
        spans = base(text)
        for a, b, w in words(text):
            kind = max((kinds.get((e, w), 0) for e in names.get(key, ())), default=0)
            if kind and not any(a < e and b > s for s, _, e, _ in spans):
                got.append((a, kind, b, w))
        out[key] = sorted(got)
    return out


def fuzz(rng, n):
    bits = ["a@b.c", "x.y@", "@d.e", "1.2.3.4", "255.255.0.1", "256.1.1.1", "001.2.3.004", ".5", "4111 1111 1111 1111", "4111-1111",
            "+1 (578) 555-6437", "+", "12", " ", "-", ".", "%", "é", "☃", "\n", "+49", "(0)", "foo", "\U0001F600", "5555555555554444", "@", "_"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_base_spans_match_plain_patterns(spark, rng):
    texts = fuzz(rng, 1200) + [None, "", "9" * 3000, "1." * 2000, "a" * 3000 + "@", "a@" + "b." * 1500 + "c", "+1" + " (" * 2000,
                               "4111 1111 1111 1111 " * 40, "a@b.c%d@e.f", "a@b.c.@d.e", "1.2.3.4.5.6.7.8"]
    d = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in P.report(d).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base(t), t


def test_counts_and_digests_of_the_query(spark, rng, tmp_path):
    """Each kind is counted by itself, on null and repeated ids and rows too."""
    import hashlib

    from tempora.llm import queries as Q
    texts = ["1.2.3.4 5.6.7.8 a@b.c +1 (578) 555-6437", "4111 1111 1111 1111", "a@b.c d@e.f g@h.i", "+1 (578) 555-6437", "", None] + fuzz(rng, 300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[1]), (None, texts[0]), (None, None), (2, texts[2]), (2, texts[2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in Q.op10_pii(spark, str(tmp_path)).drop("spans").collect())

    def want(i, t):
        spans = base(t)
        digest = hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e, _ in spans).encode()).hexdigest()
        return (i, *[sum(k == x for _, x, _, _ in spans) for k in range(4)], digest)
    assert got == Counter(want(*r) for r in rows)


def disclosing_docs(rng):
    docs = []
    for i in range(3000):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(8)]
        if i < 6:
            w[3:3] = ["zarniwoop", "boss%d@firm.example" % 1, "herring", "alpha"]
        elif i < 12:
            w[2:2] = ["+1 (578) 555-64%02d" % i, "unique%d" % i]
        elif i < 20:
            w += ["herringbone", "herald"]
        elif i < 900:
            w += ["unify", "universe"][i % 2:][:1]
        docs.append((i, " ".join(w)))
    return docs + [(4000, None), (4001, ""), (0, docs[0][1]), (None, "x boss1@firm.example zarniwoop"), (5, "other text for the id")]


def test_disclosing_terms_match_definition(spark, rng):
    docs = disclosing_docs(rng)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = terms(docs)
    assert any(want.values())
    got = defaultdict(list)
    for r in P.find(d).collect():
        got[r.id].append([tuple(s) for s in r.terms])
    for i, t in docs:
        assert want[i, t] in got[i]
    kinds = {k for v in want.values() for _, k, _, _ in v}
    assert kinds == {4, 5} and sum(map(len, want.values())) > 10


def test_sanitised_texts(spark, rng):
    docs = disclosing_docs(rng)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, base int")
    out = P.sanitise(d)
    assert out.columns == d.columns
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert "@firm" not in (r.text or "") and "zarniwoop" not in (r.text or "") and "555-64" not in (r.text or "")
    assert {r.text for r in rows if r.doc_id in (4000, 4001)} == {None, ""}
    assert any("[EMAIL]" in (r.text or "") for r in rows) and any("[PHONE] uni*" in (r.text or "") for r in rows)
    assert not any(re.search(r"unique\d", r.text or "") for r in rows)


def test_empty_table(spark):
    assert P.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_of_a_single_mention_are_judged(spark, rng):
    docs = [(i, " ".join(rng.choice(["alpha", "gamma", "delta", "omega"]) for _ in range(8))) for i in range(3000)]
    docs[5] = (5, "alpha zarniwoop ford@guide.example gamma")
    docs[6] = (6, "delta omega +1 (578) 555-6437 quillfeather alpha")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.sanitise(d).where("doc_id in (5, 6)").collect()}
    assert got == {5: "alpha  [EMAIL] gamma", 6: "delta omega [PHONE]  alpha"}


def test_terms_far_from_the_mention_and_short_ones(spark, rng):
    far = " ".join(["alpha", "gamma"] * 60)
    docs = [(i, " ".join(rng.choice(["alpha", "gamma", "delta", "omega"]) for _ in range(8))) for i in range(3000)]
    docs[5] = (5, f"ford@guide.example {far} zarniwoop {far} Ix zarniwoop")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert P.sanitise(d).where("doc_id = 5").first().text == f"[EMAIL] {far}  {far}  "


def test_a_common_entity_costs_rows_in_proportion(spark, rng):
    """Documents that share an entity meet their own words only: twice the documents, about twice the rows."""
    def rows(n):
        # 20 words for every ten documents: a word that is met once beside an entity of a third of all documents
        # tells too little (P(e | t) shrinks to 2/3); ten joint documents are past the threshold
        docs = [(i, " ".join("w%dx%d" % (i // 10, j) for j in range(20)) + " boss@firm.example") for i in range(n)]
        docs += [(n + i, "plain words here") for i in range(2 * n)]
        d = spark.createDataFrame(docs, "id long, text string")
        found = P.base_spans(P._with_keys(d, "id", "text"))
        said = P.spoken(found.where("size(base) > 0").dropDuplicates(["k1", "k2"])).checkpoint()
        told = P._pairs(said).join(P.disclosing(found, said, d), ["entity", "term"])
        return told.count(), {r.id: [tuple(s) for s in r.terms] for r in P.find(d, "id").where("size(base) > 0").collect()}
    (a, got), (b, _) = rows(200), rows(400)
    assert 0 < a <= 200 * 20 and 1.8 <= b / a <= 2.2
    assert all(len(v) == 20 for v in got.values())
