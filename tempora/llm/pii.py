"""Personal data by information-theoretic sanitisation, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns, kept if
they pass their check (parts at most 255; 12 to 19 digits passing Luhn; 9 to 15
digits).  The patterns below are possessive forms with the same matches: an
attempt that cannot succeed is not repeated from the middle of the same run, so
the time is linear in the text and no match recurses.

Every distinct base value is a protected entity e.  All words of its documents
outside base spans co-occur with it, wherever they stand.  Over all documents, with
document frequencies, PMI(e, t) = ln(N * df(e, t) / (df(e) * df(t))) is what a
reader of t learns about e, out of IC(e) = ln(N / df(e)).  P(e | t) is estimated
with a prior of ``PRIOR`` documents in which e is as frequent as in all,
(df(e, t) + PRIOR * df(e) / N) / (df(t) + PRIOR), so every pair is judged,
however rare.  A term that gives away at least ``SHARE`` of IC(e) discloses it;
a single joint document is enough once N is above about a thousand.  If the term's first ``STEM`` letters alone stay below the
threshold the term is generalised to them, else it is removed; either holds for
every occurrence of the term in the documents that hold the entity.

Scale: one scan finds base spans; its result, with the text of the documents that
have any, is written with ``checkpoint()``.  Word frequencies are one map-side combined aggregate
over distinct words per document; entity and term counts shuffle only the
words of documents with base spans; joins are on entity and term together, so a common entity's
rows spread over its terms, and a document's rows are its own words beside its own entities.

Defined cases: null and empty texts have no spans; rows are told apart by a
128-bit key of id and text, so null ids and repeated rows each get their own
text's spans; counts of entities and pairs count distinct keys, those of terms and N count rows; spans of different kinds
may overlap and are all listed, and ``sanitise`` masks the union, naming the
first; an empty table gives no rows; extra columns pass through ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.bytewords import fresh

PRIOR = 1.0
SHARE = 0.9
STEM = 3
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]+"
SEPARATOR = r"[^\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_ok(value: Column) -> Column:
    def part(p):
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))
    return F.forall(F.split(value, r"\."), part)


def _card_ok(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.aggregate(
            F.array(F.substring(d, n - i + 1, F.lit(1)).cast("int")), F.lit(0),
            lambda z, x: F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return n.between(12, 19) & (F.when(n.between(12, 19), total % 10).otherwise(1) == 0)


def _phone_ok(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _matches(text: Column, pattern: str, hint: Column) -> Column:
    """Match strings of a pattern; ``hint`` is a cheap test that texts with a match pass."""
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """0-based code point starts of the matches: cumulative lengths of what lies between them."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    ends = F.aggregate(steps, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s.b + s.m)))
    return F.when(F.size(found) > 0, F.zip_with(F.slice(ends, F.lit(1), F.size(found)), steps, lambda e, s: e + s.b)).otherwise(
        F.array().cast("array<int>"))


def _spans(found: Column, starts: Column, kind: str, ok) -> Column:
    spans = F.zip_with(starts, found, lambda s, v: F.struct(
        s.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s + F.length(v)).cast("long").alias("end"), v.alias("value")))
    return F.filter(spans, lambda x: ok(x.value))


def base_spans(docs: DataFrame, text_col: str = "text", into: str = "base") -> DataFrame:
    """Append the sorted base spans ``array<struct<start, kind, end, value>>``; kind indexes KINDS."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    plan = (("email", EMAIL, t.contains("@"), lambda v: F.lit(True)), ("ip", IP, t.contains("."), _ip_ok),
            ("card", CARD, F.lit(True), _card_ok), ("phone", PHONE, t.contains("+"), _phone_ok))
    names = [fresh(docs, f"m_{k}") for k, *_ in plan]
    df = docs.withColumns({n: _matches(t, p, hint) for n, (_, p, hint, _) in zip(names, plan)})
    lists = [_spans(F.col(n), _starts(t, p, F.col(n)), k, ok) for n, (k, p, _, ok) in zip(names, plan)]
    return df.withColumn(into, F.array_sort(F.concat(*lists))).drop(*names)


def _names(base: Column) -> Column:
    """The distinct entities of the base spans."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_distinct(F.transform(base, lambda s: F.concat(F.element_at(kinds, s.kind + 1), F.lit(":"), F.lower(s.value))))


def _words() -> Column:
    """Distinct lower-case words of ``text`` that no base span touches."""
    t = F.col("text")
    mark = F.lower(F.concat(F.lit("q"), F.hex("k1"), F.hex("k2")))   # in no other text; a word it joins is dropped

    def step(acc, s):
        put = F.concat(acc.out, F.substring(t, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), mark)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, put).otherwise(acc.out).alias("out"))
    rest = F.aggregate("base", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc.out, F.substring(t, (acc.at + 1).cast("int"), F.length(t))))
    words = F.transform(F.regexp_extract_all(rest, F.lit(TERM), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~F.contains(w, mark)))


def _occurrences(kinds: Column) -> Column:
    """Spans of the words of ``text`` that the map ``kinds`` names and no base span touches."""
    t = F.col("text")
    found = F.regexp_extract_all(t, F.lit(TERM), F.lit(0))
    steps = F.zip_with(F.slice(F.split(t, TERM, -1), F.lit(1), F.size(found)), found, lambda b, w: F.struct(F.length(b).alias("b"), w.alias("w")))

    def step(acc, s):
        start = acc.at + s.b
        end, kind = start + F.length(s.w), F.element_at(kinds, F.lower(s.w))
        hit = kind.isNotNull() & ~F.exists("base", lambda x: (start < x.end) & (end > x.start))
        span = F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"), F.lower(s.w).alias("value"))
        return F.struct(end.alias("at"), F.when(hit, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc.out)


def spoken(held: DataFrame) -> DataFrame:
    """``k1, k2, names, words`` of each distinct document with spans: its entities and its words."""
    return held.select("k1", "k2", _names(F.col("base")).alias("names"), _words().alias("words"))


def _pairs(said: DataFrame) -> DataFrame:
    """``k1, k2, entity, term``: every word of a document beside every entity of the same document."""
    return (said.select("k1", "k2", F.explode("names").alias("entity"), "words")
            .select("k1", "k2", "entity", F.explode("words").alias("term")))


def disclosing(found: DataFrame, said: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``entity, term, kind`` for the terms that disclose; ``said`` is ``spoken`` of the documents with spans."""
    pairs = _pairs(said).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_both"))
    entities = said.select(F.explode("names").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    terms = (docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), SEPARATOR))).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("df_term")).where(F.length("term") > 0))
    stem = F.substring("term", 1, STEM)
    wanted = pairs.select("term").distinct()
    counts = terms.join(wanted, "term", "left_semi").withColumn("stem", stem)
    stems = (terms.groupBy(stem.alias("stem")).agg(F.sum("df_term").alias("df_stem"))
             .join(wanted.select(stem.alias("stem")).distinct(), "stem", "left_semi"))
    n = float(found.count())
    known = F.lit(SHARE) * F.log(F.col("n") / F.col("df_entity"))

    def told(df):
        share = F.col("df_entity") / F.col("n")
        return F.log((F.col("df_both") + PRIOR * share) / ((df + PRIOR) * share))
    joined = (pairs.join(entities, "entity").join(counts, "term").join(stems, "stem")
              .withColumn("n", F.lit(n)))
    whole = F.least(F.col("df_stem").cast("double"), F.col("n"))
    return (joined.where((F.col("df_entity") < F.col("n")) & (told(F.col("df_term")) >= known))
            .select("entity", "term", F.when((F.length("term") > STEM) & (told(whole) < known), F.lit(KINDS.index("generalise")))
                    .otherwise(F.lit(KINDS.index("remove"))).alias("kind")))


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t, i = F.col(text_col), F.col(id_col)
    return docs.withColumns({"k1": F.xxhash64(i, t, i.isNull(), t.isNull()), "k2": F.xxhash64(F.lit(1), t, i, t.isNull())})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, base, terms, k1, k2``; both lists hold ``start, kind, end, value``, sorted."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    df = base_spans(_with_keys(src, "id", "text"))
    found = df.select("id", "k1", "k2", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")).checkpoint()
    held = found.where(F.size("base") > 0).dropDuplicates(["k1", "k2"])
    said = spoken(held).checkpoint()
    # a document meets only the terms that it holds itself, however many documents share an entity
    told = (_pairs(said).join(disclosing(found, said, src), ["entity", "term"])
            .groupBy("k1", "k2", "term").agg(F.max("kind").alias("kind"))
            .groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("told")))
    terms = held.join(told, ["k1", "k2"]).select("k1", "k2", _occurrences(F.col("told")).alias("terms"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return (found.drop("text").join(terms, ["k1", "k2"], "left")
            .select("id", "base", F.coalesce("terms", none).alias("terms"), "k1", "k2"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, base, terms, all_spans`` and a count of each base kind."""
    df = find(docs, id_col, text_col)

    def count(i):       # not a default argument: a second parameter of the filter's function is the element's position
        return F.size(F.filter("base", lambda s: s.kind == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return df.select(F.col("id").alias(id_col), *counts, "base", "terms", F.array_sort(F.concat("base", "terms")).alias("all_spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns; base spans become [KIND], disclosing terms their stem and a star, or go."""
    keyed = _with_keys(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    found = (find(docs, id_col, text_col).dropDuplicates(["k1", "k2"])
             .select("k1", "k2", F.array_sort(F.concat("base", "terms")).alias("spans")).where(F.size("spans") > 0))
    t = F.col("text")
    masks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def mask(s):
        return (F.when(s.kind == KINDS.index("remove"), F.lit(""))
                .when(s.kind == KINDS.index("generalise"), F.concat(F.substring(s.value, 1, STEM), F.lit("*")))
                .otherwise(F.element_at(masks, s.kind + 1)))

    def step(acc, s):
        put = F.concat(acc.out, F.substring(t, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), mask(s))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, put).otherwise(acc.out).alias("out"))
    clean = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc.out, F.substring(t, (acc.at + 1).cast("int"), F.length(t))))
    df = keyed.join(found, ["k1", "k2"], "left").withColumn("clean", F.when(F.col("spans").isNull(), t).otherwise(clean))
    return df.select(*[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
