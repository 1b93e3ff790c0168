"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are maximal runs of letters, digits and non-ASCII characters, only A-Z
lower-cased.  A term of weight w that occurs tf times in a document of length norm m adds
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` to its score.

1. Index.  Documents are packed into blocks of like size.  A block is a matrix of bits,
   one column a document, one row (slice) a hash position; each term sets ``HASHES``
   bits in its document's column, once for each of the frequencies ``LEVELS`` that it
   reaches.  The number of rows follows the fullest document, so a bit that was not
   set is missed with less than one in a thousand; a bit that was set is always found.
2. Bounds.  The AND of a term's slices is a bitmap of the documents that may hold it
   that often; it overestimates.  The term's weight times the most that such a
   frequency can add, summed over the terms, bounds every document's score from above.
3. The ten documents of highest bound of each item are scored exactly.  Their tenth score
   is a proven threshold: whatever has a lower bound is excluded.
4. All other documents, ties with the threshold included, are scored exactly from
   their whole texts, and ranked.

Corpus counts (documents, lengths, document frequencies) are exact and come from all
documents; a term is compared byte by byte, its hash only nominates.

Scale: items are taken in blocks of ``ITEM_BYTES`` of text, each broadcast to the
scans (a block's terms are no more than its text); the index is built once.  Texts are never
shuffled as a whole: only texts that must be scored leave the scan, found by a
broadcast of their keys up to ``BROADCAST_KEYS`` and by a join on the keys
beyond that.  Copies of one text (equal SHA-256) are scored once, and of these no more
than the ``k`` smallest ids, all that an answer can name, go on.

Defined cases: null, empty and termless texts have no terms and are never found; items
without terms have no rows; items that share an id are one item with the terms of all,
a null id is an id; documents are told apart by row: a repeated id
is ranked for each of its rows; ties go to the smaller id, null last; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import bytewords as bw

K = 10
HASHES = 6
BITS = 16
LEVELS = (1, 2, 3, 5, 9)
DOCS = 1024
BUFFER_DOCS = 4096
BUFFER_HASHES = 1 << 21
MATRIX = 1 << 25
TERMS = 2048
ENTRIES = 8192
ITEM_BYTES = 1 << 20
BROADCAST_KEYS = 100_000
U = np.uint64


# --- terms ------------------------------------------------------------------

class Terms:
    """Distinct terms by number: their bytes, and their sorted hashes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        size = np.array([len(t) for t in terms], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        h = bw.Words(data, first, np.ones(256, bool), lower=False).hashes() if len(terms) else np.zeros(0, U)
        order = np.argsort(h, kind="stable")
        self.hashes, self.number, self.data, self.first, self.size = h[order], order, data, first, size
        _, same = np.unique(h, return_counts=True)
        self.most = int(same.max(initial=0))

    def found(self, w: bw.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term number) of every word that is a term, compared byte by byte."""
        at = np.searchsorted(self.hashes, h)
        words, numbers = [], []
        for k in range(self.most):
            ok = np.flatnonzero((at + k < len(self.hashes)) & (self.hashes[np.minimum(at + k, len(self.hashes) - 1)] == h))
            number = self.number[at[ok] + k]
            size = self.size[number]
            same = w.ends[ok] - w.starts[ok] == size
            ok, number, size = ok[same], number[same], size[same]
            if not len(ok):
                continue
            begin = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(begin, size)
            equal = w.data[np.repeat(w.starts[ok], size) + within] == self.data[np.repeat(self.first[number], size) + within]
            equal = np.logical_and.reduceat(equal, begin)
            words.append(ok[equal])
            numbers.append(number[equal])
        return (np.concatenate(words), np.concatenate(numbers)) if words else (np.zeros(0, np.int64),) * 2


def _counted(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, value, occurrences) of every distinct pair, by text."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (value[1:] != value[:-1]))))
    return text[head], value[head], np.diff(head, append=len(text))


@dataclass
class Items:
    """A block of items: ids, terms, and each item's term numbers."""
    ids: list
    terms: list[bytes]
    rows: list[np.ndarray]


def _items(rows: list) -> Items:
    """Items from ``(id, texts)`` rows."""
    number: dict[bytes, int] = {}
    ids, lists = [], []
    for id_, texts in rows:
        own = set()
        for t in texts:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            w = bw.Words(raw, np.array([0, len(raw)]), bw.ALNUM)
            low = w.data.tobytes()
            own |= {low[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist())}
        if own:
            ids.append(id_)
            lists.append(np.array(sorted(number.setdefault(t, len(number)) for t in own)))
    return Items(ids, list(number), lists)


# --- index ------------------------------------------------------------------

def _positions(h: np.ndarray, level: int, width: int) -> np.ndarray:
    """The ``HASHES`` slices of each term hash at a level, in a block of ``width`` slices."""
    a = bw.mix(h + bw.salt(level + 1, bw.WORD_SALT))
    step = bw.mix(a ^ U(bw.WINDOW_SALT))
    x = a[:, None] + step[:, None] * np.arange(HASHES, dtype=U)
    return ((x >> U(32)) * U(width) >> U(32)).astype(np.int64)


def _blocks(counts: np.ndarray) -> list[np.ndarray]:
    """Documents by block: at most ``DOCS``, and none with over twice the terms of the least."""
    order = np.argsort(counts, kind="stable")
    size, out, at = counts[order], [], 0
    while at < len(order):
        top = max(64, 2 * int(size[at]))
        hi = at + int(np.searchsorted(size[at:at + DOCS], top, "right"))
        hi = min(hi, at + max(8, MATRIX // (BITS * top)))
        out.append(order[at:hi])
        at = hi
    return out


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ids, texts, lengths, width, slices`` of every block of documents with terms.

    ``texts`` are the SHA-256 of the texts, ``slices`` the bit matrix by rows."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        ids, shas, lengths, parts, held = [], [], [], [], 0

        def flush():
            # parts: (document of each entry, term hash, occurrences), documents numbered in the buffer
            doc, h, tf = (np.concatenate(x) for x in zip(*parts))
            per_doc = np.zeros(len(ids), np.int64)
            for t in LEVELS:
                per_doc += np.bincount(doc[tf >= t], minlength=len(ids))
            first = np.searchsorted(doc, np.arange(len(ids) + 1))
            for block in _blocks(per_doc):
                width = max(64, BITS * int(per_doc[block].max()))
                m = np.zeros((width, -(-len(block) // 8) * 8), bool)
                size = first[block + 1] - first[block]
                at = np.arange(int(size.sum())) + np.repeat(first[block] - np.cumsum(size) + size, size)
                column = np.repeat(np.arange(len(block)), size)
                for level, t in enumerate(LEVELS):
                    has = tf[at] >= t
                    m[_positions(h[at[has]], level, width), column[has][:, None]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([[ids[i] for i in block]]), pa.array([[shas[i] for i in block]], pa.list_(pa.binary())),
                     pa.array([[lengths[i] for i in block]], pa.list_(pa.int64())), pa.array([width], pa.int32()),
                     pa.array([np.packbits(m, axis=1).tobytes()], pa.binary())],
                    names=["ids", "texts", "lengths", "width", "slices"]).cast(schema)
        for b in batches:
            for lo, hi, data, off in bw.runs(b.column(1)):
                w = bw.Words(data, off, bw.ALNUM)
                some = np.flatnonzero(w.counts)
                if not len(some):
                    continue
                text, h, tf = _counted(w.text_of_word(), w.hashes())
                number = np.zeros(hi - lo, np.int64)
                number[some] = np.arange(len(some)) + len(ids)
                parts.append((number[text], h, tf))
                ids += b.column(0).take(pa.array(some + lo)).to_pylist()
                shas += b.column(2).take(pa.array(some + lo)).to_pylist()
                lengths += w.counts[some].tolist()
                held += len(h)
                if len(ids) >= BUFFER_DOCS or held >= BUFFER_HASHES:
                    yield from flush()
                    ids, shas, lengths, parts, held = [], [], [], [], 0
        if ids:
            yield from flush()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T
    out = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("texts", T.ArrayType(T.BinaryType())),
                        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("width", T.IntegerType()),
                        T.StructField("slices", T.BinaryType())])
    schema = to_arrow_schema(out)
    d = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"), _sha(F.col(text_col)).alias("sha"))
    return d.mapInArrow(run, out)


def _sha(text):
    return F.unhex(F.sha2(text, 256))


# --- scores -----------------------------------------------------------------

@dataclass
class Corpus:
    """Exact counts: documents with terms, their lengths, and weights of a block's terms."""
    n: int
    total: int
    weights: np.ndarray

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        if int(lengths.max(initial=0)) * 90 * self.n < 1 << 63:
            return 10 + 90 * lengths * self.n // self.total
        return np.array([10 + 90 * int(x) * self.n // self.total for x in lengths], np.int64)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def gain(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norms)


def frequencies(docs: DataFrame, text_col: str, items: Items) -> np.ndarray:
    """Exact number of documents that hold each term of a block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches):
        terms = Terms(shared.value)
        df = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for _, _, data, off in bw.runs(b.column(0)):
                w = bw.Words(data, off, bw.ALNUM)
                word, number = terms.found(w, w.hashes())
                df += np.bincount(_counted(w.text_of_word()[word], number)[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])
    out = np.zeros(len(items.terms), np.int64)
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in rows.collect():
        out[r.term] = r.df
    return out


class Bounds:
    """Upper bounds of the scores of a block's documents, a few terms at a time."""

    def __init__(self, items: Items, corpus: Corpus):
        self.corpus, self.n, self.hashes = corpus, len(items.rows), _term_hashes(items.terms)
        term = np.concatenate(items.rows)
        item = np.repeat(np.arange(self.n), [len(r) for r in items.rows])
        order = np.lexsort((item, term // TERMS))
        term, item = term[order], item[order]
        #: per run of terms: first term, and slices of its (item, term) entries by item
        self.plan = []
        for lo in range(0, len(self.hashes), TERMS):
            at = np.flatnonzero(term // TERMS == lo // TERMS)
            parts = [at[k:k + ENTRIES] for k in range(0, len(at), ENTRIES)]
            self.plan.append((lo, [self._entries(item[p], term[p] - lo) for p in parts]))

    @staticmethod
    def _entries(item: np.ndarray, term: np.ndarray):
        first = np.flatnonzero(np.diff(item, prepend=-1))
        return item[first], first, term

    def of(self, width: int, slices: bytes, lengths: np.ndarray) -> np.ndarray:
        """One row an item, one column a document."""
        s = np.frombuffer(slices, np.uint8).reshape(width, -1)
        norms, n = self.corpus.norms(lengths), len(lengths)
        steps = [gain(np.minimum(t - 1, lengths), norms) for t in LEVELS] + [gain(lengths, norms)]
        out = np.zeros((self.n, n), np.int64)
        for lo, parts in self.plan:
            hashes = self.hashes[lo:lo + TERMS]
            live, above = np.arange(len(hashes)), None
            total = np.zeros((len(hashes), n), np.int64)
            for level in range(len(LEVELS)):
                rows = _positions(hashes[live], level, width)
                here = s[rows[:, 0]]
                for k in range(1, HASHES):
                    here = here & s[rows[:, k]]
                above = here if above is None else above & here
                some = above.any(1)
                live, above = live[some], above[some]
                if not len(live):
                    break
                # from the most below this level to the most below the next one
                total[live] += np.unpackbits(above, axis=1, count=n) * (steps[level + 1] - steps[level])
            total *= self.corpus.weights[lo:lo + TERMS, None]
            for item, first, term in parts:
                out[item] += np.add.reduceat(total[term], first, axis=0)
        return out


def _candidates(blocks: DataFrame, shared, k: int | None, kind) -> DataFrame:
    """``item, id, sha, bound``: per task the k highest bounds of each item, or (k None) all that
    reach the item's threshold, none below 1."""
    from pyspark.sql import types as T
    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("sha", T.BinaryType()),
                        T.StructField("bound", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(out)
        items, corpus, least = shared.value
        above = Bounds(items, corpus)
        best = [[] for _ in items.ids]

        def rows(found):
            item, id_, sha, bound = zip(*found) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((item, id_, sha, bound), schema)], schema=schema)
        for b in batches:
            for r in b.to_pylist():
                ids, shas = r["ids"], r["texts"]
                bound = above.of(r["width"], r["slices"], np.array(r["lengths"], np.int64))
                if k is None:
                    item, doc = np.nonzero(bound >= least[:, None])
                    if len(item):
                        yield rows([(i, ids[d], shas[d], x) for i, d, x in zip(item.tolist(), doc.tolist(), bound[item, doc].tolist())])
                    continue
                for i in range(len(best)):
                    row = bound[i]
                    floor = best[i][-1][0] if len(best[i]) == k else 0
                    at = np.flatnonzero(row > floor)
                    if len(at):
                        at = at[np.argsort(-row[at], kind="stable")[:k]]
                        best[i] = sorted(best[i] + [(int(row[d]), ids[d], shas[d]) for d in at], key=lambda e: -e[0])[:k]
        if k is not None:
            yield rows([(i, id_, sha, x) for i, found in enumerate(best) for x, id_, sha in found])
    return blocks.mapInArrow(run, out)


def _term_hashes(terms: list[bytes]) -> np.ndarray:
    t = Terms(terms)
    out = np.zeros(len(terms), U)
    out[t.number] = t.hashes
    return out


def exact_scores(docs: DataFrame, text_col: str, wanted: DataFrame, shared) -> DataFrame:
    """``item, sha, score`` of the wanted ``item, sha`` pairs, from the whole texts."""
    pairs = wanted.groupBy("sha").agg(F.collect_set("item").alias("items")).checkpoint()
    texts = docs.select(_sha(F.col(text_col)).alias("sha"), F.col(text_col).alias("text"))
    few = pairs.count() <= BROADCAST_KEYS
    keys = pairs.select("sha")
    texts = texts.join(F.broadcast(keys) if few else keys, "sha", "left_semi").dropDuplicates(["sha"])

    def run(batches):
        items, corpus, _ = shared.value
        terms = Terms(items.terms)
        for b in batches:
            got = []
            column = b.column(1)
            for lo, hi, data, off in bw.runs(column):
                w = bw.Words(data, off, bw.ALNUM)
                word, number = terms.found(w, w.hashes())
                text, number, tf = _counted(w.text_of_word()[word], number)
                norms = corpus.norms(w.counts)
                points = corpus.weights[number] * gain(tf, norms[text])
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    mine = slice(first[k], first[k + 1])
                    value = np.zeros(len(items.terms), np.int64)
                    value[number[mine]] = points[mine]
                    sha = b.column(0)[lo + k].as_py()
                    got += [(i, sha, int(value[items.rows[i]].sum())) for i in b.column(2)[lo + k].as_py()]
            item, sha, score = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(sha, pa.binary()), pa.array(score, pa.int64())],
                                             names=["item", "sha", "score"])
    return texts.join(pairs, "sha").select("sha", "text", "items").mapInArrow(run, "item int, sha binary, score long").where("score > 0")


def _ranked(found: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """``item, rank, id, score`` of the k best rows of each item."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (found.join(scores, ["item", "sha"]).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("item", "rank", "id", "score"))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K) -> DataFrame:
    """``item_col, rank, id_col, score``: the k best documents of every item."""
    from functools import reduce
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, dict(items.dtypes)[item_col]
    blocks = index(docs, id_col, text_col).checkpoint()
    sizes = blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // ITEM_BYTES))
    out = []
    for part in range(parts if sizes.n else 0):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).groupBy("id").agg(F.collect_list("text").alias("texts"))
        block = _items([(r.id, r.texts) for r in mine.orderBy("id").collect()])
        if not block.ids:
            continue
        df = frequencies(docs, text_col, block)
        corpus = Corpus(sizes.n, sizes.total, np.array([weight(sizes.n, int(x)) for x in df], np.int64))
        shared = spark.sparkContext.broadcast((block, corpus, None))
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("id"))
        first = (_candidates(blocks, shared, k, kind).withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= k)
                 .select("item", "id", "sha").checkpoint())
        scored = exact_scores(docs, text_col, first.select("item", "sha"), shared)
        least = np.ones(len(block.ids), np.int64)
        for r in _ranked(first, scored, k).where(F.col("rank") == k).collect():
            least[r.item] = r.score
        reach = spark.sparkContext.broadcast((block, corpus, least))
        copies = Window.partitionBy("item", "sha").orderBy(F.asc_nulls_last("id"))
        found = (_candidates(blocks, reach, None, kind).withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k)
                 .select("item", "id", "sha").checkpoint())
        best = _ranked(found, exact_scores(docs, text_col, found.select("item", "sha"), reach), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, name {item_kind}")
        out.append(best.join(names, "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not out:
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, {id_col} {dict(docs.dtypes)[id_col]}, score long")
    return reduce(DataFrame.unionByName, out)
