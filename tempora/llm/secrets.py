"""Secret scans: a random forest that removes false positives.

Candidates are runs of at least ``MIN_LENGTH`` token characters (letters,
digits, ``_ + / -`` and closing ``=``) anywhere in a whole text, and, from ``MIN_VALUE``
characters on and with any punctuation inside, what is assigned (``=``, ``:``) to an announcing name or stands in
quotes after ``=`` or ``:``; where two overlap, the longer one.  Short passwords are candidates
like long keys; telling them from other values is the forest's work.  Their
features: length and character make-up; the mean log-probability of the
character transitions under a bigram model of the whole corpus; dictionary
coverage, the share of the candidate's characters inside frequent corpus words
of three to ten letters; the path it was found under; and the neighbouring words and
characters.  The forest (``pyspark.ml``) is trained on labelled findings, at
most ``FIT_ROWS`` of them (a documented bound; the rows of smallest hash).

The corpus statistics cover all documents and are bounded: a 256 x 256
transition table and the 64-bit hashes of the frequent words, those that make
up at least ``SHARE`` of all words of three to ten letters.  There are at most
1 / SHARE of them at any corpus size, so a probe hits by chance with less than
1 / (SHARE * 2**64).  Words are counted exactly, by an aggregate on their
hashes; shares are smoothed by ``FREQUENT`` / ``SHARE`` further words, so in a small corpus, where
few occurrences say nothing about a share, a word needs some ``FREQUENT`` of them.  The trained trees, read
back from the model's saved form, are a few thousand nodes; they are broadcast
and scored where the documents lie, so the scan has no shuffle.

Defined cases: null and empty texts have no candidates; a null path has empty
path features; repeated rows are scanned each; with no labelled finding of one
of the two classes every candidate gets the share of the positive class (0
without any); an empty corpus gives an empty dictionary; extra columns pass
through ``redact`` and are not read by ``scan``.  Offsets count code points.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import bytewords as bw
from tempora.session import checkpoint_dir

MIN_LENGTH = 16
FIT_ROWS = 100_000
SHARE = 1e-5
FREQUENT = 20
GATHER = 1 << 20
BATCH = 1 << 16
TREES, DEPTH = 40, 8
REACH = 48
MASK = "[SECRET]"
MIN_VALUE = 6
CANDIDATE = re.compile(r"[A-Za-z0-9_+/-]{%d,}={0,2}" % MIN_LENGTH)
WORD = re.compile(r"\w+")
# Words that announce a credential.
ANNOUNCING = ("token", "key", "secret", "password", "passwd", "pwd", "api", "auth", "credential", "bearer")
# What is assigned: a quoted value, or after an announcing name also a bare one.
QUOTED = re.compile(r"""[=:]\s{0,8}(?:"([^"\s]{%d,})"|'([^'\s]{%d,})')""" % (MIN_VALUE, MIN_VALUE))
NAMED = re.compile(r"""(?:%s)\w{0,40}["']?\s{0,8}[=:]\s{0,8}(?![\s"'])([^\s"',;)\]}>]{%d,})""" % ("|".join(ANNOUNCING), MIN_VALUE), re.IGNORECASE)
# Parts of a path where sample values are common.
SAMPLE_PATHS = ("test", "example", "sample", "doc", "fixture", "mock")
HASHED = 16
FINDING = "array<struct<start:long,length:long,candidate:string,before:string,after:string,features:array<double>,probability:double>>"
ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("candidate", pa.string()), ("before", pa.string()),
                            ("after", pa.string()), ("features", pa.list_(pa.float64())), ("probability", pa.float64())]))


@dataclass
class Statistics:
    """Corpus statistics: transition log-probabilities and the sorted hashes of the frequent words."""
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((256, 256)))
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def statistics(docs: DataFrame, text_col: str = "text") -> Statistics:
    """Transition and word counts over all documents."""
    def rows(word, k, n):
        for lo in range(0, len(k), BATCH):
            part = slice(lo, lo + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), word)), pa.array(k[part]), pa.array(n[part].astype(np.int64))],
                                             names=["word", "k", "n"])

    def count(batches):
        pairs, parts, held = np.zeros(65536, np.int64), [], 0
        for b in batches:
            for _, _, data, off in bw.runs(b.column(0)):
                w = bw.Words(data, off, bw.ALNUM)
                size = w.ends - w.starts
                edge = np.zeros(len(data) + 1, np.int8)
                edge[w.starts] += 1
                edge[w.ends] -= 1
                inside = np.cumsum(edge[:-1]) > 0
                inside[w.starts] = False   # a transition ends at every byte of a word but its first
                at = np.flatnonzero(inside)
                pairs += np.bincount(w.data[at - 1].astype(np.int64) * 256 + w.data[at], minlength=65536)
                parts.append(w.hashes()[(size >= 3) & (size <= 10)].view(np.int64))
                held += len(parts[-1])
                if held >= GATHER:
                    yield from rows(True, *np.unique(np.concatenate(parts), return_counts=True))
                    parts, held = [], 0
        if parts:
            yield from rows(True, *np.unique(np.concatenate(parts), return_counts=True))
        at = np.flatnonzero(pairs)
        yield from rows(False, at, pairs[at])
    counts = (docs.select(text_col).mapInArrow(count, "word boolean, k long, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))
              .checkpoint())
    total = counts.where("word").agg(F.sum("n").alias("n")).first().n or 0
    got = counts.where(~F.col("word") | (F.col("n") >= SHARE * total + FREQUENT)).toArrow()
    word, k, n = (got[c].to_numpy() for c in ("word", "k", "n"))
    table = np.full(65536, 0.1)
    table[k[~word]] += n[~word]
    table = table.reshape(256, 256)
    return Statistics(np.log(table / table.sum(1, keepdims=True)), np.sort(k[word].view(np.uint64)))


def _coverage(data: bytes, s: Statistics) -> float:
    """Share of the bytes inside frequent corpus words of three to ten bytes."""
    w = bw.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.ones(256, bool))
    c, n = w.prefix_sums(), len(data)
    cover = np.zeros(n + 1, np.int64)
    for size in range(3, min(10, n) + 1 if len(s.frequent) else 0):
        lo = np.arange(n - size + 1)
        h = bw.mix(bw.range_hash(c, lo, lo + size, bw.BYTE_BASE) + bw.salt(size, bw.WORD_SALT))
        at = lo[s.frequent[np.searchsorted(s.frequent[:-1], h)] == h]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
    return float((np.cumsum(cover[:-1]) > 0).mean())


def _hash(word: str) -> int:
    h = 0
    for b in word.encode():
        h = (h * 131 + b) & 0xFFFFFFFF
    return h % HASHED


def features(candidate: str, before: str, after: str, path: str | None, s: Statistics) -> list[float]:
    data = candidate.encode()
    a = np.frombuffer(data.lower(), np.uint8)
    n = len(candidate)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    p = share[share > 0]
    path = (path or "").lower()
    left, right = WORD.findall(before.lower()), WORD.findall(after.lower())
    near = left[-1] if left else ""
    hashed = [0.0] * (2 * HASHED)
    for word in left[-3:]:
        hashed[_hash(word)] = 1.0
    for word in right[:3]:
        hashed[HASHED + _hash(word)] = 1.0
    digits = sum(c.isdigit() for c in candidate) / n
    return [
        float(n), digits, sum(c.isupper() for c in candidate) / n, sum(c in "abcdef0123456789" for c in candidate) / n,
        float(-(p * np.log2(p)).sum()), float(s.transitions[a[:-1], a[1:]].mean()), _coverage(data.lower(), s),
        float(len(path)), float(path.count("/")), float(any(x in path for x in SAMPLE_PATHS)),
        float(any(x in near for x in ANNOUNCING)), float(any(x in w for w in left[-3:] for x in ANNOUNCING)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(bool(re.search(r"[\"']$", before))),
        float(bool(re.match(r"[\"']", after))), float(not before[-1:].strip()), float(not after[:1].strip()),
        *hashed]


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), threshold, children, probability of a secret."""
    trees: list[tuple[np.ndarray, ...]]
    share: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), self.share)
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), f.clip(min=0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += value[at]
        return total / len(self.trees)


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate of a text, in order and without overlaps."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if "=" in text or ":" in text:
        found += [m.span(1) if m.group(1) is not None else m.span(2) for m in QUOTED.finditer(text)]
        found += [m.span(1) for m in NAMED.finditer(text)]
        # the longer of two that overlap, the earlier of equals
        kept: list[tuple[int, int]] = []
        for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
            if kept and a < kept[-1][1]:
                if b - a > kept[-1][1] - kept[-1][0]:
                    kept[-1] = (a, b)
                continue
            kept.append((a, b))
        found = kept
    return found


def _candidates(texts, paths, stats: Statistics, forest: Forest | None) -> list[list[dict]]:
    """The candidates of each text of a batch, with features and, given a forest, probability."""
    out = []
    for text, path in zip(texts, paths):
        text, path, found = text.as_py() or "", path.as_py(), []
        for start, end in spans(text):
            before, after, value = text[max(0, start - REACH):start], text[end:end + REACH], text[start:end]
            found.append({"start": start, "length": end - start, "candidate": value, "before": before,
                          "after": after, "features": features(value, before, after, path, stats), "probability": None})
        out.append(found)
    flat = [c for found in out for c in found]
    if forest is not None and flat:
        for c, p in zip(flat, forest.probability(np.array([c["features"] for c in flat]))):
            c["probability"] = float(p)
    return out


def train(findings: DataFrame) -> Forest:
    """Fit the forest on labelled findings: ``features array<double>, label``."""
    # imported here: Python workers, which import this module too, have no use for it
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    spark = findings.sparkSession
    rows = (findings.where("label is not null").select("features", F.col("label").cast("double").alias("label"))
            .orderBy(F.xxhash64("features"), "label").limit(FIT_ROWS)
            .select(array_to_vector("features").alias("features"), "label").checkpoint())
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).first()
    if not seen.n or not 0 < seen.y < seen.n:
        return Forest([], float((seen.y or 0) / max(1, seen.n)))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, featureSubsetStrategy="sqrt").fit(rows)
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in saved.columns else F.struct(*[c for c in saved.columns if c != "treeID"])
    trees: dict[int, dict] = {}
    for r in saved.select("treeID", node.alias("n")).toLocalIterator():
        trees.setdefault(r.treeID, {})[r.n.id] = r.n
    out = []
    for _, nodes in sorted(trees.items()):
        size = max(nodes) + 1
        feature, left, right = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
        threshold, value = np.zeros(size), np.zeros(size)
        for i, n in nodes.items():
            stats = list(n.impurityStats)
            value[i] = stats[1] / max(sum(stats), 1e-300)
            if n.leftChild >= 0:
                feature[i], threshold[i] = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
                left[i], right[i] = n.leftChild, n.rightChild
        out.append((feature, threshold, left, right, value))
    return Forest(out)


def weak_labels(found: DataFrame) -> DataFrame:
    """Label findings (``candidate, before``) by published formats and assignments.

    Stands in for reviewed findings where a table has none: 1 for a known key
    format or a value of some entropy assigned to an announcing name, else 0.
    """
    # Published formats of access keys.
    known = r"^(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[bp]-[A-Za-z0-9-]{16,})$"
    assigned = r"(?i)(" + "|".join(ANNOUNCING) + r")\w*[\"']?\s*[=:]\s*[\"']?$"
    value = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    return found.withColumn("label", (F.col("candidate").rlike(known) | (F.col("before").rlike(assigned) & value)).cast("int"))


def _found(docs: DataFrame, stats: Statistics, forest: Forest | None, id_col: str, text_col: str, path_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((stats, forest))
    src = docs.select(id_col, text_col, path_col)
    schema = T.StructType([src.schema[0], T.StructField("found", T._parse_datatype_string(FINDING))])
    names = schema.names

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_candidates(b.column(1), b.column(2), *shared.value), ARROW)], names=names)
    return src.mapInArrow(run, schema).select(F.col(id_col), F.explode("found").alias("c")).select(id_col, "c.*")


def findings(docs: DataFrame, stats: Statistics, id_col: str = "doc_id", text_col: str = "text",
             path_col: str = "source") -> DataFrame:
    """A row per candidate: ``id, start, length, candidate, before, after, features``."""
    return _found(docs, stats, None, id_col, text_col, path_col).drop("probability")


def scan(docs: DataFrame, stats: Statistics, forest: Forest, id_col: str = "doc_id", text_col: str = "text",
         path_col: str = "source") -> DataFrame:
    """A row per candidate with ``probability`` and ``is_secret`` (false positives included, marked)."""
    rows = _found(docs, stats, forest, id_col, text_col, path_col).drop("features")
    return rows.withColumn("is_secret", F.col("probability") >= 0.5)


def redact(docs: DataFrame, stats: Statistics, forest: Forest, text_col: str = "text", path_col: str = "source",
           length_col: str | None = "n_chars") -> DataFrame:
    """All documents and columns, with confirmed secrets replaced by ``MASK``; ``length_col``
    follows the text where it changed."""
    shared = docs.sparkSession.sparkContext.broadcast((stats, forest))
    names, schema = docs.columns, docs.schema
    at, path = names.index(text_col), names.index(path_col)
    size = names.index(length_col) if length_col in names else None

    def run(batches):
        for b in batches:
            cols, texts, sizes = list(b.columns), None, None
            for i, found in enumerate(_candidates(b.column(at), b.column(path), *shared.value)):
                secret = [c for c in found if c["probability"] >= 0.5]
                if not secret:
                    continue
                if texts is None:
                    texts = b.column(at).to_pylist()
                    sizes = b.column(size).to_pylist() if size is not None else None
                for c in reversed(secret):
                    texts[i] = texts[i][:c["start"]] + MASK + texts[i][c["start"] + c["length"]:]
                if sizes is not None:
                    sizes[i] = len(texts[i])
            if texts is not None:
                cols[at] = pa.array(texts, cols[at].type)
                if sizes is not None:
                    cols[size] = pa.array(sizes, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return docs.mapInArrow(run, schema)
