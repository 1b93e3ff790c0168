"""Fit/transform preprocessing.

Fitting runs distributed jobs whose results are small and bounded by the
column count (medians, means, stds, modes), by ``max_features`` (the
TF-IDF vocabulary) or by ``MAX_LITERAL_CATEGORIES``; the categories of a wider
column stay a table, numbered without a driver collect and joined by value.  ``transform`` is pure built-in expressions, so the
scoring path stays inside whole-stage codegen.  Library defaults that differ
from the reference's are handled explicitly:

* median is exact with interpolation (``Imputer`` is approximate);
* scaling uses the population std and leaves zero-variance columns unscaled
  (``StandardScaler`` uses the sample std);
* mode ties pick the smallest value; one-hot keeps every category, unseen
  values encode to all zeros, NULL is imputed with the mode first;
* idf = ln((1+n)/(1+df)) + 1 with raw term counts and L2 row norm.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.drift import unpivot
from tempora.operators.metrics import exact_quantiles
from tempora.session import checkpoint_dir

# Fixed values that must equal the reference.
TEXT_MISSING = "missing"
TEXT_MAX_FEATURES = 100
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"     # sklearn (?u)\b\w\w+\b
NGRAM_RANGE = (1, 2)
TEXT_VECTOR = "txt"
# Categories a column may have as literals of an expression; beyond, they stay a table.
MAX_LITERAL_CATEGORIES = 256


# ------------------------------------------------------------------ statistics
#
# Each statistic is fitted for every value of a ``by`` column in one job: the
# folds of a cross-validation and the whole training table are fitted together.

ONE = "_one_fit"


def _of_one(df: DataFrame, fit, *args, **kw):
    """A statistic of the whole table."""
    return fit(df.withColumn(ONE, F.lit(0)), *args, by=ONE, **kw).get(0)


def _per_fit(by: str, values: dict, kind: str) -> Column:
    """The value of the row's fit; NULL for a fit without one."""
    known = [x for f, v in values.items() if v is not None for x in (F.lit(f), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*known), F.col(by)) if known else F.lit(None).cast(kind)


def fit_medians(df: DataFrame, columns, by: str | None = None) -> dict:
    """Exact medians of numeric columns (``by``: ``{fit: {column: median}}``)."""
    if by is None:
        return (_of_one(df, fit_medians, columns) or dict.fromkeys(columns)) if columns else {}
    out: dict = {}
    if columns:
        long = unpivot(df, [by], columns, name="column_name")
        q = exact_quantiles(long, [by, "column_name"], "value", [0.5], ["median"])
        for r in q.collect():                       # one row per fit and column
            out.setdefault(r[by], {})[r["column_name"]] = r["median"]
    return {f: {c: got.get(c) for c in columns} for f, got in out.items()}


def fit_scaling(df: DataFrame, columns, medians: dict, by: str | None = None):
    """Mean and population std of the median-imputed columns: ``(means, stds)``, or per fit such a pair."""
    if by is None:
        return (_of_one(df, fit_scaling, columns, {0: medians}) or ({}, {})) if columns else ({}, {})
    if not columns:
        return {}
    aggs = []
    for c in columns:
        e = F.coalesce(F.col(c).cast("double"), _per_fit(by, {f: m.get(c) for f, m in medians.items()}, "double"))
        aggs += [F.avg(e).alias(f"m__{c}"), F.stddev_pop(e).alias(f"s__{c}")]
    return {r[by]: ({c: r[f"m__{c}"] for c in columns}, {c: r[f"s__{c}"] for c in columns})
            for r in df.groupBy(by).agg(*aggs).collect()}


def _long_text(df: DataFrame, columns, by: str, fill=None) -> DataFrame:
    """``by, column_name, value`` of text columns, NULL filled by ``fill(column)`` or left out."""
    def value(c):
        v = F.col(c).cast("string")
        return v if fill is None else F.coalesce(v, fill(c))
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).alias("value")) for c in columns])
    return df.select(by, F.explode(entries).alias("e")).select(by, "e.*").where(F.col("value").isNotNull())


def fit_modes(df: DataFrame, columns, by: str | None = None) -> dict:
    """Most frequent value per categorical column (ties -> smallest)."""
    if by is None:
        return (_of_one(df, fit_modes, columns) or {}) if columns else {}
    out: dict = {}
    if columns:
        cnt = _long_text(df, columns, by).groupBy(by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        # the least (-n, value) of a column is an aggregate, combined map-side
        top = cnt.groupBy(by, "column_name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m"))
        for r in top.collect():
            out.setdefault(r[by], {})[r["column_name"]] = r["m"]["value"]
    return out


def distinct_categories(df: DataFrame, columns, modes: dict, by: str) -> DataFrame:
    """T4: ``by, column_name, value`` of every category after mode imputation."""
    return _long_text(df, columns, by, lambda c: _per_fit(by, {f: m.get(c) for f, m in modes.items()}, "string")).distinct()


def fit_categories(df: DataFrame, columns, modes: dict, by: str | None = None, most: int | None = None) -> dict:
    """T4: sorted category list per column, after mode imputation.

    Columns with more than ``most`` categories (None: any number) are left out;
    they are not brought to the driver (``category_index`` holds them)."""
    if by is None:
        return (_of_one(df, fit_categories, columns, {0: modes}, most=most) or {c: [] for c in columns}) if columns else {}
    if not columns:
        return {}
    found = distinct_categories(df, columns, modes, by)
    if most is not None:
        found = found.checkpoint()
        small = found.groupBy(by, "column_name").count().where(F.col("count") <= most)
        found = found.join(small, [by, "column_name"], "left_semi")
    out: dict = {}
    for r in found.collect():
        out.setdefault(r[by], {}).setdefault(r["column_name"], []).append(r["value"])
    return {f: {c: sorted(v) for c, v in got.items()} if most is not None else {c: sorted(got.get(c, [])) for c in columns}
            for f, got in out.items()}


def category_index(values: DataFrame, value: str = "value", index: str = "index") -> DataFrame:
    """``value, index``: distinct values numbered from 0 in sorted order.

    Ranges of values are sorted apart; a range's first number is the count of the rows before it,
    from one small table of the ranges' sizes."""
    part = "_part"
    ranged = (values.select(F.col(value).alias(value)).distinct().repartitionByRange(value).sortWithinPartitions(value)
              .withColumn("_id", F.monotonically_increasing_id()).checkpoint())
    ranged = ranged.withColumn(part, F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select(F.col(part).alias("_p"), (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_first"))
    return ranged.join(first, F.col(part) == F.col("_p")).select(value, (F.col("_first") + F.col("_at")).alias(index))


def split_tokens(text: Column) -> Column:
    """Lower-cased word tokens (``token_pattern`` of the reference)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def with_bigrams(t: Column) -> Column:
    """Unigrams followed by bigrams (``ngram_range=(1, 2)``) of a token array
    column; pairs come from two slices, so the array is read, not rebuilt."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    bi = F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, bi)


def with_terms(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """Append the term array (unigrams and bigrams) of a text column; NULL is 'missing'."""
    toks = f"{into}_tokens"
    txt = F.coalesce(F.col(text_col), F.lit(TEXT_MISSING))
    # the tokens are a column of their own, so that the bigram pass reads them
    return df.withColumn(toks, split_tokens(txt)).withColumn(into, with_bigrams(F.col(toks))).drop(toks)


def fit_vocabulary(terms: DataFrame, col: str, n_docs, max_features: int = TEXT_MAX_FEATURES, by: str | None = None):
    """Top ``max_features`` terms by corpus count (ties by term) with smooth idf,
    sorted by term.  ``terms`` has one term array per row and is read twice: the
    corpus counts of all terms, combined map-side, give the vocabulary; documents are
    counted for its terms alone, by an intersection within the row.  ``by``: per
    fit, with ``n_docs`` per fit."""
    if by is None:
        return _of_one(terms, fit_vocabulary, col, {0: n_docs}, max_features) or []
    counts = terms.select(by, F.explode(col).alias("term")).groupBy(by, "term").agg(F.count(F.lit(1)).alias("cf"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cf"), F.asc("term")))
    vocab: dict = {}
    for r in counts.withColumn("_r", rank).where(F.col("_r") <= max_features).select(by, "term").collect():
        vocab.setdefault(r[by], []).append(r["term"])           # at most max_features a fit
    if not vocab:
        return {}
    own = F.lit(None).cast("array<string>")
    for f, t in vocab.items():
        own = F.when(F.col(by) == f, F.array(*[F.lit(x) for x in t])).otherwise(own)
    holds = terms.select(by, F.explode(F.array_intersect(own, F.col(col))).alias("term"))
    df = {(r[by], r["term"]): r["df"] for r in holds.groupBy(by, "term").agg(F.count(F.lit(1)).alias("df")).collect()}
    return {f: sorted((x, math.log((1.0 + n_docs[f]) / (1.0 + df[f, x])) + 1.0) for x in t) for f, t in vocab.items()}


def dealt_terms(df: DataFrame, text_col: str, keep=(), into: str = "_terms") -> DataFrame:
    """Term arrays of a text column, dealt over the cluster and written once for every pass that reads them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(*keep, F.col(text_col).alias("_text")).repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism))
    return with_terms(spread, "_text", into).drop("_text").checkpoint()


def tfidf_vector(terms: DataFrame, col: str, vocab: list[tuple[str, float]], into: str) -> DataFrame:
    """Append the L2-normed tf-idf vector (sparse) of a term array; raw counts, JVM stages only."""
    counts, weighted = f"{into}_counts", f"{into}_weighted"
    cv = CountVectorizerModel.from_vocabulary([t for t, _ in vocab], inputCol=col, outputCol=counts)
    idf = ElementwiseProduct(scalingVec=Vectors.dense([w for _, w in vocab]), inputCol=counts, outputCol=weighted)
    norm = Normalizer(p=2.0, inputCol=weighted, outputCol=into)
    return norm.transform(idf.transform(cv.transform(terms))).drop(counts, weighted)


def tfidf_table(df: DataFrame, id_col: str, text_col: str, max_features: int = TEXT_MAX_FEATURES,
                fit_df: DataFrame | None = None) -> DataFrame:
    """T5 as a long table ``(id, term, tfidf)`` of non-zero weights, L2-normed
    per row, fitted on ``fit_df`` (else on ``df``).  The vocabulary is bounded by
    ``max_features``; weights are computed in the row, so no (row, term)
    table is shuffled."""
    rows = dealt_terms(df, text_col, [F.col(id_col).alias("_id")])
    source = rows if fit_df is None else dealt_terms(fit_df, text_col)
    vocab = fit_vocabulary(source, "_terms", source.count(), max_features)
    if not vocab:
        return rows.select(F.col("_id").alias(id_col), F.lit("").alias("term"), F.lit(0.0).alias("tfidf")).limit(0)
    names = F.array(*[F.lit(t) for t, _ in vocab])
    w = tfidf_vector(rows, "_terms", vocab, "_w").select("_id", F.posexplode(vector_to_array("_w")).alias("_i", "tfidf"))
    return w.where("tfidf <> 0").select(F.col("_id").alias(id_col), F.element_at(names, F.col("_i") + 1).alias("term"), "tfidf")


# ------------------------------------------------------------------ estimator

class Preprocessor:
    """T1-T7 column transformer: numeric (median impute + scale), categorical
    (mode impute + one-hot), first text column (TF-IDF).  ``fit`` on the
    training rows only; returns a :class:`PreprocessorModel`."""

    def __init__(self, numeric, categorical=(), text=(), max_features: int = TEXT_MAX_FEATURES,
                 output_col: str = "features"):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.text = list(text)[:1]
        self.max_features = max_features
        self.output_col = output_col

    def fit(self, df: DataFrame) -> "PreprocessorModel":
        return self.fit_many(df.withColumn(ONE, F.lit(0)), ONE).get(0) or self._model(0, {}, {}, {}, {}, {}, {})

    def fit_many(self, df: DataFrame, by: str) -> dict:
        """One model per value of ``by``, each fitted on its rows, all in the same jobs."""
        med = fit_medians(df, self.numeric, by)
        scale = fit_scaling(df, self.numeric, med, by)
        modes = fit_modes(df, self.categorical, by)
        cats = fit_categories(df, self.categorical, modes, by, most=MAX_LITERAL_CATEGORIES)
        sizes = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
        vocab = {}
        if self.text:
            vocab = fit_vocabulary(dealt_terms(df, self.text[0], [by]), "_terms", sizes, self.max_features, by)
        tables = {f: self._wide(df.where(F.col(by) == f), modes.get(f, {}), cats.get(f, {})) for f in sizes}
        return {f: self._model(f, med, scale, modes, cats, vocab, tables) for f in sizes}

    def _wide(self, df: DataFrame, modes: dict, cats: dict) -> dict:
        """Index tables of the columns with too many categories for literals: ``{column: (path, size)}``."""
        out = {}
        for c in self.categorical:
            if c not in cats and modes.get(c) is not None:
                values = df.select(F.coalesce(F.col(c).cast("string"), F.lit(modes[c])).alias("value"))
                path = f"{checkpoint_dir(df.sparkSession)}/categories-{uuid.uuid4().hex}"
                category_index(values).write.parquet(path)
                out[c] = [path, df.sparkSession.read.parquet(path).count()]
        return out

    def _model(self, f, med, scale, modes, cats, vocab, tables) -> "PreprocessorModel":
        # columns with no value in the training rows are dropped, like the
        # reference's median imputer does
        med, (mean, std) = med.get(f, {}), scale.get(f, ({}, {}))
        numeric = [c for c in self.numeric if med.get(c) is not None]
        got, wide = cats.get(f, {}), tables.get(f, {})
        return PreprocessorModel(dict(
            numeric=numeric, categorical=self.categorical, text=self.text, medians={c: med[c] for c in numeric},
            means={c: mean.get(c) for c in numeric}, stds={c: std.get(c) for c in numeric}, modes=modes.get(f, {}),
            categories={c: got.get(c, []) for c in self.categorical if c not in wide}, wide=wide,
            vocab=vocab.get(f, []), output_col=self.output_col))


class PreprocessorModel:
    def __init__(self, state: dict):
        self.state = state

    def output_columns(self) -> list[str]:
        s = self.state
        out = [f"num__{c}" for c in s["numeric"]]
        for c in s["categorical"]:
            wide = c in s.get("wide", {})
            out += [f"cat__{c}"] if wide else [f"cat__{c}__{i}" for i in range(len(s["categories"][c]))]
        if s["vocab"]:
            out.append(TEXT_VECTOR)      # one sparse vector of all vocabulary terms
        return out

    def expressions(self) -> list[Column]:
        s = self.state
        cols: list[Column] = []
        for c in s["numeric"]:
            med, mu, sd = s["medians"].get(c), s["means"].get(c), s["stds"].get(c)
            sd = sd if sd not in (None, 0.0) and not (isinstance(sd, float) and math.isnan(sd)) else 1.0
            x = F.coalesce(F.col(c).cast("double"), F.lit(med).cast("double"))
            cols.append(((x - F.lit(mu if mu is not None else 0.0)) / F.lit(sd)).alias(f"num__{c}"))
        for c in s["categorical"]:
            v = F.coalesce(F.col(c).cast("string"), F.lit(s["modes"].get(c)))
            for i, cat in enumerate(s["categories"].get(c, [])):
                cols.append((v == F.lit(cat)).cast("double").alias(f"cat__{c}__{i}"))
        return cols

    def _with_wide(self, df: DataFrame, c: str) -> DataFrame:
        """Append the sparse one-hot vector of a wide category column: its index table is joined
        by value (Spark broadcasts it if it turns out small) and unseen values are all zero."""
        path, size = self.state["wide"][c]
        index = df.sparkSession.read.parquet(path).select(F.col("value").alias("_value"), F.col("index").cast("double").alias("_index"))
        value = F.coalesce(F.col(c).cast("string"), F.lit(self.state["modes"].get(c)))
        known = df.withColumn("_own", value).join(index, F.col("_own") == F.col("_value"), "left")
        coded = known.withColumn("_index", F.coalesce("_index", F.lit(float(size)))).drop("_own", "_value")
        return one_hot(coded, "_index", f"cat__{c}", size).drop("_index")

    def transform(self, df: DataFrame, keep=None, assemble: bool = True) -> DataFrame:
        keep = list(keep) if keep is not None else df.columns
        extra = []
        for c in self.state.get("wide", {}):
            df = self._with_wide(df, c)
            extra.append(F.col(f"cat__{c}"))
        if self.state["vocab"]:
            vocab = [(t, w) for t, w in self.state["vocab"]]
            df = tfidf_vector(with_terms(df, self.state["text"][0], "_terms"), "_terms", vocab, TEXT_VECTOR)
            extra.append(F.col(TEXT_VECTOR))
        out = df.select(*keep, *self.expressions(), *extra)
        if assemble:
            out = VectorAssembler(inputCols=self.output_columns(), outputCol=self.state["output_col"],
                                  handleInvalid="keep").transform(out).drop(*self.output_columns())
        return out

    def save(self, path: str, spark) -> None:
        """The state as one JSON row; index tables of wide columns go along."""
        state = dict(self.state, wide={})
        for c, (table, size) in self.state.get("wide", {}).items():
            name = f"categories-{list(self.state['wide']).index(c)}"
            spark.read.parquet(table).write.mode("overwrite").parquet(f"{path}/{name}")
            state["wide"][c] = [name, size]
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1) \
             .write.mode("overwrite").json(f"{path}/state")

    @staticmethod
    def load(path: str, spark) -> "PreprocessorModel":
        state = json.loads(spark.read.json(f"{path}/state").first()["state"])
        state["wide"] = {c: [f"{path}/{name}", size] for c, (name, size) in state.get("wide", {}).items()}
        return PreprocessorModel(state)


def one_hot(df: DataFrame, index: str, into: str, size: int) -> DataFrame:
    """Sparse one-hot vectors of ``size`` entries; the index ``size`` is all zero."""
    spark = df.sparkSession
    # the encoder takes the number of categories from the largest index it is fitted on; its last one is dropped
    top = spark.range(1).select(F.lit(float(size)).alias(index))
    return OneHotEncoder(inputCol=index, outputCol=into, dropLast=True, handleInvalid="error").fit(top).transform(df)
