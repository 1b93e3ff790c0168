"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.session import checkpoint_dir

#: a public tokenizer's file; never copied into the repository
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def secret_model(docs: DataFrame):
    """Corpus statistics and a forest trained on labelled findings of the documents.

    The tables hold no reviewed findings, so candidates are labelled by
    published formats; rows with crc32(doc_id) mod 5 = 0 are left out.
    """
    from tempora.llm import secrets
    stats = secrets.statistics(docs)
    taught = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    return stats, secrets.train(secrets.weak_labels(secrets.findings(taught, stats)))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import secrets
    docs = table(spark, sf_dir, "documents")
    stats, forest = secret_model(docs)
    found = secrets.weak_labels(secrets.scan(docs, stats, forest))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "label",
                        F.round("probability", 6).alias("probability"), "is_secret")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import toxicity
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted", F.size("passages").alias("n_passages"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import near_dup
    return near_dup.groups(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import tokens
    return tokens.counts(table(spark, sf_dir, "documents"), tokens.load(VOCABULARY))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import suffix_dedup
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import warc
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(table(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path, payload="response")
    whole = F.col("record_type") == "response"
    return back.select(
        warc.key_of("record_id").cast("long").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", F.when(~whole, warc.key_of("refers_to").cast("long")).alias("refers_to"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import mixing
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), columns=["doc_id", "source"])


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import ann
    found = ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import decontaminate as D
    found = D.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import pii
    found = pii.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("all_spans")).alias("spans"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tempora.llm import bpe
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded, ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded, raw = bpe.decode(encoded.drop("text"), vocabulary, ids)
    # the JSON form of a list of whole numbers, without its brackets, is the joined form
    joined = F.regexp_replace(F.to_json(ids), r"[\[\]]", "")
    return decoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                          F.sha2(raw, 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import ranked_search
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm import whitening
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_toxicity": op2_toxicity,
    "op3_near_dup": op3_near_dup,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_ann": op8_ann,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_bpe": op11_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("coalesce(text, '')")

SQL: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.payload_bytes >= 100 AND f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.payload_bytes >= 100 AND f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
    "op3_near_dup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 800)) AS k FROM
  (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 399)) AS i FROM d WHERE length(hx) >= 800)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
h AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS st, max(i) + 400 AS en FROM h GROUP BY doc_id, run),
t AS (SELECT doc_id, st, en, lag(en, 1, 0) OVER (PARTITION BY doc_id ORDER BY st) AS before FROM s),
k AS (SELECT t.doc_id, count(*) AS n_spans, sum(en - st) AS n_removed, max(en) AS last_,
  string_agg(substr(hx, 2 * before + 1, 2 * (st - before)), '' ORDER BY st) AS parts FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, length(hx) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(hx, 2 * coalesce(last_, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op12_ranked_search": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM w WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM t) GROUP BY 1, 2),
g AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), c),
m AS (SELECT doc_id, 100 - 90 + (90 * len(w)::BIGINT * big_n) // big_l AS m FROM w, c WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM t JOIN f USING (term) JOIN g USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op9_decontaminate": rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sz AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sz WHERE len(w) >= size)),
h AS (SELECT DISTINCT doc_id, i, size, item FROM dw JOIN bw USING (size, k)),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
