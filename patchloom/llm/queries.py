"""One query per operator over the driver's tables, with production parameters, and SQL where SQL can state the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import ann, captures, conversations, mixing, ordinal, packing, phrases, pseudonyms, ranked, rans, secret_scan, simhash, warc, weak_rules
from patchloom.llm.tables import table
from patchloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    pieces = packing.tokenized_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), checksums=True
    )
    return packing.place(pieces)


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets of every document."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, votes and posterior quality of every document."""
    return weak_rules.label(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "votes", "quality",
    )


@query
def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    folder = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    manifest = rans.write_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")
    )
    return rans.read_files(manifest, folder, checksums=True)


@query
def op10_balanced_lists_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


#: Target weights of the sources; all others have weight 1.
MIX_WEIGHTS = {"src0": 5, "src1": 3, "src2": 2}


@query
def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of all sources."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("chars"))
    mixed = mixing.mix(lengths, MIX_WEIGHTS, length="chars")
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "block", "position", "start")


ORACLES["op6_pfair_mix"] = mixing.oracle(MIX_WEIGHTS)


@query
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every revisit among the captures of all pages stands for."""
    records = warc.parse_records(captures.warc_records(spark, sf_dir))
    narrow = records.withColumn("payload", F.md5(F.encode("payload", "utf-8")))  # only the digest of a body is fetched
    headers = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return warc.resolve(narrow).select(
        "record_id", "url", "outcome", "refers_to", headers.alias("headers"), F.col("payload").alias("payload_md5")
    )


ORACLES["op3_warc_revisits"] = captures.ORACLE

#: A key for checks; real ones come from the user's own store of secrets.
CHECK_KEY = b"only for checks, not for real data"


@query
def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers and dates replaced."""
    done = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), CHECK_KEY)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "text", F.size("spans").alias("n_spans"), spans.alias("spans"))


@query
def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the best grade, and the verdict on every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ordinal.fit(ordinal.rated_documents(docs, labels), ordinal.GRADES)
    scored = ordinal.score(docs, model, ["doc_id"], ordinal.GRADES - 1)
    return scored.withColumn("kept", F.col("tail_probability") >= ordinal.KEPT_FROM)


@query
def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    damaged = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(damaged, present="present"))


@query
def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in an exact ten-word window of a benchmark item, and the items."""
    index = phrases.build(table(spark, sf_dir, "documents"))
    found = phrases.contamination(index, phrases.search(index, table(spark, sf_dir, "benchmark")))
    listed = F.sha2(F.encode(F.array_join("item_ids", ","), "utf-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


_TERMS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLES["op11_positional_index"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS words FROM documents),
items AS (SELECT item_id, {_TERMS_SQL} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[k : k + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS k FROM items WHERE len(words) > 0)
),
grams AS (
  SELECT r, size, k, array_to_string(words[k : k + size - 1], ' ') AS gram
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS k
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)
),
hits AS (SELECT r, item_id, k, size FROM grams JOIN windows USING (size, gram)),
places AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hits) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""


@query
def op12_fp_tree_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of the highest lexical score for each benchmark item."""
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_fp_tree_ranking"] = f"""
WITH docs AS (
  SELECT r, doc_id, words, len(words) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS words FROM documents)
  WHERE len(words) > 0
),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
items AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (
  SELECT row_number() OVER () AS q, item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
counts AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, totals GROUP BY term, n_docs
),
scored AS (
  SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (r), totals GROUP BY q, item_id, doc_id, r
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
