"""The registered queries of this folder: thin digests over the operators, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def started(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = started
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"))


ORACLES["op1_substring_dedup"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM docs),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(ws[p:p + 19], ' ') ORDER BY doc_id, p) AS nth FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS pos FROM ranked WHERE nth > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.pos) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import COUNTS, quality

    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")


@query
def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode_texts

    out = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .chat import format_chats, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return read_back(format_chats(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


ORACLES["op4_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  -- the marks of the template are 25 characters; each control string inside a role or a text gets one more backslash
  CAST(sum(25 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, docs.filter(fold(5) != 0), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs.filter(fold(4) != 2).select("text", "lang"))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"), held_out="pmod(crc32(cast(doc_id as string)), 10) = 0")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


ORACLES["op8_decontamination"] = r"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
folded AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
items AS (SELECT CAST(id AS VARCHAR) AS item, ws, least(10, len(ws)) AS size FROM folded WHERE side = 'b' AND len(ws) > 0),
phrases AS (
  SELECT DISTINCT item, size, array_to_string(ws[p:p + size - 1], ' ') AS phrase
  FROM (SELECT item, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM items)),
docs AS (SELECT id AS doc_id, ws FROM folded WHERE side = 'd'),
places AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM docs, (SELECT DISTINCT size FROM items)),
found AS (
  SELECT pl.doc_id, pl.p, pl.size, ph.item FROM places pl JOIN phrases ph ON ph.size = pl.size AND ph.phrase = array_to_string(pl.ws[pl.p:pl.p + pl.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dartminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data

    out = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("own", F.filter("spans", lambda s: s["base"]))

    def listed(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("own", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), digest(listed("own")).alias("base_sha256"), listed("spans").alias("spans"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    listed = out.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("nth", "c"))
    return listed.select("vec_id", (F.col("nth") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_documents, write_token_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pair_search import ranked_search

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLES["op11_ranked_search"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
items AS (SELECT item_id, word, count(*) AS times FROM asked GROUP BY item_id, word),
size AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_words FROM docs WHERE len(ws) > 0),
lengths AS (SELECT rid, doc_id, 75 + (25 * len(ws) * n_docs) // n_words AS m FROM docs, size WHERE len(ws) > 0),
counts AS (SELECT rid, word, count(*) AS tf FROM (SELECT rid, unnest(ws) AS word FROM docs) GROUP BY rid, word),
weights AS (SELECT word, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, size GROUP BY word),
scores AS (
  SELECT i.item_id, l.rid, any_value(l.doc_id) AS doc_id, CAST(sum(i.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * l.m))) AS BIGINT) AS score
  FROM items i JOIN counts c USING (word) JOIN weights w USING (word) JOIN lengths l USING (rid) GROUP BY i.item_id, l.rid),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
