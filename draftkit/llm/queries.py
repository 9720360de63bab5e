"""The registered queries of this folder: each applies one operator, with
production parameters, to its whole table.  ``QUERIES`` maps a name to
(query, DuckDB SQL or None)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftkit.llm import (chat_format, decontaminate, exact_dedup, language, merkle, pack_bins, pii, quality, simhash, suffix_repeats,
                          substrings, token_count, vector_codes)
from draftkit.llm.queries_sql import MERKLE_SQL, VECTOR_SQL

QUERIES: dict = {}

#: The tokenizer of op6; its folder is a parameter of the installation.
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op2_pii_anchor_expansion")
def op2(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def _sql_escape(x: str) -> str:
    return reduce(lambda s, c: f"replace({s}, '{c}', '{c[0]}\\{c[1:]}')", chat_format.CONTROL, f"replace({x}, '\\', '\\\\')")


_PLAIN = r"</s>[INST] ok [/INST]"


@query("op5_chat_content_parts", f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PLAIN}' UNION ALL SELECT -1, 1, 'assistant', '{_PLAIN}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, {_sql_escape('text')})) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, {_sql_escape('text')}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length('<|turn|><|text|><|end|>') + length({_sql_escape('role')}) + length({_sql_escape('text')})) AS bigint) AS formatted_chars,
  cast(0 AS bigint) AS attachment_tokens
FROM turns GROUP BY conv_id""")
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _PLAIN), (-1, 1, "assistant", _PLAIN)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(extra).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    out = chat_format.format_chat(rows).select(
        "conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"),
        F.concat_ws("", chat_format.read_loss(F.col("formatted"))).alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "attachment_tokens")
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                      F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
                      F.char_length("loss").cast("bigint").alias("loss_chars"),
                      F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "attachment_tokens")


@query("op6_token_counts")
def op6(spark, sf_dir):
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op7_exact_dedup_quotient_filter", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""")
def op7(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op1_simhash_vantage_point")
def op1(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op9_decontaminate_spaced_seeds")
def op9(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_conflict_best_fit_packing")
def op3(spark, sf_dir):
    return pack_bins.pack_documents(table(spark, sf_dir, "documents"))


@query("op4_quality_random_indexing")
def op4(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_sparse_suffix_repeats")
def op8(spark, sf_dir):
    return suffix_repeats.repeated_passages(table(spark, sf_dir, "documents"))


@query("op10_language_evidence_fusion")
def op10(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op11_vector_code_trie", VECTOR_SQL)
def op11(spark, sf_dir):
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    hexed = F.array_join(F.transform("code", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0")), "")
    return vector_codes.with_label_error(codes).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf([lowered if f == "text" else F.col(f) for f in merkle.FIELDS])
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = merkle.manifest(docs, carry={"tampered": F.when(struck, tampered)})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                     merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_substring_suffix_automata")
def op12(spark, sf_dir):
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
