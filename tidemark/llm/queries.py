"""Queries of the training-data operators over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, conversation_trie, exact_dedup, lm, packing, pii, quality_classifier, quality_rules, sentencepieces, simhash, suffix_dedup, token_output, url_filter
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), window=50)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_and_index(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)), "v1")
    base = quality_rules.POLICIES["base"]
    return rows.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"failed & {base} <> 0 AS base_failed", "kept")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir), shingle=3)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=0, capacity=2048)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


URL_RULES = [url_filter.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_exact_dedup, op3_token_output, op4_personal_data, op5_quality_rules, op6_simhash_near_dedup,
        op7_best_fit_packing, op8_lm_scoring, op9_quality_classifier, op10_sentencepiece, op11_tokenizer_alignment, op12_conversation_trie, op13_url_filter, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
        g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
        FROM t JOIN g USING (x)
    """,
    "op5_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS s
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY doc_id),
        b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                     len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
                     len(list_filter(ws, lambda x: x = '|')) AS n_bars, coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0) AS longest_word
              FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 100 * n_symbols > 10 * greatest(word_chars, 1) OR 100 * n_dup_lines > 30 * greatest(n_lines, 1)
                    OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)) OR (2 * n_upper > n_letters AND n_letters > 0)
                    OR (n_words > 0 AND 100 * n_bars > 15 * n_words) OR longest_word > 200) AS kept
        FROM f
    """,
    # CRC-32 of an id: bytes enter the register one by one, each by eight shifts.
    "op12_conversation_trie": r"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                       lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
                FROM (SELECT DISTINCT c FROM t)),
        has AS (SELECT c AS base, count(*) AS n FROM t GROUP BY c),
        r AS (SELECT ids.c, t.pos, t.role, t.text FROM ids JOIN t ON t.c = ids.base AND t.pos <= ids.h
              UNION ALL SELECT ids.c, t.pos - ids.h + least(ids.h, coalesce(has.n, 0)), t.role, t.text
              FROM ids JOIN t ON t.c = ids.c AND t.pos > ids.h LEFT JOIN has ON has.base = ids.base),
        p AS (SELECT c, pos AS d, md5(string_agg(CAST(length(role) AS VARCHAR) || ':' || role || CAST(length(text) AS VARCHAR) || ':' || text, '') OVER (PARTITION BY c ORDER BY pos)) AS k,
                     len(regexp_extract_all(text, '[^ 	-
]+')) AS w FROM r
              UNION ALL SELECT c, 0, '', 0 FROM ids),
        m AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
        n AS (SELECT k, d, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS e
              FROM m GROUP BY k, d),
        kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY up, d),
        own AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.k AND kids.d = n.d),
        above AS (SELECT a.k, a.d, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.w) AS saved
                  FROM own o JOIN m a ON a.c = o.conv_id AND a.d <= o.d GROUP BY a.k, a.d)
        SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, own.n_convs, CAST(own.n_children AS BIGINT) AS n_children,
               CAST(above.n_leaves AS BIGINT) AS n_leaves, CAST(above.saved AS BIGINT) AS saved_tokens, own.e AS ends_sha256
        FROM own JOIN above ON above.k = own.k AND above.d = own.d LEFT JOIN own u ON u.k = own.up AND u.d = own.d - 1
    """,
}
