"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswell.llm import bpe, chat, chat_repair, hard_negatives, license_scan, lm_score, mixing, near_dedup, quality, sharding, suffix_dedup, token_output, topk
from corpuswell.llm._shared import whole_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, similarity=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return removed.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    base, own = F.col("places.label"), F.col("matches.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")  # noqa: E731
    n_base = F.size("places")
    return scanned.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    labelled = labels.select("doc_id", mixing.label_domains(labels).alias("domain"))
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), labelled, [0.90, 0.08, 0.02])
    p = F.col("posteriors")
    return mixed.select("doc_id", "n_tokens", p[0].alias("p_clean"), p[1].alias("p_low"), p[2].alias("p_toxic"), "rate", "copies", "converged", "target_gap")


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole_text().cast("binary")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shuffle_into_shards(docs, 16, carry=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.katz_scores(_table(spark, sf_dir, "documents"))[0]


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return chat_repair.repair_conversations(chat_repair.damaged(turns), turns)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_topk": op8_exact_topk,
    "op9_mixing": op9_mixing,
    "op10_hypergeometric_shards": op10_hypergeometric_shards,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}


def _repair_sql() -> str:
    """The damage, the faults and the cheapest edits of conversations; a recursive step for each turn holds the best way to each of the four states."""
    then = lambda way, cost, edit: f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{edit}'}}"  # noqa: E731
    best = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL))[1]"  # noqa: E731
    fit = lambda way, role: f"{{'c': CASE WHEN role[:1] = '{role}' THEN {way}.c + late END, 'a': {way}.a || 'K'}}"  # noqa: E731
    free = lambda x: f"{{'c': CASE WHEN fault NOT IN ('b', 'd') THEN {x}.c END, 'a': {x}.a}}"  # noqa: E731
    kept = lambda way, role: free(fit(way, role))  # noqa: E731
    cast = lambda way, role: free(then(way, "3 + late", "R"))  # noqa: E731
    step = {"n0": [then("s0", 4, "D")], "n1": [then("s1", 4, "D"), kept("s0", "s")], "n2": [then("s2", 4, "D")], "n3": [then("s3", 4, "D"), kept("s2", "a"), cast("s2", "a")]}
    step["n2"] += [f(s, "u") for s in ("s0", "s1", "s3") for f in (kept, cast)]
    moved = ", ".join(f"{best(*ways)} AS {n}" for n, ways in step.items())
    opened = lambda a, b: best(a, *[then(x, 3, "I") for x in ("n0", "n1", b)])  # noqa: E731
    return rf"""
        WITH RECURSIVE key AS (
          SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        hit AS (
          SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b:
            list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 20 AS d FROM key),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy,
            CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
          FROM hit WHERE d <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
        judged AS (
          SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
            WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '' END AS fault,
            lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[:1] AS pair
          FROM placed),
        told AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM judged GROUP BY conv_id),
        way AS (
          SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': NULL::BIGINT, 'a': ''}} AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3
          FROM conversations
          UNION ALL
          SELECT conv_id, i, n0, n1, {opened("u2", "u3")}, {best("u3", then(opened("u2", "u3"), 3, "I"))} FROM (
            SELECT *, {best("n3", then("u2", 3, "I"))} AS u3 FROM (
              SELECT *, {opened("n2", "n3")} AS u2 FROM (
                SELECT conv_id, i, {moved} FROM (
                  SELECT way.*, role, fault, 3 * (fault = 't')::BIGINT AS late, j.i AS i_ FROM way JOIN judged j ON j.conv_id IS NOT DISTINCT FROM way.conv_id AND j.i = way.i + 1) AS w(conv_id, i__, s0, s1, s2, s3, role, fault, late, i))))),
        done AS (SELECT conv_id, {best("s0", "s3")} AS e FROM way QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        edit AS (
          SELECT conv_id, p, e.a[p] AS edit, length(replace(e.a[:p], 'I', '')) AS i, length(replace(e.a[:p], 'D', '')) AS o, length(replace(e.a, 'D', '')) % 2 AS sys
          FROM done, range(1, 1000000) AS r(p) WHERE p <= length(e.a)),
        line AS (
          SELECT edit.conv_id, p, CASE WHEN edit = 'K' THEN role WHEN (o - 1 - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
          FROM edit LEFT JOIN judged j ON edit <> 'I' AND j.conv_id IS NOT DISTINCT FROM edit.conv_id AND j.i = edit.i WHERE edit <> 'D'),
        whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS text FROM line GROUP BY conv_id)
        SELECT done.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          e.c AS cost, e.a AS audit, sha256(coalesce(whole.text, '')) AS repaired_sha256
        FROM done LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM done.conv_id"""


ORACLE = {
    "op12_hard_negatives": r"""
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
          SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        WHERE rank <= 5""",
    "op13_conversation_repair": _repair_sql(),
    "op3_chat_format": r"""
        WITH t AS (
          SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS idx
          FROM conversations),
        c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY idx) AS turns FROM t GROUP BY conv_id),
        prefix AS (SELECT DISTINCT turns[1:k] AS turns FROM c, range(1, n_turns) AS r(k)),
        kept AS (
          SELECT min(conv_id) AS conv_id, n_turns FROM c
          WHERE turns NOT IN (SELECT turns FROM prefix) GROUP BY turns, n_turns)
        SELECT conv_id, ((idx - 1) // 1024)::INT AS part, n_turns,
          string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY idx) AS text
        FROM t JOIN kept USING (conv_id) GROUP BY ALL""",
    "op7_quality_rules": r"""
        WITH w AS (
          SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents),
        win AS (
          SELECT rid, i, list_aggregate(words[i:i + 4], 'string_agg', chr(10)) AS g
          FROM w, range(1, greatest(len(words) - 3, 1)) AS r(i)),
        rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
        cov AS (
          SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (
            SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
        m AS (
          SELECT rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
            coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
            coalesce(n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN cov USING (rid)),
        r AS (
          SELECT *, (n_symbols + 1) / (n_words + 1) AS sr, (n_dup_lines + 1) / (n_words + 1) AS dr,
            word_chars / greatest(n_words, 1) * (1 + 1 / sqrt(greatest(n_words, 1))) AS wl, word_chars / greatest(n_words, 1) * (1 - 1 / sqrt(greatest(n_words, 1))) AS low_wl FROM m),
        q AS (
          SELECT lang, source, grouping(lang) + grouping(source) AS level, count(*) AS n,
            list(sr ORDER BY sr) AS s, list(dr ORDER BY dr) AS d, list(wl ORDER BY wl) AS w
          FROM r GROUP BY ROLLUP (lang, source)),
        f AS (
          SELECT lang, source, level, least(1.0, n / 50) AS n, s[hi] + 8 * (s[hi] - s[lo]) AS s, d[hi] + 8 * (d[hi] - d[lo]) AS d, w[hi] + 8 * (w[hi] - w[lo]) AS w
          FROM (SELECT *, ceil(0.1 * n)::BIGINT AS lo, ceil(0.5 * n)::BIGINT AS hi FROM q)),
        f1 AS (
          SELECT c.lang, pow(c.s, c.n) * pow(p.s, 1 - c.n) AS s, pow(c.d, c.n) * pow(p.d, 1 - c.n) AS d, pow(c.w, c.n) * pow(p.w, 1 - c.n) AS w
          FROM f c, f p WHERE c.level = 1 AND p.level = 2),
        f0 AS (
          SELECT c.lang, c.source, pow(c.s, c.n) * pow(p.s, 1 - c.n) AS s, pow(c.d, c.n) * pow(p.d, 1 - c.n) AS d, pow(c.w, c.n) * pow(p.w, 1 - c.n) AS w
          FROM f c JOIN f1 p ON c.lang IS NOT DISTINCT FROM p.lang WHERE c.level = 0)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed,
          NOT bad AND (n_symbols - 1) / greatest(n_words, 1) <= s * (1 + 1e-9) AND (n_dup_lines - 1) / greatest(n_words, 1) <= d * (1 + 1e-9) AND low_wl <= w * (1 + 1e-9) AS kept
        FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS bad FROM r) r
        JOIN f0 ON r.lang IS NOT DISTINCT FROM f0.lang AND r.source IS NOT DISTINCT FROM f0.source""",
    "op8_exact_topk": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id))
        WHERE rank <= 5""",
}
