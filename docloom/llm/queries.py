"""The corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.storage import materialize
from docloom.llm import chat, curriculum, embedding_cells, filter_audit, grace, langid, lines, order_minhash, packing, shards, surrogates, topk, txlog

SHARDS, SEED = 16, 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_surrogates(spark, sf_dir):
    return surrogates.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_exact_top_k(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


def op3_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    return langid.classify(docs.withColumn("held_out", langid.held_out()), model, "doc_id", "held_out")


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer())


def op5_stratified_shards(spark, sf_dir):
    identity = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    placed = shards.interleave(shards.digest(_table(spark, sf_dir, "documents")), SHARDS, SEED, identity)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op6_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    laid = materialize(chat.segments(turns.unionByName(more)), "chat-segments")
    return chat.read_back(laid, chat.expand(laid))


def op7_grace_dedup(spark, sf_dir):
    return grace.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_order_minhash(spark, sf_dir):
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_curriculum_mix(spark, sf_dir):
    mixed = curriculum.assign(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id", "source"])
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("passes").cast("int").alias("passes"), F.get("passes", F.lit(0))["position"].alias("first_position"))
    return curriculum.training_order(rows, "first_position")


def op10_fuzzy_lines(spark, sf_dir):
    return lines.deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_transaction_log(spark, sf_dir):
    return txlog.reassemble(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op12_embedding_near_dedup(spark, sf_dir):
    return embedding_cells.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.interactions(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii_surrogates, op2_exact_top_k, op3_language_id, op4_best_fit_packing, op5_stratified_shards,
        op6_chat_formatting, op7_grace_dedup, op8_order_minhash, op9_curriculum_mix, op10_fuzzy_lines,
        op11_transaction_log, op12_embedding_near_dedup, op13_filter_audit,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_SPACE = r"[\x20\x09-\x0D]+"


def _escaped(column: str) -> str:
    """chat.escape in SQL: backslashes doubled, control strings broken by one."""
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


#: CRC-32 in SQL: ``t`` is its table of 256, made by the polynomial's rule.
_CRC_TABLE = "crcs AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8; needs ``crcs`` among the tables."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLES = {
    "op2_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op6_chat_formatting": rf"""
        WITH t AS (
          SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, {_escaped("text")} AS body, replace({_escaped("role")}, chr(10), '\\' || chr(10)) AS head FROM t),
        f AS (SELECT *, length(head) + length(body) + {len(chat.OPEN) + len(chat.CLOSE) + 2} AS chars FROM e),
        g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING) AS upto FROM f)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS examples,
               coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
        FROM g GROUP BY conv_id""",
    "op7_grace_dedup": rf"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op11_transaction_log": rf"""
        WITH {_CRC_TABLE},
        d AS (SELECT doc_id, source, text, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic, {_crc("doc_id::VARCHAR")} AS h FROM documents, crcs WHERE doc_id IS NOT NULL),
        o AS (SELECT *, h % 17 AS m, h // 100 % 30000 AS key FROM d),
        r AS (SELECT doc_id, source, m, key, CASE WHEN m > 6 AND text IS NOT NULL AND NOT toxic THEN {_crc("key::VARCHAR || ':' || text")} END AS crc FROM o, crcs),
        n AS (SELECT *, count(*) FILTER (m <= 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS txn, count(*) FILTER (m <= 1) OVER (ORDER BY doc_id) AS commits FROM r),
        l AS (SELECT *, count(*) FILTER (m IN (3, 4)) OVER (PARTITION BY source, txn ORDER BY doc_id) AS level FROM n),
        f AS (SELECT *, min(doc_id) FILTER (m IN (5, 6)) OVER (PARTITION BY source, txn, level ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS undoing,
                     max(doc_id) FILTER (m <= 2) OVER (PARTITION BY source, txn) AS ending, max(commits) FILTER (m <= 1) OVER (PARTITION BY source, txn) AS rank FROM l),
        k AS (SELECT key, crc, (rank + 63) // 64 AS epoch FROM f WHERE m > 6 AND undoing IS NULL AND rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, epoch ORDER BY rank DESC, doc_id DESC) = 1),
        v AS (SELECT *, lead(epoch) OVER (PARTITION BY key ORDER BY epoch) AS until FROM k),
        e AS (SELECT unnest(range(1, (max(commits) + 63) // 64 + 1)) AS epoch FROM n)
        SELECT 'state' AS kind, e.epoch AS id, count(v.crc) AS n, coalesce(sum(v.crc), 0)::BIGINT AS value FROM e LEFT JOIN v ON v.epoch <= e.epoch AND (v.until IS NULL OR v.until > e.epoch) GROUP BY e.epoch
        UNION ALL SELECT CASE WHEN undoing IS NULL THEN 'abort' ELSE 'rollback' END, doc_id, coalesce(undoing, ending), key FROM f WHERE m > 6 AND (undoing IS NOT NULL OR rank IS NULL)""",
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
                 embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound FROM embeddings),
        p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.sound AND b.sound WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT c.vec_id, count(p.b) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN p ON p.a = c.vec_id GROUP BY ALL""",
    "op13_filter_audit": r"""
        WITH l AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels GROUP BY doc_id),
        t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (
          SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
                 {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), FALSE)} AS x
          FROM t LEFT JOIN l USING (doc_id)),
        h AS (SELECT part, [k FOR k IN ['A', 'B', 'C', 'D', 'E'] IF struct_extract_at(x, 1) AND k = 'A' OR struct_extract_at(x, 2) AND k = 'B' OR struct_extract_at(x, 3) AND k = 'C'
                     OR struct_extract_at(x, 4) AND k = 'D' OR struct_extract_at(x, 5) AND k = 'E'] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
        s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, string_split(left(filter_order, step - 1), '') AS earlier FROM o, range(1, 6) r(step)),
        r AS (
          SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, earlier)), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (fails = [own]), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS toxic_lost
          FROM h, s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r""",
}
