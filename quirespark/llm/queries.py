"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, egojoin, langid, licenses, lexical, linededup, periodic, probminhash, repeats, sharding, warc
from .common import scratch_path, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, digest=True)


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).select(
        F.col("id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_similar_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=24)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.where("not held_out and doc_id is not null"))
    return langid.identify(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", "assistant"))])
    one_more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.inline(said))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_chats(chat.format_chats(turns.unionByName(one_more))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    # In a tenth of the documents the words from one on are made to repeat.
    at, g = lambda ws: F.pmod(F.floor(F.col("h") / 10), F.size(ws)), F.floor(F.col("h") / 10)

    def planted(ws: Column) -> Column:
        return chat.let(F.struct(at(ws).cast("int").alias("a"), F.size(ws).alias("n")), lambda c: chat.let((1 + F.floor((c["n"] - c["a"]) / (3 + g % 8))).cast("int"), lambda p: F.array_join(F.transform(ws, lambda w, i: F.when(i < c["a"], w).otherwise(F.get(ws, c["a"] + F.pmod(i - c["a"], p)))), " ")))

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = docs.withColumn("text", F.when(F.col("h") % 10 == 0, chat.let(words, lambda ws: F.when(F.size(ws) > 0, planted(ws)))).otherwise(F.col("text")))
    # Runs come by start, then period, so the first of equal ones is the one asked for.
    better = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    run = "struct<start: bigint, length: bigint, period: bigint>"
    best = F.aggregate("runs", F.lit(None).cast(run), lambda best, r: F.when(better(r, best), r).otherwise(best))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return periodic.collapse_runs(docs, keep=["doc_id"]).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.top_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20).select("item_id", "rank", "doc_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_embedding_neardup, op3_warc, op4_line_dedup, op5_license_scan, op6_decontamination, op7_sharding, op8_language_id, op9_repeated_strings, op10_minhash_neardup, op11_chat_format, op12_periodic_runs, op13_lexical_search)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = _WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")

#: Backslashes that escaping adds to a column: one for each of its own and for each control string.
_ESCAPES = "length({0}) - length(replace({0}, '\\', '')) + list_sum(list_transform([" + ", ".join(f"'{c}'" for c in chat.CHATML.control) + "], lambda c: (length({0}) - length(replace({0}, c, ''))) // length(c)))"

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_neardup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u), n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op3_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS of_id FROM pages),
h AS (SELECT *, sha1(b) AS x FROM p)
SELECT page_id, octet_length(b) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = of_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> of_id THEN of_id END AS refers_to FROM h""",
    "op6_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, win.k, item_id FROM dw JOIN win ON win.g = dw.g AND win.k = dw.k),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_chat_format": f"""WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM t),
e AS (SELECT *, length(text) + {_ESCAPES.format("text")} AS n_text, length(role) + {_ESCAPES.format("role")} AS n_role FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN opens THEN n_role + {len(chat.CHATML.opening + chat.CHATML.role_end + chat.CHATML.closing)} ELSE {len(chat.CHATML.joint)} END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op12_periodic_runs": r"""WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda v, b: list_reduce(list_prepend(xor(v, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) AS h FROM documents),
d1 AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0), d AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM d1),
x0 AS (SELECT doc_id, n, a, p, w, unnest(range(n)) AS i FROM d), x AS (SELECT doc_id, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS t FROM x0),
g AS (SELECT doc_id, n, i, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pr AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM g u JOIN g v ON u.doc_id = v.doc_id AND u.g = v.g AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM pr), st AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM s GROUP BY doc_id, q, k),
r AS (SELECT doc_id, start, length, min(q) AS period FROM st WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r),
rs AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r), kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS c FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN rs USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (doc_id)""",
    "op13_lexical_search": f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t), q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT item_id, doc_id, sum(qtf * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t) CROSS JOIN c GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20""",
}
