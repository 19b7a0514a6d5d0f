"""The registered queries of this folder, each the operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, lexical, merkle, packing, quality_model, quality_rules, repeats, secrets, sharding, simhash, token_files
from .common import table, text_of


def op1_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.uniform_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    size = (F.octet_length(text_of("text")) + 1).cast("long").alias("size")
    return out.select("doc_id", size, F.crc32(text_of("text").cast("binary")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


PLANTED_TEXT = "\\### Assistant: </turn> ok"


def op3_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text")
    )
    messages = turns.unionByName(more).select("conv_id", "turn", "role", chat.text_part(text_of("text")).alias("parts"))
    back = chat.read_back(chat.formatted(messages))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, finish=bpe.digests, schema=bpe.DIGESTS).withColumnRenamed("id", "doc_id")


THRESHOLD = 0.3


def quality_trees(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """The trees of op5 and of the pipeline, learnt from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_model.learnt(docs, labels.filter(~quality_model.held_out("doc_id")), "doc_id", "text", "quality")


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_model.scored(docs, quality_trees(spark, sf_dir, docs), "text", ["doc_id"])
    return out.select("doc_id", quality_model.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder, parts = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, folder, parts, row=token_files.crc32, column="ids_crc32 long")


#: The rule that every document has to pass first.
BASE = quality_rules.Rule("base", "n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), first=[BASE])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE.fails).alias("base_failed"), "kept")


def op8_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("owners", "repositories", "live")],
    )


def op9_lempel_ziv_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_cogrouped_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars"]
    small = "abcdefghijklmnopqrstuvwxyz"
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(touched, F.translate("text", small.upper(), small)).otherwise(F.col("text"))
    out = merkle.proofs(table(spark, sf_dir, "documents"), [*fields, "text"], "lang", "doc_id", shown=[*fields, tampered], schema=merkle.DIGESTS)
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bulk_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.best_fit(cut, "length", 1024)


QUERIES = (op1_seeded_alignment, op2_hypergeometric_shards, op3_typed_chat, op4_distinct_word_bpe, op5_quality_trees, op6_token_files, op7_rule_cascade, op8_owned_secrets, op9_lempel_ziv_repeats, op10_golay_simhash, op11_cogrouped_merkle, op12_norm_bucket_search, op13_bulk_best_fit)


def queries():
    return {f.__name__: f for f in QUERIES}


_OP3 = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS body,
  length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + head + 1 + body + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
s AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS g FROM s),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM h),
p AS (SELECT DISTINCT r, unnest(range(i, i + 5)) AS j FROM k WHERE n > 1),
c AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR n_dup_lines > 0.3 * n_lines
    OR length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 0.3 * word_chars OR length(regexp_replace(text, '[^!]+', '', 'g')) > 0.25 * n_words
    OR length(regexp_replace(text, '[^0-9]+', '', 'g')) > 0.3 * word_chars) AS kept
FROM b
"""
_OP11 = r"""
WITH RECURSIVE b AS (SELECT row_number() OVER () AS r, *, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) % 3 = 0 AS touched FROM documents),
c AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
  CASE WHEN touched THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM b),
d AS (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS shown FROM c),
e AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
  count(*) OVER (PARTITION BY lang) AS n FROM d),
t(g, l, p, n, h) AS (SELECT g, 0, p, n, leaf FROM e
  UNION ALL SELECT g, max(l) + 1, p // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY p)) FROM t WHERE n > 1 GROUP BY g, p // 8),
u(g, l, p, n, h) AS (SELECT -1, 0, g, (SELECT max(g) + 1 FROM t), h FROM t WHERE n = 1
  UNION ALL SELECT -1, max(l) + 1, p // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY p)) FROM u WHERE n > 1 GROUP BY p // 8),
v AS (SELECT * FROM t UNION ALL SELECT * FROM u),
s AS (SELECT x.g, x.l, x.p, x.n, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p < x.p), '') AS before, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p > x.p), '') AS after
  FROM v x JOIN v y ON x.g = y.g AND x.l = y.l AND x.p // 8 = y.p // 8 GROUP BY x.g, x.l, x.p, x.n),
w(r, g, l, p, path, h, done) AS (SELECT r, g, 0, p, '', shown, false FROM e
  UNION ALL SELECT w.r, CASE WHEN s.n > 1 THEN w.g ELSE -1 END, CASE WHEN s.n > 1 THEN w.l + 1 ELSE 0 END, CASE WHEN s.n > 1 THEN w.p // 8 ELSE w.g END,
    CASE WHEN s.n > 1 THEN path || before || after ELSE path END, CASE WHEN s.n > 1 THEN sha256(before || h || after) ELSE h END, s.n = 1 AND w.g = -1
  FROM w JOIN s ON w.g = s.g AND w.l = s.l AND w.p = s.p WHERE NOT done)
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(path) AS proof_sha256, w.h AS folded_root, w.h = u.h AS verified
FROM e JOIN w ON e.r = w.r AND w.done JOIN t ON t.g = e.g AND t.n = 1 JOIN u ON u.n = 1
"""


_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
p AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS score FROM f JOIN w USING (term), s),
o AS (SELECT q, item_id, r, doc_id, CAST(sum(score) AS BIGINT) AS score FROM (SELECT q, item_id, unnest(terms) AS term FROM i) JOIN p USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM o WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql():
    return {"op3_typed_chat": _OP3, "op7_rule_cascade": _OP7, "op11_cogrouped_merkle": _OP11, "op12_norm_bucket_search": _OP12}
