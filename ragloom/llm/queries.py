"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from ragloom.llm.store import documents

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ngram_jaccard_join(spark, sf_dir):
    from ragloom.llm.jaccard import similar

    return similar(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS shingle FROM s),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, a FROM (SELECT DISTINCT a FROM links) UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.m, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = s.doc_id
"""


def op2_substring_dedup(spark, sf_dir):
    from ragloom.llm.substring import repeated_spans

    return repeated_spans(documents(spark, sf_dir)).drop("body")


def op3_mixing(spark, sf_dir):
    from pyspark.sql import functions as F

    from ragloom.llm.mixing import in_training_order, plan

    planned = plan(documents(spark, sf_dir).select("doc_id", "source", "text"))
    # each document where the mix has its first taking, with the tie that mix() has; those it doesn't take come last
    placed = planned.select("doc_id", "_size", "_source_size", "_target", "_taken", F.get("_places", F.lit(0))["position"].alias("_at"), F.xxhash64("doc_id", F.lit(0)).alias("_tie"))
    mixed = in_training_order(placed, "_at", "_tie")
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.round("_at", 6).alias("first_position"))


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, CAST(concat('0x', substr(md5(concat(doc_id, '|7')), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][pos % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
             coalesce(sum(most) OVER r, 0) AS filled, coalesce(sum(weight) OVER r, 0) AS gone
      FROM w WINDOW r AS (ORDER BY most / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (words - filled) / (weights - gone) AS level FROM o),
t AS (SELECT source, source_size, pos, least(most, (SELECT level FROM l WHERE most >= level * weight ORDER BY most / weight, pos LIMIT 1) * weight) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.pos, t.target, floor(t.target + 1e-6) AS whole, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, whole - before)) AS first_words,
             list_sum(list_transform([0, 1, 2], lambda c: greatest(0, least(size, whole - before - c * source_size)))) AS taken FROM p),
q AS (SELECT *, CASE WHEN first_words > 0 THEN (before + first_words / 2) / target END AS q FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
       round(CASE pos % 3 WHEN 0 THEN 2 * q / (1.5 + sqrt(greatest(0, 2.25 - 2 * q))) WHEN 2 THEN 2 * q / (0.5 + sqrt(0.25 + 2 * q))
             ELSE CASE WHEN q < 0.5 THEN 2 * q / (0.5 + sqrt(0.25 + 4 * q)) ELSE 0.5 + 2 * (q - 0.5) / (1.5 + sqrt(greatest(0, 2.25 - 4 * (q - 0.5)))) END END, 6) AS first_position FROM q
"""


def op4_quality_rules(spark, sf_dir):
    from ragloom.llm.quality_rules import assess

    return assess(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "_counts.*", "base_failed", "kept")


_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, text, {WORDS.format("coalesce(text, '')")} AS ws, {_LINES} AS ls FROM documents),
grams AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda j: ws[j:j + 2])) AS g FROM d),
twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r),
lines AS (SELECT r, source, text, unnest(ls) AS line FROM d),
keyed AS (SELECT r, source, text, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS key,
                 len({WORDS.format("line")}) AS words FROM lines),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source),
common AS (SELECT k.source, k.key FROM (SELECT source, key, count(DISTINCT text) AS n FROM keyed GROUP BY source, key) k
           JOIN hosts h ON k.source IS NOT DISTINCT FROM h.source WHERE k.n > 20 AND k.n > 0.005 * h.n),
gone AS (SELECT r, sum(words) AS n FROM keyed k JOIN common c ON k.key = c.key AND k.source IS NOT DISTINCT FROM c.source GROUP BY r),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
                CAST(len(coalesce(text, '')) - len(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, coalesce(g.n, 0) AS gone
         FROM d LEFT JOIN repeated p ON p.r = d.r LEFT JOIN gone g ON g.r = d.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.3 * n_words AS kept FROM base
"""


def op5_syncmer_fingerprints(spark, sf_dir):
    from ragloom.llm.syncmers import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op6_chat_formatting(spark, sf_dir):
    from pyspark.sql import functions as F

    from ragloom.llm.chat import format_conversations, masked_text, read_turns

    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT bigint(-7) AS conv_id, bigint(turn) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    out = format_conversations(told.unionByName(more)).withColumn("turns", read_turns(F.col("formatted")))
    out = out.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"len(regexp_replace({0}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))"
OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(20 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""


def op7_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from ragloom.llm.toxicity import fit, held_out, score

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_secret_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from ragloom.llm.secrets import THRESHOLD, findings, fit

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = findings(docs, fit(docs))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), (F.col("probability") >= THRESHOLD).cast("int").alias("is_secret"))


def op10_quality_classifier(spark, sf_dir):
    from pyspark.sql import functions as F

    from ragloom.llm.weak_labels import fit, score

    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights, _ = fit(docs)
    return score(docs, weights).select("doc_id", F.col("quality").alias("score"), (F.col("quality") >= 0.5).alias("kept"))


def op9_packing(spark, sf_dir):
    from pyspark.sql import functions as F

    from ragloom.llm.packing import pack

    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # one row group is one task's: dealt by ranges, so that the order stays that of doc_id
        docs = docs.repartitionByRange(cores, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return pack(docs)


def op11_embedding_near_dedup(spark, sf_dir):
    from ragloom.llm.cover_tree import similar_vectors

    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
reach(a, b) AS (SELECT a, a FROM (SELECT DISTINCT a FROM links) UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""


def op12_cross_tokenizer_alignment(spark, sf_dir):
    from pyspark.sql import functions as F

    from ragloom.llm.alignment import aligned, count_links

    rows = aligned(documents(spark, sf_dir).select("doc_id", "text"))
    rows = rows.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    return count_links(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_importance_resampling(spark, sf_dir):
    from ragloom.llm.importance import scores

    return scores(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = rf"""
WITH RECURSIVE c(i, bits, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, bits + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE bits < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM c WHERE bits = 8),
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
hashed AS (SELECT w, list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(encode(w))) // 2 + 1), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k - 1, 2) AS BIGINT))),
                                 lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)) AS v
           FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
bucket AS (SELECT w, xor(v, 4294967295) % 10000 AS bucket FROM hashed),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucket USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucket USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM bw)::DOUBLE AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON w.r = d.r),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (r)
"""


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_mixing": op3_mixing,
        "op4_quality_rules": op4_quality_rules,
        "op5_syncmer_fingerprints": op5_syncmer_fingerprints,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_toxicity": op7_toxicity,
        "op8_secret_scan": op8_secret_scan,
        "op9_packing": op9_packing,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_embedding_near_dedup": op11_embedding_near_dedup,
        "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op3_mixing": OP3_SQL,
        "op4_quality_rules": OP4_SQL,
        "op6_chat_formatting": OP6_SQL,
        "op11_embedding_near_dedup": OP11_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
