"""The queries of this package, each over its whole table, and their SQL."""

import tempfile
import uuid
import zlib

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.llm import (
    chat, fingerprints, jaccard, mixing, pii, prefix_trie, quality, runs, secrets, sentencepiece, token_counts,
    topk, toxicity,
)
from premia.storage import new_path, store


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark, sf_dir):
    sized = store(mixing.sizes(_documents(spark, sf_dir)), "mix-sizes")
    return mixing.with_draws(sized, mixing.plan(sized)).select(
        "doc_id", "size", F.col("words").alias("source_size"), "target",
        (F.col("size") * F.size("draws")).alias("taken"))


def op2_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op3_sentencepiece(spark, sf_dir):
    docs, path = _documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece.decode(sentencepiece.encode(docs, path), path)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        F.length("decoded").cast("bigint").alias("n_decoded"))


def op4_pii(spark, sf_dir):
    """Counts are of the base spans, like their digest; ``spans`` has the added ones too."""
    docs = _documents(spark, sf_dir)
    found = pii.personal_data(docs, pii.train(docs))
    base = found.withColumn("found", F.filter("found", lambda s: s["base"]))
    return base.select("doc_id", *map(_count_kind, pii.KINDS), "base_sha256", "spans")


def op5_token_counts(spark, sf_dir):
    """A cache of its own for each call, so that what is timed is the counting."""
    return token_counts.count_tokens(
        _documents(spark, sf_dir), _new_cache(spark), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _new_cache(spark):
    cache = new_path(spark, "token-cache")
    if cache is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return cache or f"{tempfile.gettempdir()}/token-cache-{uuid.uuid4()}"


def op6_toxicity(spark, sf_dir):
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.severities(docs, toxicity.train(docs, labels))


def op7_quality(spark, sf_dir):
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.quality_scores(docs, quality.train(docs, labels))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(store(topk.points(vectors, copies=5), "topk-points"),
                      store(topk.query_rows(vectors, 50, copies=5), "topk-queries"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.classes(_documents(spark, sf_dir))


def op10_secrets(spark, sf_dir):
    found = secrets.secret_spans(_documents(spark, sf_dir))
    return found.select("doc_id", *map(_count_kind, ("assign", "access", "hex")), "base_sha256",
                        "spans")


def op11_prefix_trie(spark, sf_dir):
    """The trie of all conversations, each rebuilt to open with the first h turns of conversation
    c - c % 20 (h = crc32 of the decimal id, mod 4). Ties of turn go by the digest of the turn."""
    turns = prefix_trie.turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), "c1", "c2")) - 1
    original = store(turns.select("conv_id", place.cast("bigint").alias("pos"), "c1", "c2", "words"),
                     "trie-turns")
    sizes = original.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")),
                       "base", "left")
    convs = convs.select("conv_id", "base", "h",
                         F.least("h", F.coalesce("n_base", F.lit(0))).alias("k"))
    opening = (original.where(F.col("pos") < 4).withColumnRenamed("conv_id", "base")
               .join(convs.select("base", "conv_id", "h"), "base").where(F.col("pos") < F.col("h"))
               .select("conv_id", "pos", "c1", "c2", "words"))
    own = (original.join(convs.select("conv_id", "h", "k"), "conv_id").where(F.col("pos") >= F.col("h"))
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "c1", "c2", "words"))
    return prefix_trie.trie(opening.unionByName(own), convs.select("conv_id")).drop("d1", "d2")


def op12_runs(spark, sf_dir):
    """Runs of every whole text, words first repeated as ``planted`` says."""
    return runs.run_table(_documents(spark, sf_dir), planted)


def planted(doc_id, words):
    """h = crc32 of the decimal id: where h % 10 is 0, words from a = g % n on repeat the stretch
    of p = 1 + (n - a) // (3 + g % 8) words that starts at a (g = h // 10). A null id keeps its words."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_chat_format(spark, sf_dir):
    """All conversations and conversation -1, rendered, stored, and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rendered = chat.render(chat.reconstruct(chat.messages_as_events(turns.unionByName(probe))))
    return chat.digests(chat.read_back(store(rendered, "chat-rendered")))


def _count_kind(kind):
    return (F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
            .alias(f"n_{kind}"))


QUERIES = {f.__name__: f for f in (
    op1_mix, op2_fingerprints, op3_sentencepiece, op4_pii, op5_token_counts, op6_toxicity, op7_quality,
    op8_topk, op9_jaccard_join, op10_secrets, op11_prefix_trie, op12_runs, op13_chat_format)} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {"op13_chat_format": r"""
WITH turns AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
written AS (
    SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;') AS r,
              replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;') AS t
    FROM plain)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(t) + 10) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
""", "op8_topk": """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                      AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""", "op9_jaccard_join": r"""
WITH RECURSIVE texts AS (
    SELECT text, copies, row_number() OVER (ORDER BY text) AS k FROM (
        SELECT coalesce(text, '') AS text, count(*) AS copies FROM documents GROUP BY 1)),
words AS (
    SELECT k, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM texts),
starts AS (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words),
shingles AS (SELECT DISTINCT k, coalesce(array_to_string(w[i:i + 4], ' '), '') AS s FROM starts),
sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY k),
shared AS (
    SELECT x.k AS a, y.k AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.k <> y.k GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.k = a JOIN sizes q ON q.k = b
    WHERE common >= 0.8 * (p.n + q.n - common)),
reached AS (
    SELECT k AS a, k AS b FROM texts
    UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
roots AS (SELECT a AS k, min(b) AS root FROM reached GROUP BY a),
counted AS (
    SELECT a AS k, count(*) AS n_text_links, sum(copies) AS others
    FROM links JOIN texts ON texts.k = b GROUP BY a)
SELECT doc_id, CAST(min(doc_id) OVER (PARTITION BY root) AS BIGINT) AS class_id,
       CAST(texts.copies - 1 + coalesce(others, 0) AS BIGINT) AS n_links,
       CAST(coalesce(n_text_links, 0) AS BIGINT) AS n_text_links
FROM documents JOIN texts ON texts.text = coalesce(documents.text, '')
JOIN roots USING (k) LEFT JOIN counted USING (k)
"""}
