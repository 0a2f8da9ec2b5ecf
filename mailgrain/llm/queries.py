"""The thin queries ``opN_<name>``: each operator on its whole intended table, reduced to the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.llm import base, brown, chat, decontaminate, jaccard, media, neardup, packing, runs, search, substrings, suffixes, toxicity, wavelet


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file of this machine; the executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(base.table(spark, sf_dir, "documents"))


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(base.store(media.encode_texts(base.table(spark, sf_dir, "documents")), "media"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(base.table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.with_verdict(
        decontaminate.benchmark_hits(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, base.table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_passages(base.table(spark, sf_dir, "documents"), keep_text=False)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(base.table(spark, sf_dir, "documents"), keep_text=False)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(base.table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(
        base.table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), base.new_path(spark, "wavelet"))
    return wavelet.read_documents(shards)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(base.store(chat.format_turns(rows), "chat"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(base.table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_periodic_tails(base.table(spark, sf_dir, "documents")))
    start, length, period = (runs.longest(c) for c in ("start", "length", "period"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown": op1_brown,
    "op2_progressive_jpeg": op2_progressive_jpeg,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_substrings": op6_substrings,
    "op7_suffixes": op7_suffixes,
    "op8_best_fit": op8_best_fit,
    "op9_wavelet": op9_wavelet,
    "op10_chat": op10_chat,
    "op11_jaccard": op11_jaccard,
    "op12_search": op12_search,
    "op13_runs": op13_runs,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(pattern: str, lower: bool = True) -> str:
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')" if lower else "coalesce(text, '')"
    return f"regexp_extract_all({text}, '{pattern}')"


def components_sql(size: int, kept: bool) -> str:
    """Every pair of documents that share a shingle, and the transitive closure of the links."""
    return f"""
        WITH RECURSIVE texts AS (SELECT doc_id, {_words_sql(SPACED)} AS words FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - {size - 2}), lambda i: array_to_string(words[i:i + {size - 1}], ' ')) END) AS shingle
            FROM texts),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT x, y FROM sides UNION SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x),
        least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
        found AS (
            SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
            FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON x = d.doc_id)
        SELECT *{', doc_id = component_id AS kept' if kept else ''} FROM found"""


CONTAMINATION_SQL = f"""
    WITH texts AS (SELECT doc_id, {_words_sql(ALNUM)} AS words FROM documents),
    items AS (SELECT item_id, {_words_sql(ALNUM)} AS words FROM benchmark),
    grams AS (
        SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS gram
        FROM items, unnest(range(1, greatest(len(words) - 11, 2))) r(i) WHERE len(words) > 0),
    places AS (
        SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS gram
        FROM texts, (SELECT DISTINCT size FROM grams) g, unnest(range(1, len(words) - size + 2)) r(i)),
    hits AS (SELECT doc_id, i, size, item_id FROM places JOIN grams USING (size, gram)),
    covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM hits) GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
PASSAGES_SQL = f"""
    WITH texts AS (SELECT doc_id, {_words_sql(SPACED, lower=False)} AS words FROM documents),
    places AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS gram FROM texts, unnest(range(1, len(words) - 48)) r(i)),
    late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM places) WHERE first < doc_id),
    gone AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(range(i, i + 50)) AS w FROM late)),
    each AS (SELECT doc_id, w, words[w] AS word FROM texts, unnest(range(1, len(words) + 1)) r(w)),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w) AS text FROM each ANTI JOIN gone USING (doc_id, w) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)"""
ORACLES: dict[str, str] = {
    "op3_near_duplicates": components_sql(4, kept=True),
    "op4_decontaminate": CONTAMINATION_SQL,
    "op6_substrings": PASSAGES_SQL,
    "op11_jaccard": components_sql(5, kept=False),
    "op12_search": rf"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM lengths),
        wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM postings, total GROUP BY term),
        scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), total
            GROUP BY item_id, doc_id),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
            FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
