"""Hot keys, and rows that must not get lost."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import actions, entities, features, labeling, priority, serving
from mailgrain.operators.vectors import embed
from mailgrain.sources import documents
from mailgrain.streaming import ingest
from tests.helpers import START, YOU, message, messages

HOT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def hot_mail(spark):
    """40,000 messages, 70 % of them from one sender, without broadcast joins."""
    before = {k: spark.conf.get(k) for k in HOT_CONF}
    for k, v in HOT_CONF.items():
        spark.conf.set(k, v)
    one = messages(spark, message(0))
    hot = F.when(F.col("n") % 10 < 7, F.lit("hot@x.example")).otherwise(F.concat(F.lit("s"), F.col("n") % 997, F.lit("@x.example")))
    mail = spark.range(40_000).withColumnRenamed("id", "n").crossJoin(F.broadcast(one)).withColumns({
        "id": F.col("n"), "message_id": F.concat(F.lit("m"), F.col("n")), "from_email": hot,
        "date_parsed": F.timestamp_seconds(F.unix_timestamp("date_parsed") + F.col("n")),
    }).drop("n").repartition(8)
    yield mail
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_sender_is_split_for_features(hot_mail):
    assert "skew=true" in largest_plan(features.message_features(hot_mail).select("email_id", "relationship_strength"))


def test_hot_sender_is_split_for_actions(spark, hot_mail):
    contacts = hot_mail.groupBy(F.col("from_email").alias("email")).agg(F.count(F.lit(1)).alias("emails_from"))
    flagged = actions.with_frequent_flag(hot_mail.select("id", "from_email"), contacts)
    assert "skew=true" in largest_plan(flagged)
    assert flagged.filter("_frequent").count() >= 28_000


def test_hot_sender_vectors_do_not_move_for_small_centroids(spark, hot_mail):
    vectors = hot_mail.select(F.col("id").alias("email_id"), F.array(F.rand(1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    placed = priority.placed_vectors(vectors, hot_mail)
    plan = priority._sender_raw(placed)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_parts_of_any_depth(spark):
    def nested(levels, leaf):
        return {"mimeType": "multipart/mixed", "parts": [nested(levels - 1, leaf) if levels > 1 else leaf]}

    leaf = {"mimeType": "text/plain", "filename": "a.txt", "body": {"data": "aGVsbG8"}}
    docs = [json.dumps({"id": str(n), "payload": nested(n, leaf)}) for n in (1, 8, 9, 40, 200)] + [json.dumps({"id": "0", "payload": None}), "no json", None]
    rows = documents.parse_api_messages(spark.createDataFrame([(d,) for d in docs], "json string")).collect()
    assert {r["provider_id"]: (r["body_text"], r["has_attachments"]) for r in rows} == {
        **{str(n): ("hello", True) for n in (1, 8, 9, 40, 200)}, "0": ("", False)}


def test_phases_keep_every_message(spark):
    now = START + timedelta(days=20)
    mail = messages(spark, message(1), message(2, 60 * 24 * 40), message(3, -60 * 24 * 200), message(4, date_parsed=None))
    phases = {r["id"]: r["phase"] for r in ingest.phase_partition(mail, now).collect()}
    assert phases == {1: "standard", 2: "quick", 3: None, 4: None}
    assert sum(r["messages"] for r in ingest.phase_plan(ingest.phase_partition(mail, now)).collect()) == 2


def test_search_returns_as_many_as_asked(spark):
    mail = messages(spark, *[message(i, subject="needle") for i in range(70)])
    ranks = spark.createDataFrame([], "email_id bigint, priority_rank bigint")
    assert serving.search_messages(mail, ranks, "Needle", 65).count() == 65
    assert serving.search_messages(mail, ranks, "Needle", None).count() == 70


def test_colliding_ids_are_found(spark):
    mail = messages(spark, message(1, message_id="a"), message(1, message_id="b"), message(2, message_id="c"))
    assert [tuple(r) for r in documents.id_collisions(mail).collect()] == [(1, 2)]


def test_short_replies_are_not_labels(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "email_id bigint, prompt string").coalesce(1)
    rows = labeling.score_with(prompts, lambda asked: [{"response": "x"}] * (len(asked) - 1), ["email_id"]).collect()
    assert all(r["raw_response"] is None and r["error"] == "no answer" for r in rows)
    texts = spark.createDataFrame([(i, "t", 1, "h") for i in range(5)], "email_id bigint, text string, token_count int, content_hash string").coalesce(1)
    rows = embed(texts, lambda asked: [[1.0]] * (1 if len(asked) == 1 else len(asked) - 1)).collect()
    assert len(rows) == 5


def test_merge_keeps_what_the_user_did(spark):
    old = spark.createDataFrame(
        [("llm_1_task", 1, "old text", "completed", "u"), ("mine", 9, "own", "pending", "u")], "task_id string, email_id bigint, description string, status string, user_id string")
    new = spark.createDataFrame(
        [("llm_1_task", 1, "new text", "pending"), ("ai_2", 2, "other", "pending")], "task_id string, email_id bigint, description string, status string")
    merged = {r["task_id"]: r for r in entities.merge_tasks(old, new, START, "v").collect()}
    assert (merged["llm_1_task"]["description"], merged["llm_1_task"]["status"], merged["llm_1_task"]["user_id"]) == ("new text", "completed", "u")
    assert merged["mine"]["description"] == "own"
    assert (merged["ai_2"]["user_id"], merged["ai_2"]["created_at"]) == ("v", START)
    people = spark.createDataFrame(
        [("Conversation: A", "conversation", "a@x", 2, None, "real_person_thread", 0.7)],
        "name string, project_type string, owner_email string, email_count bigint, cluster_id int, detected_from string, confidence double")
    first = entities.merge_projects(spark.createDataFrame([], entities.PROJECT_TABLE), people, START, "v")
    again = entities.merge_projects(first.withColumn("is_active", F.lit(False)), people.withColumn("name", F.lit("B")).withColumn("project_type", F.lit("key_relationship")), START, "w")
    row = again.first()
    assert (row["name"], row["project_type"], row["is_active"], row["user_id"]) == ("B", "key_relationship", False, "v")
    assert row["project_id"] == first.first()["project_id"] and YOU


def test_python_gets_bounded_batches(spark):
    """Few long texts come to Python in several batches; all of them were one batch of up to 10,000 rows."""
    from mailgrain.functions.clean import normalize_chars
    from mailgrain.operators.labeling import score_with
    from mailgrain.operators.vectors import embed
    from mailgrain.session import ARROW_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        texts = spark.range(0, 40, 1, 1).select(
            F.col("id").alias("email_id"), F.repeat(F.lit("word "), 200_000).alias("text"), F.lit(1).alias("token_count"), F.lit("").alias("content_hash"))
        # each call names the size of the batch that it was given
        sizes = embed(texts, lambda batch: [[float(sum(map(len, batch)))] for _ in batch], batch=10_000)
        got = [r["embedding"][0] for r in sizes.collect()]
        assert len(got) == 40 and max(got) <= ARROW_BYTES + 1_000_000
        prompts = texts.select("email_id", F.col("text").alias("prompt"))
        scored = score_with(
            prompts, lambda batch: [{"response": "", "prompt_tokens": sum(map(len, batch))} for _ in batch], ["email_id"], batch=10_000)
        got = [r["prompt_tokens"] for r in scored.select("prompt_tokens").collect()]
        assert len(got) == 40 and max(got) <= ARROW_BYTES + 1_000_000
        spark.conf.unset(name)
        import __spark_entry__
        __spark_entry__._prepare(spark)  # what every registered query begins with, C6 and L6 too
        assert int(spark.conf.get(name)) == ARROW_BYTES
        whole = texts.select(F.length(normalize_chars(F.concat("text", F.lit("—")))).alias("n"))
        assert {r["n"] for r in whole.collect()} == {1_000_001}
    finally:
        spark.conf.set(name, had) if had is not None else spark.conf.unset(name)
