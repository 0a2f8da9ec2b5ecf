"""Relational operators against literal values and, for hot keys, brute force."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailgrain.functions import scoring as S
from mailgrain.functions.normalize import lowered
from mailgrain.operators import actions, clusters, contacts, entities, eventlog, features, labeling, priority, projects, rules, serving, threads
from mailgrain.operators import tables as T
from mailgrain.operators import vectors as vec
from tests.helpers import START, YOU, message, messages


def test_threads(spark):
    m = messages(
        spark, message(1), message(2, 10, is_sent=True, from_email=YOU, in_reply_to="m1", attachment_count=2),
        message(3, 40, from_email=None, has_attachments=None, date_parsed=None), message(4, 0, thread_id=None),
    )
    row = threads.build_threads(m).first()
    assert (row["email_count"], row["your_email_count"], row["your_reply_count"]) == (3, 1, 1)
    assert row["participants"] == ["ann@x.example", YOU]
    assert row["thread_duration_seconds"] == 600 and row["avg_response_time_seconds"] == 600
    assert row["has_attachments"] is False and row["total_attachment_count"] == 2


def test_action_cascade(spark):
    old = -60 * 24 * 30
    m = messages(
        spark, message(1), message(2, 30, is_sent=True, from_email=YOU, in_reply_to="m1"),
        message(3, 20, is_sent=True, from_email=YOU, in_reply_to="m1"), message(4, labels=["Starred"]),
        message(5, old, labels=["Archived"]), message(6, old, labels=["Unread"]), message(7, old, labels=["Unread", "Inbox"], cc_emails=["z@x"]),
        message(8, labels=["Unread"]), message(9, old, labels=["Unread"], from_email="busy@x.example"), message(10, old, labels=None),
        message(11, 60, in_reply_to="m2", from_email="mailer-daemon@x"), message(12, 90, in_reply_to="m2", from_email="bob@x.example"),
        message(13, from_email=YOU.upper()),
    )
    people = spark.createDataFrame([("Busy@x.example", 21)], "email string, emails_from int")
    out = {r["id"]: r for r in actions.label_actions(m, people, [YOU]).collect()}
    assert {i: r["action"] for i, r in out.items()} == {
        1: "REPLIED", 2: "COMPOSED", 3: "COMPOSED", 4: "STARRED", 5: "ARCHIVED", 6: "IGNORED", 7: "ARCHIVED", 8: "PENDING",
        9: "ARCHIVED", 10: "PENDING", 11: "PENDING", 12: "PENDING", 13: "COMPOSED",
    }
    assert (out[1]["response_time_seconds"], out[1]["timing"]) == (1200, "IMMEDIATE")
    assert (out[2]["response_time_seconds"], out[2]["timing"]) == (3600, "SAME_DAY")
    assert out[6]["timing"] == "NEVER"


def test_hot_thread_and_hot_reply_target(spark):
    """A third of all messages answer one mail and sit in one thread."""
    rows = [message(0, thread_id="hot")] + [
        message(i, i, thread_id="hot" if i % 3 == 0 else f"t{i}", in_reply_to="m0" if i % 3 == 0 else None, is_sent=i % 3 == 0,
                from_email=f"s{i % 50}@x.example")
        for i in range(1, 900)
    ]
    m = messages(spark, *rows)
    hot = threads.build_threads(m).filter("thread_id = 'hot'").first()
    assert hot["email_count"] == 300
    assert hot["participants"] == sorted({r["from_email"] for r in rows if r["thread_id"] == "hot"})
    assert hot["avg_response_time_seconds"] == pytest.approx(180)
    assert [tuple(r) for r in actions.replied(m).collect()] == [(0, 180, "IMMEDIATE")]


@pytest.mark.parametrize("sender, subject, body, expected", [
    ("noreply@x.org", "Hi", "", (True, 0.3, None)),
    ("bob@x.org", "Hi", "click unsubscribe", (True, 0.3, None)),
    ("bob@x.org", "Weekly digest", "", (False, 0.2, "newsletter")),
    ("noreply@x.org", "Your order", "unsubscribe", (True, 0.8, "transactional")),
    ("bob@x.org", "Hi", "", (False, 0.0, None)),
])
def test_service_detection(spark, sender, subject, body, expected):
    df = lowered(spark.createDataFrame([(sender, subject, body)], "a string, b string, c string"), frm="a", sub="b", bod="c")
    got = df.select(S.service_detection("frm", "sub", "bod").alias("s")).first()["s"]
    assert (got["is_service"], pytest.approx(got["confidence"]), got["service_type"]) == (expected[0], expected[1], expected[2])


def test_feature_scores(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first()["v"]

    lit = F.lit
    assert value(S.relationship_strength(lit(20), lit(1.0), lit(1.0), lit(0), lit(1.0))) == pytest.approx(1.0)
    assert value(S.relationship_strength(lit(0), lit(0.0), lit(0.0), lit(90), lit(0.0))) == 0.0
    assert value(S.urgency_score(lit(0.0), lit(7), lit(False), lit(False))) == pytest.approx(0.1)
    assert value(S.urgency_score(lit(1.0), lit(0), lit(True), lit(True))) == pytest.approx(1.0)
    assert value(S.time_bucket(lit(21))) == "night" and value(S.time_bucket(lit(5))) == "morning"
    assert value(S.business_hours(lit(17), lit(0))) is False and value(S.business_hours(lit(16), lit(4))) is True


def test_message_features(spark):
    m = messages(
        spark, message(1, -60 * 24 * 10, body_text="<p>Hi there</p> <b>unsubscribe</b>"), message(2, subject="a b c", cc_emails=["x@y"]),
        message(3, 30, is_sent=True, from_email=YOU, to_emails=["ann@x.example"], in_reply_to="m2"),
    )
    out = {r["email_id"]: r for r in features.message_features(m).collect()}
    assert set(out) == {1, 2}
    assert (out[2]["emails_from_sender_7d"], out[2]["emails_from_sender_30d"]) == (1, 2)
    assert out[2]["user_replied_to_sender_rate"] == 0.5 and out[2]["avg_response_time_hours"] == pytest.approx(0.5)
    assert out[2]["user_initiated_ratio"] == pytest.approx(1 / 3)
    assert out[1]["has_unsubscribe_link"] and out[1]["body_word_count"] == 3 and out[1]["days_since_received"] == 10
    assert (out[2]["subject_word_count"], out[2]["recipient_count"], out[2]["hour_of_day"], out[2]["day_of_week"]) == (3, 2, 10, 0)


def test_contacts(spark):
    m = messages(
        spark, message(1, from_name="Ann"), message(2, 5, from_email=" ANN@x.example ", from_name="Bea", in_reply_to="m9", thread_id="u"),
        message(3, 9, is_sent=True, from_email=YOU, to_emails=["ann@x.example"], cc_emails=["me.too@corp.example", "nodomain"]),
    )
    out = {r["email"]: r for r in contacts.build_contacts(m, YOU).collect()}
    ann = out["ann@x.example"]
    assert (ann["name"], ann["emails_from"], ann["emails_to"], ann["threads_with"], ann["reply_count"]) == ("Bea", 2, 1, 2, 1)
    assert ann["reply_rate"] == 1.0 and ann["is_important_sender"] is True
    assert out[YOU]["is_you"] and out["me.too@corp.example"]["is_you"] and "nodomain" not in out


@pytest.mark.parametrize("body, subject, strength, service, kind, expected", [
    ("", "", 0.0, True, "marketing", ("ai_full", "service_marketing")),
    ("", "Accepted: lunch", 0.9, False, None, ("ai_full", "calendar_response")),
    ("", "Out of office", 0.0, False, None, ("ai_full", "auto_reply")),
    ("opt out here", "", 0.1, False, None, ("ai_full", "newsletter_pattern")),
    ("your order shipped", "", 0.0, True, "transactional", ("ai_full", "transactional")),
    ("please approve", "", 0.0, False, None, ("human_required", "approval_request")),
    ("hi", "", 0.7, False, None, ("human_required", "important_relationship")),
    ("let me know", "", 0.3, False, None, ("human_required", "explicit_reply_request")),
    ("please, urgent", "", 0.0, False, None, ("human_required", "deadline_request")),
    ("zoom tomorrow", "", 0.3, False, None, ("ai_partial", "scheduling_request")),
    ("fyi", "", 0.2, False, None, ("ai_partial", "fyi_from_contact")),
    ("confirm it", "", 0.1, False, None, ("ai_partial", "confirm_request")),
    ("see attached", "", 0.0, False, None, ("ai_partial", "has_attachment")),
    ("hi", "", 0.3, False, None, ("needs_llm", "ambiguous")),
])
def test_rule_outcomes(spark, body, subject, strength, service, kind, expected):
    m = messages(spark, message(1, body_text=body, subject=subject))
    f = spark.createDataFrame(
        [(1, strength, service, kind)], "email_id bigint, relationship_strength double, is_service_email boolean, service_type string"
    )
    row = rules.classify_messages(m, f).first()
    assert (row["predicted_handleability"], row["classification_reason"]) == expected
    meta = json.loads(row["classification_metadata"])
    assert ("llm_priority" in meta) == (expected[0] == "needs_llm") and "patterns" in meta


def test_minmax_and_blend(spark):
    rows = spark.createDataFrame([(1, 0.8), (2, 0.4), (3, None)], "email_id int, x double")
    assert {r["email_id"]: r["x"] for r in vec.minmax(rows, "x").collect()} == {1: pytest.approx(1.0), 2: 0.0}
    assert vec.minmax(rows.filter("email_id = 1"), "x").first()["x"] == 0.0
    empty = "email_id int, {} double"
    out = priority.combine_priority(
        spark.createDataFrame([(1, 1.0)], "email_id int, feature_score double"),
        *[spark.createDataFrame([], empty.format(c)) for c in priority.COMPONENTS],
    ).first()
    assert out["replied_similarity"] == 0.5 and out["priority_score"] == pytest.approx(0.35 + 0.5 * 0.65)


def test_llm_flags(spark):
    scores = spark.createDataFrame([(1, 0.8), (2, 0.3), (3, 0.55), (4, 0.45), (5, 0.2)], "email_id bigint, priority_score double")
    m = messages(spark, message(1), message(2, action="REPLIED"), message(3, action="IGNORED"), message(4), message(5))
    placed = spark.createDataFrame([(4, -1), (5, -1)], "email_id bigint, content_cluster_id int")
    out = {r["email_id"]: r["llm_reason"] for r in priority.llm_flags(scores, m, placed).collect()}
    assert out == {1: "high_priority", 2: "replied_training", 3: "high_priority_ignored", 4: "novel_content", 5: None}


def test_rank_with_one_score_on_most_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("email_id"), F.when(F.col("id") % 3 == 0, 0.9).otherwise(0.5).alias("priority_score"))
    got = {r["email_id"]: r["priority_rank"] for r in priority.priority_rank(rows).collect()}
    want = sorted(range(5000), key=lambda i: (-(0.9 if i % 3 == 0 else 0.5), i))
    assert [got[i] for i in want] == list(range(1, 5001))


def test_centroid_and_distance(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [2.0, 2.0])], "email_id bigint, g string, embedding array<float>")
    out = {r["g"]: r["centroid"] for r in vec.centroid(v, ["g"]).collect()}
    assert out == {"a": [0.5, 0.5], "b": [2.0, 2.0]}
    from mailgrain.functions.vectors import cosine_distance, load_vector

    d = v.select(cosine_distance("embedding", F.array(F.lit(1.0), F.lit(0.0))).alias("d")).collect()
    assert [round(r["d"], 4) for r in d] == [0.0, 1.0, 0.2929]
    zero = v.select(cosine_distance("embedding", F.array(F.lit(0.0), F.lit(0.0))).alias("d")).first()["d"]
    assert zero is None
    assert spark.range(1).select(load_vector(F.lit("[1, 2.5]")).alias("v")).first()["v"] == [1.0, 2.5]


def test_clusters_are_seeded_and_bounded(spark):
    rows = spark.createDataFrame([(i, float(i % 4), float(i % 4) * 2) for i in range(80)], "email_id bigint, a double, b double")
    out = clusters.membership(clusters.cluster(rows, "temporal", restarts=2)).collect()
    assert len(out) == 80 and all(0.0 <= r["prob"] <= 1.0 for r in out)
    assert len({r["cluster"] for r in out}) <= 6
    groups = {}
    for r in out:
        groups.setdefault(r["email_id"] % 4, set()).add(r["cluster"])
    assert all(len(c) == 1 for c in groups.values())


def test_projects(spark):
    now = datetime(2024, 2, 1)
    rules_ = projects.ProjectRules()
    ages = spark.createDataFrame([(1, now - timedelta(days=3)), (2, now - timedelta(days=20)), (3, now - timedelta(days=31)), (4, None)], "id int, last timestamp")
    status = {r["id"]: r["s"] for r in ages.select("id", S.project_status(F.col("last"), F.lit(now), rules_).alias("s")).collect()}
    assert status == {1: "active", 2: "stale", 3: "completed", 4: "stale"}
    act = spark.createDataFrame([(7, 0, now), (0, 0, now), (2, 4, None)], "emails_7d bigint, emails_prev_7d bigint, last_activity timestamp")
    out = [(r["activity_velocity"], r["activity_trend"], r["temporal_strength"]) for r in projects.temporal_strength(act, now).collect()]
    assert out[0] == (pytest.approx(0.2), 1.0, pytest.approx(0.35 + 0.07 + 0.3))
    assert out[1][1] == 0.0 and out[2][1] == -0.5


def test_entities(spark):
    m = messages(spark, message(1, subject="Plan"), message(2, from_email="noreply@x.example"), message(3, subject="Plan"))
    people = spark.createDataFrame(
        [("ann@x.example", "Ann", False, 5, 0.6, True), ("noreply@x.example", None, False, 9, None, False)],
        "email string, name string, is_you boolean, emails_from bigint, reply_rate double, is_important_sender boolean",
    )
    labels = spark.createDataFrame(
        [(1, "reply", "today", None), (2, "task", "today", "x"), (3, "fyi", None, None)], "email_id bigint, action_type string, urgency string, one_liner string"
    )
    tasks = entities.tasks_from_model(labels, m, people).collect()
    assert [(t["task_id"], t["description"], t["task_type"], round(t["urgency_score"], 3)) for t in tasks] == [("llm_1_reply", "[Ann] Plan", "send", 0.9)]
    project = entities.projects_from_people(m, people).first()
    assert (project["name"], project["project_type"], project["confidence"]) == ("Conversation: Ann", "key_relationship", 0.95)


def test_append_events_is_gapless_and_repeatable(spark):
    log = spark.createDataFrame([("t", 4), ("u", 1)], "thread_id string, seq bigint")
    new = spark.createDataFrame([(f"e{i:03}", "t" if i % 3 else "v", 1000 + (i // 2) * 1_800_000) for i in range(60)], "event_id string, thread_id string, ts bigint")
    first = {r["event_id"]: r["seq"] for r in eventlog.append_events(log, new).collect()}
    again = {r["event_id"]: r["seq"] for r in eventlog.append_events(log, new.repartition(3)).collect()}
    assert first == again
    assert sorted(first[f"e{i:03}"] for i in range(60) if i % 3) == list(range(5, 45))
    assert [first[f"e{i:03}"] for i in range(0, 60, 3)] == list(range(1, 21))


def test_ten_turns_give_thirty_rising_events(spark):
    turns = spark.createDataFrame(
        [(f"c{i:02}", "t", "s", "u", "o", i, "text" if i % 2 else "voice", "hi", 0.9, 10) for i in range(10)],
        "correlation_id string, thread_id string, session_id string, user_id string, org_id string, ts bigint, input_type string, text string, confidence double, duration_ms int",
    )
    events = eventlog.append_events(spark.createDataFrame([], "thread_id string, seq bigint"), eventlog.expand_turns(turns))
    rows = events.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 31))
    assert [r["type"] for r in rows[:3]] == ["turn.user.open", "stt.final", "turn.user.close"]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, w int")
    assert sorted(map(tuple, T.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    copies = spark.createDataFrame([("x", 2), ("x", 1), ("", 5), (None, 6), ("y", 7)], "id string, n int")
    got = T.insert_new(spark.createDataFrame([("y", 0)], "id string, n int"), copies, "id", [F.asc("n")]).collect()
    assert list(map(tuple, got)) == [("x", 1)]


def test_model_replies(spark):
    rows = spark.createDataFrame([(1, '```json\n{"action_type": "task"}\n```'), (2, "oops"), (3, '{"urgency": "today"}')], "id int, r string")
    out = {r["id"]: r["p"] for r in rows.select("id", labeling.parse_model_json("r").alias("p")).collect()}
    assert out[1]["result"]["action_type"] == "task" and not out[1]["parse_error"]
    assert out[2]["parse_error"] and out[2]["result"] is None
    assert out[3]["result"]["urgency"] == "today"


def test_scorer_errors_are_kept(spark):
    def scorer(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [{"response": "{}", "prompt_tokens": 3, "completion_tokens": 1} for _ in prompts]

    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "email_id bigint, prompt string").coalesce(1)
    out = {r["email_id"]: r for r in labeling.score_with(prompts, scorer, ["email_id"]).collect()}
    assert out[1]["total_tokens"] == 4 and out[2]["raw_response"] is None and out[2]["error"] == "no"
    usage = labeling.usage_rollup(labeling.score_with(prompts, scorer, ["email_id"])).first()
    assert (usage["tokens"], usage["errors"], usage["saved"]) == (4, 1, 1)


def test_task_actions(spark):
    tasks = spark.createDataFrame(
        [("a", "pending", "d", None), ("b", "pending", "d", None), ("c", "pending", "d", None)],
        "task_id string, status string, description string, completed_at timestamp",
    )
    changes = spark.createDataFrame(
        [("a", "complete", START, None), ("b", "delete", START, None), ("c", "patch", START, "new")], "task_id string, verb string, at timestamp, description string"
    )
    out = {r["task_id"]: r for r in serving.apply_task_actions(tasks, changes).collect()}
    assert set(out) == {"a", "c"} and out["a"]["status"] == "completed" and out["a"]["completed_at"] == START
    assert out["c"]["description"] == "new"
