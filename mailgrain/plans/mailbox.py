"""From messages to ranked inbox, tasks and projects in one run (operators R1, R2, Q11)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.functions.clean import prepare_for_embedding
from mailgrain.operators import (
    actions, clusters, contacts, entities, features, labeling, priority, projects, rules, tables, threads,
)
from mailgrain.operators.vectors import Encoder, embed
from mailgrain.session import bound_batches
from mailgrain.sources.documents import id_collisions
from mailgrain.streaming.ingest import embedding_inputs

STEPS = [
    "threads", "messages", "features", "vectors", "classes", "contacts", "clusters", "cluster_metadata", "priority",
    "labels", "cluster_profiles", "contexts", "tasks", "projects", "activity",
]
STAGE_MIN_SCORE = 0.3
VECTOR_SCHEMA = "email_id bigint, embedding array<float>, token_count int, content_hash string"
LABEL_SCHEMA = (
    "email_id bigint, raw_response string, raw_prompt string, action_type string, urgency string, "
    "ai_can_handle string, next_step string, suggested_action string, one_liner string, prompt_tokens int, "
    "completion_tokens int, total_tokens int, parse_error boolean"
)


@dataclass
class MailboxRun:
    """One run over a message table.

    Every step's table is written under ``root`` and read back, so a later
    step starts from files and a lost executor costs the running step only.
    ``encoder`` and ``scorer`` are the user's callables (R1); without them the
    vector and label steps give empty tables.
    """

    root: str
    addresses: list[str]
    now: object
    encoder: Encoder | None = None
    scorer: labeling.Scorer | None = None
    skip_vectors: bool = False
    skip_labels: bool = False
    seed: int = 42
    restarts: int = 10
    user_id: str | None = None
    content_clusters: str = "kmeans"
    results: dict[str, DataFrame] = field(default_factory=dict)

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        self.results[name] = tables.refresh(df, f"{self.root}/{name}")
        return self.results[name]

    def run(self, source: DataFrame, start_from: str | None = None) -> dict[str, DataFrame]:
        """Run all steps, or those from ``start_from`` on with earlier tables read from ``root``."""
        spark = source.sparkSession
        bound_batches(spark)
        if not id_collisions(source).isEmpty():
            raise ValueError("different messages share an id; see id_collisions")
        first = STEPS.index(start_from) if start_from else 0

        def step(name: str, build) -> DataFrame:
            if STEPS.index(name) < first:
                tables.recover(spark, f"{self.root}/{name}")
                self.results[name] = spark.read.parquet(f"{self.root}/{name}")
                return self.results[name]
            return self._keep(name, build())

        you = self.addresses[0] if self.addresses else ""
        thread = step("threads", lambda: threads.build_threads(source))
        # the frequent-sender rule of the action cascade reads profiles of the same mailbox
        mail = step(
            "messages",
            lambda: actions.label_actions(source, contacts.build_contacts(source, you), self.addresses),
        )
        feature = step("features", lambda: features.message_features(mail))
        vector = step("vectors", lambda: self._vectors(mail, feature))
        cls = step("classes", lambda: rules.classify_messages(mail, feature))
        people = step("contacts", lambda: contacts.build_contacts(mail, you))
        placed = step(
            "clusters", lambda: clusters.assign_clusters(mail, feature, vector, self.seed, self.restarts, self.content_clusters)
        )
        meta = step(
            "cluster_metadata", lambda: clusters.cluster_metadata(clusters.cluster_rollup(placed, mail, feature))
        )
        ranked = step("priority", lambda: priority.rank_messages(mail, feature, vector, placed))
        label = step("labels", lambda: self._labels(mail, feature, cls, people, ranked))
        profiles = step("cluster_profiles", lambda: self._profiles(meta, placed, mail, feature))
        made, _ = entities.extract_entities(
            label, cls, mail, people, profiles, placed, ranked, thread, self._stored(spark, "tasks", entities.TASK_TABLE),
            self._stored(spark, "projects", entities.PROJECT_TABLE), self._stored(spark, "contexts", "email_id bigint"),
            self.now, self.user_id,
        )
        for name in ("contexts", "tasks", "projects"):
            step(name, lambda name=name: self._merged(name, made[name]))
        step(
            "activity",
            lambda: projects.temporal_strength(projects.temporal_activity(placed, mail, self.now), self.now),
        )
        return self.results

    def _stored(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """A table of an earlier run that this one merges into, empty without one."""
        if tables.recover(spark, f"{self.root}/{name}"):
            return spark.read.parquet(f"{self.root}/{name}")
        return spark.createDataFrame([], schema)

    def _merged(self, name: str, df: DataFrame) -> DataFrame:
        """A table that is built from its own earlier state goes to a folder of its own first."""
        return tables.refresh(df, f"{self.root}/_merged/{name}")

    def _profiles(self, meta: DataFrame, placed: DataFrame, mail: DataFrame, feature: DataFrame) -> DataFrame:
        """Cluster metadata with participants, activity, project flags and, with a scorer, labels."""
        activity = projects.cluster_activity(placed, mail)
        rich = projects.enrich_clusters(meta, activity)
        found = projects.detect_projects(rich, activity, self.now, min_score=STAGE_MIN_SCORE)
        rich = projects.apply_detection(rich, found)
        if self.skip_labels or self.scorer is None:
            return rich
        rich = tables.refresh(rich, f"{self.root}/_unlabelled_clusters")
        prompts = labeling.cluster_label_prompts(rich.filter(F.col("auto_label").isNull()), mail, feature)
        replies = labeling.score_with(prompts, self.scorer, ["dimension", "cluster_id"])
        return labeling.apply_cluster_labels(rich, labeling.cluster_labels(replies.filter(F.col("error").isNull())))

    def _vectors(self, mail: DataFrame, feature: DataFrame) -> DataFrame:
        if self.skip_vectors or self.encoder is None:
            return mail.sparkSession.createDataFrame([], VECTOR_SCHEMA)
        return embed(prepare_for_embedding(embedding_inputs(mail, feature)), self.encoder)

    def _labels(self, mail, feature, cls, people, ranked) -> DataFrame:
        empty = mail.sparkSession.createDataFrame([], LABEL_SCHEMA)
        if self.skip_labels or self.scorer is None:
            return empty
        queue = labeling.llm_queue(mail, feature, cls, people, ranked, empty, limit=None)
        return labeling.model_labels(labeling.score_with(labeling.build_prompts(queue), self.scorer, ["email_id"]))

    def row_counts(self) -> DataFrame:
        """``step, records`` of the tables written."""
        counts = [df.agg(F.count(F.lit(1)).alias("records")).withColumn("step", F.lit(name)) for name, df in self.results.items()]
        out = counts[0]
        for one in counts[1:]:
            out = out.unionByName(one)
        return out.select("step", "records")


def refresh_after_batch(
    messages: DataFrame, features: DataFrame, vectors: DataFrame, root: str, addresses: list[str],
    seed: int = 42, restarts: int = 10,
) -> dict[str, DataFrame]:
    """Q11: rebuild threads, actions, contacts, clusters and priority after ingested batches."""
    you = addresses[0] if addresses else ""
    out = {"threads": tables.refresh(threads.build_threads(messages), f"{root}/threads")}
    # the stored actions are rebuilt too: a reply may have arrived since
    unlabelled = messages.withColumns({c: F.lit(None).cast(messages.schema[c].dataType) for c in actions.LABEL_COLUMNS})
    mail = actions.label_actions(unlabelled, contacts.build_contacts(messages, you), addresses)
    mail = out["messages"] = tables.refresh(mail, f"{root}/messages_labelled")
    out["contacts"] = tables.refresh(contacts.build_contacts(mail, you), f"{root}/contacts")
    placed = clusters.assign_clusters(mail, features, vectors, seed, restarts)
    placed = out["clusters"] = tables.refresh(placed, f"{root}/clusters")
    out["priority"] = tables.refresh(priority.rank_messages(mail, features, vectors, placed), f"{root}/priority")
    return out
