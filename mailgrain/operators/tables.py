"""Table maintenance and checks (operators A4-A11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: a folder of this ending holds a table that is about to replace another
STAGED = ".staged"


def first_per_key(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """One row per key, the first in ``order_by``.

    A rank filter of 1 is pushed below the shuffle by Spark, so a key that
    holds a large share of the rows leaves each task as a single row.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order_by: list[Column] | None = None) -> DataFrame:
    """A4: incoming rows whose key is new; the first row of each key counts.

    Rows with a null or empty key are dropped.
    """
    keyed = incoming.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    order_by = order_by or [F.col(c) for c in incoming.columns if c != key and _orderable(incoming, c)] or [F.col(key)]
    once = first_per_key(keyed, [key], order_by)
    return once.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def _orderable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant")


def insert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """A4 bookkeeping: ``total, inserted, skipped``."""
    usable = incoming.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    per_key = usable.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    known = existing.select(key).withColumn("_known", F.lit(True))
    counted = per_key.join(known, key, "left").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("usable"),
        F.count(F.when(F.col("_known").isNull(), 1)).alias("inserted"),
    )
    total = incoming.agg(F.count(F.lit(1)).alias("total"))
    return counted.select(
        total.scalar().alias("total"), "inserted", (total.scalar() - F.col("inserted")).alias("skipped")
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], update_cols: list[str] | None = None) -> DataFrame:
    """A5: keyed insert-or-update; keys are unique on both sides.

    Matched rows take ``update_cols`` (default: all non-key columns) from
    ``incoming``, nulls included; the rest of the row stays.
    """
    columns = existing.columns
    update_cols = update_cols or [c for c in columns if c not in keys]
    old = existing.withColumn("_old", F.lit(True)).alias("old")
    new = incoming.withColumn("_new", F.lit(True)).alias("new")
    condition = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    joined = old.join(new, condition, "full_outer")
    is_new, is_old = F.col("new._new").isNotNull(), F.col("old._old").isNotNull()

    def value(column: str) -> Column:
        if column in keys:
            return F.coalesce(F.col(f"old.{column}"), F.col(f"new.{column}")).alias(column)
        if column not in incoming.columns:
            return F.col(f"old.{column}").alias(column)
        take_new = is_new if column in update_cols else is_new & ~is_old
        return F.when(take_new, F.col(f"new.{column}")).otherwise(F.col(f"old.{column}")).alias(column)

    return joined.select(*[value(c) for c in columns])


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A5 bookkeeping: ``created, updated`` of an upsert."""
    known = existing.select(*keys).withColumn("_known", F.lit(True)).alias("old")
    new = incoming.select(*keys).alias("new")
    condition = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    return new.join(known, condition, "left").agg(
        F.count(F.when(F.col("_known").isNull(), 1)).alias("created"),
        F.count(F.when(F.col("_known").isNotNull(), 1)).alias("updated"),
    )


def _filesystem(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a refresh that stopped between its two last steps; whether there is a table at ``path`` then."""
    files, folder = _filesystem(spark, path)
    staged = folder.suffix(STAGED)
    done = spark._jvm.org.apache.hadoop.fs.Path(staged, "_SUCCESS")
    if not files.exists(folder) and files.exists(done):
        files.rename(staged, folder)
    return files.exists(folder)


def refresh(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Rewrite a derived table and return it read back, lineage cut.

    The new table is written beside the old one and takes its place when it is whole, so a stop at any point leaves the
    old table or the new one; :func:`recover` finds the new one where the old one is gone already.  ``df`` may read
    the table it replaces.
    """
    spark = df.sparkSession
    recover(spark, path)
    files, folder = _filesystem(spark, path)
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path + STAGED)
    files.delete(folder, True)
    if not files.rename(folder.suffix(STAGED), folder):
        raise OSError(f"cannot move {path}{STAGED} to {path}")
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def archive_profile(messages: DataFrame) -> DataFrame:
    """Totals of an archive in one pass."""
    return messages.agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count_if(F.coalesce(F.col("body_text"), F.lit("")) != "").alias("emails_with_body"),
        F.count_if(F.col("has_attachments")).alias("emails_with_attachments"),
    )


def label_histogram(messages: DataFrame, top: int | None = 50) -> DataFrame:
    """Messages per label, most frequent first; ``top=None`` lists all labels by name."""
    counts = messages.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts.orderBy("label")
    return counts.orderBy(F.desc("n"), "label").limit(top)


def derived_table_status(
    spark: SparkSession, tables: dict[str, DataFrame], messages: DataFrame, classes: DataFrame, model_labels: DataFrame
) -> DataFrame:
    """One row with the size of every derived table and what is left to label."""
    received = messages.agg(
        F.count(F.lit(1)).alias("emails"), F.count_if(F.col("is_sent")).alias("sent_emails")
    )
    counts = {name: df.agg(F.count(F.lit(1))) for name, df in tables.items()}
    needs = classes.agg(F.count_if(F.col("predicted_handleability") == "needs_llm"))
    done = model_labels.agg(F.count(F.lit(1)))
    out = received.select(
        "emails",
        "sent_emails",
        (F.col("emails") - F.col("sent_emails")).alias("received_emails"),
        *[count.scalar().alias(name) for name, count in counts.items()],
        needs.scalar().alias("needs_llm"),
        done.scalar().alias("llm_classification"),
    )
    return out.withColumn("llm_remaining", F.greatest(F.lit(0), F.col("needs_llm") - F.col("llm_classification")))


def pending_rows(
    base: DataFrame, done: DataFrame, key: str, order_by: list[Column] | None = None, limit: int | None = None
) -> DataFrame:
    """Rows of ``base`` not in ``done``, oldest first."""
    rest = base.join(done.select(key), key, "left_anti")
    if limit is None:
        return rest
    return rest.orderBy(*(order_by or [F.col(key)])).limit(limit)


def constraint_report(df: DataFrame, rules: dict[str, Column], unique_keys: list[str] | None = None) -> DataFrame:
    """A10: ``rule, violations`` rows.

    A rule is the condition valid rows meet; null counts as a violation only
    where the rule says so.  All rules are counted in one pass, each unique
    key in one more.
    """
    names = list(rules)
    counted = df.agg(*[F.count_if(~F.coalesce(rules[n], F.lit(True))).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    report = counted.selectExpr(f"stack({len(names)}, {pairs}) AS (rule, violations)")
    for key in unique_keys or []:
        copies = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        report = report.unionByName(
            copies.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
                F.lit(f"{key} unique").alias("rule"), "violations"
            )
        )
    return report


def message_rules() -> dict[str, Column]:
    return {"message_id present": F.col("message_id").isNotNull()}


def task_rules() -> dict[str, Column]:
    from mailgrain.constants import TASK_COMPLEXITIES, TASK_STATUSES, TASK_TYPES

    rules = {
        "urgency_score in [0,1]": F.col("urgency_score").between(0.0, 1.0),
        "task_type known": F.col("task_type").isin(TASK_TYPES),
        "status known": F.col("status").isin(TASK_STATUSES),
        "description 1..1000 chars": F.length("description").between(1, 1000),
    }
    rules["complexity known"] = F.col("complexity").isin(TASK_COMPLEXITIES)
    return rules


def project_rules() -> dict[str, Column]:
    return {
        "name 1..200 chars": F.length("name").between(1, 200),
        "priority in 0..5": F.col("priority").between(0, 5),
    }


def tenant_scope(df: DataFrame, user_id: str | None = None, org_id: str | None = None, lookup: bool = False) -> DataFrame:
    """Rows of one tenant.

    Without a tenant a listing is unfiltered, while a key lookup
    (``lookup=True``) asks for rows that belong to nobody.
    """
    if user_id is not None or lookup:
        df = df.filter(F.col("user_id").eqNullSafe(F.lit(user_id)))
    if org_id is not None:
        df = df.filter(F.col("org_id") == org_id)
    return df
