"""Search by posting lists against the scan."""

import random

from pyspark.sql import functions as F

from mailgrain.operators import serving, textindex
from tests.helpers import YOU, message, messages


def mail(spark, n=300):
    own = random.Random(2)
    words = ["Invoice", "project", "Größe", "naïve", "x", "ab", "approval", "日本語", "𝒳𝒴𝒵", "re-project"]
    rows = [message(i * 7919, i, subject=" ".join(own.choices(words, k=own.randint(0, 3))), body_text=own.choice([None, "", " ".join(own.choices(words, k=12))]))
            for i in range(n)]
    rows += [message(900_001, 1, subject=None, body_text="end of subject: app"), message(900_002, 1, subject="app", body_text="roval"),
             message(900_003, 1, is_sent=True, from_email=YOU, subject="project")]
    return messages(spark, *rows)


def test_equal_to_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "PART_MESSAGES", 40)
    m, path = mail(spark).cache(), str(tmp_path / "index")
    textindex.build_text_index(m, path)
    rank = spark.createDataFrame([(i * 7919, (i * 37) % 300) for i in range(250)], "email_id bigint, priority_rank int")
    for query in ("Project", "approval", "ab", "x", "größe", "日本語", "𝒳𝒴", "t re-p", "nothing like it", "aaa", ""):
        want = {tuple(r) for r in serving.search_messages(m, rank, query, None).collect()}
        assert {tuple(r) for r in textindex.search_index(spark, path, rank, query, None).collect()} == want, query
    top = [r["id"] for r in serving.search_messages(m, rank, "project", 5).collect()]
    assert [r["id"] for r in textindex.search_index(spark, path, rank, "project", 5).collect()] == top


def test_reads_the_folders_of_the_needle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "PART_MESSAGES", 20)
    m = mail(spark, 400).unionByName(messages(spark, message(5_000_001, 2, subject="a zyxwv needle")))
    path = str(tmp_path / "index")
    textindex.build_text_index(m, path)
    folders = {p.name for p in (tmp_path / "index" / "texts").iterdir() if p.name.startswith("part=")}
    assert len(folders) > 15
    found = textindex.matching(spark, path, "ZYXWV")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in found.collect()] == [5_000_001]
    # one part is left, and it is named in the partition filter of the texts
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(5_000_001).cast("bigint")), F.lit(len(folders)))).first()[0]
    assert f"(part" in plan and f"= {part})" in plan.replace(f"IN ({part})", f"= {part})")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "index")
    textindex.build_text_index(messages(spark, message(1, is_sent=True)), path)
    assert textindex.matching(spark, path, "anything").count() == 0
