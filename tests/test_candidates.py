"""Names tied by records, and passages that share a beginning, against plain Python."""

import random

from pyspark.sql import functions as F

from inkloom.functions.names import BRIDGE_QUOTES, BRIDGES
from inkloom.operators import candidates, evidence


def test_bridged_names(spark):
    draw = random.Random(5)
    names = ["Customer#%09d" % k for k in range(30)] + ["Customer#00000000", "甲", "甲乙", "甲乙丙 丁", "改名为甲"]
    items = []
    for k, name in enumerate(names):
        records = [(str(i), "".join(draw.choice(["他", " ", "“", "”", "'", *BRIDGES, *names]) for _ in range(8))) for i in range(3)]
        items.append((k, " " + name, [draw.choice(names)], records + [("9", None)]))
    given = spark.createDataFrame(items, "item_id bigint, name string, aliases array<string>, records array<struct<chapter:string,text:string>>")
    expected = set()
    for a, _, _, records in items:
        for b, name, aliases, _ in items:
            forms = [x + q + n.strip() + z for n in (name, *aliases) for x in BRIDGES for q, z in BRIDGE_QUOTES.items()]
            if a != b and any(f in (t or "").strip(" ") for _, t in records for f in forms):
                expected.add((a, b))
    got = [tuple(r) for r in candidates.bridged(given).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 50


def test_places_do_not_meet_every_passage_of_their_beginning(spark):
    passages = spark.range(2000).select(F.col("id").alias("item_id"), F.format_string("Customer#%09d", F.col("id")).alias("passage"))
    texts = spark.range(2000).select(F.col("id").alias("doc_id"), F.format_string("about Customer#%09d now", F.col("id")).alias("text"))
    starts = texts.select("doc_id", F.lit(7).alias("at"), F.col("text").substr(7, 8).alias("start"))
    found = evidence.begun(starts, passages, texts, 8)
    assert found.where("item_id = doc_id AND at = 7").count() == found.count() == 2000
    assert evidence.contained_by_runs(passages, texts).where("item_id = doc_id").count() == evidence.contained_by_runs(passages, texts).count() == 2000
