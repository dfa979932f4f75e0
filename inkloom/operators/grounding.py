"""Which entities a question names, how, and how surely."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import name_key
from inkloom.operators.evidence import contained
from inkloom.operators.facts import unwrapped

#: What a match of each mode is worth.
MODES = {"exact_name": 1.0, "exact_alias": 0.97, "substring_name": 0.86, "substring_alias": 0.84}
SURE = 0.97


def matches(questions: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, entity_type, source_id, name, matched, mode, confidence, nth) of questions (query_id, place, text) and entities (entity_type, source_id, name, aliases).

    A name counts if the text has it as it is, else if both have it without blanks and case (two characters at least); aliases likewise, below it. Of an entity's matches the surest counts (the first
    text's, the name before aliases). Matches are ordered by confidence, length of what matched and of the name; the first twenty stay. Names meet texts as `contained` does.
    """
    clean = lambda c: unwrapped(c)
    name = clean(F.col("name"))
    forms = F.concat(F.array(F.struct(F.lit(0).alias("nth_form"), name.alias("form"))), F.transform(F.filter(F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), clean)), lambda a: (a != "") & (a != name)), lambda a, i: F.struct((i + 1).alias("nth_form"), a.alias("form"))))
    known = entities.select("entity_type", "source_id", name.alias("_name"), F.explode(forms).alias("f")).withColumnRenamed("_name", "name").select("entity_type", "source_id", "name", "f.nth_form", "f.form").where("name <> '' AND form <> ''")
    known = known.withColumn("key", name_key(F.col("form")))
    asked = questions.select("query_id", "place", F.trim("text").alias("text")).where("text <> ''").withColumn("text_key", name_key(unwrapped(F.col("text"))))
    held = contained(known.select(F.col("key").alias("item_id"), F.col("key").alias("passage")).distinct(), asked.select(F.col("text_key").alias("doc_id"), F.col("text_key").alias("text")).distinct())
    met = held.withColumnsRenamed({"item_id": "key", "doc_id": "text_key"}).join(known, "key").join(asked, "text_key")
    exact = F.contains("text", "form")
    own = F.col("nth_form") == 0
    enough = F.length("key") >= 2
    mode = F.when(own & exact, "exact_name").when(~own & exact & enough, "exact_alias").when(own & enough, "substring_name").when(enough, "substring_alias")
    met = met.withColumn("mode", mode).where("mode IS NOT NULL")
    worth = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])[F.col("mode")]
    met = met.withColumn("confidence", worth)
    best = met.groupBy("query_id", "entity_type", "source_id").agg(F.min_by(F.struct("name", F.col("form").alias("matched"), F.regexp_replace("mode", "substring_name", "substring_alias").alias("mode"), "confidence"), F.struct(-F.col("confidence"), "place", "nth_form")).alias("m"))
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc(F.length("matched")), F.desc(F.length("name")), "entity_type", "source_id")
    rows = best.select("query_id", "entity_type", "source_id", "m.*")
    return rows.withColumn("nth", F.row_number().over(order).cast("bigint")).where(F.col("nth") <= most)


def decisions(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, applied, reason, entity_type, source_ids): whether a question's matches settle on one entity."""
    sure = F.col("confidence") >= SURE
    per = found.groupBy("query_id").agg(
        F.count_if(sure).alias("n"), F.count_distinct(F.when(sure, F.struct("entity_type", "source_id"))).alias("sources"), F.count_distinct(F.when(sure, F.struct("entity_type", name_key(F.col("name"))))).alias("targets"),
        F.min_by("entity_type", F.when(sure, F.col("nth"))).alias("entity_type"), F.collect_set(F.when(sure, F.struct("entity_type", "source_id"))).alias("all"),
    )
    rows = questions.select("query_id").distinct().join(per, "query_id", "left")
    reason = F.when(F.col("n").isNull(), "no_grounding_match").when(F.col("n") == 0, "no_high_confidence_grounding").when((F.col("sources") > 1) & (F.col("targets") > 1), "ambiguous_grounding").otherwise("high_confidence_alias_grounding")
    rows = rows.withColumn("reason", reason).withColumn("applied", F.col("reason") == "high_confidence_alias_grounding")
    ids = F.array_sort(F.transform(F.filter("all", lambda x: x["entity_type"] == F.col("entity_type")), lambda x: x["source_id"]))
    none = F.array().cast("array<bigint>")
    return rows.select("query_id", "applied", "reason", F.when(F.col("applied"), F.col("entity_type")).otherwise("").alias("entity_type"), F.when(F.col("applied"), ids.cast("array<bigint>")).otherwise(none).alias("source_ids"))
