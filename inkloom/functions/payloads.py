"""Model answers as JSON brought into fixed shapes, as Column expressions: fields by several names, lists of texts, whole numbers, defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.jsonx import salvaged

#: The names that a field of a payload goes by, in order.
NAME = ("name", "title", "entity", "item", "organization", "organization_name")
DESCRIPTION = ("description", "summary", "info", "content", "detail", "note", "text")
SURFACE = ("surface_name", "name", "title", "entity", "item", "label")
EXCERPT = ("evidence_excerpt", "excerpt", "evidence", "quote")
FIELDS = {"character": ("character", "characters"), "special_existence": ("special_existence", "special_existences", "special_items"), "organizations": ("organizations", "origanizations"), "world_rules": ("world_rules",)}
#: What a chapter's answer may cover, and what counts as yes.
COVERAGE = ("process", "title_source", "identity_definition", "first_appearance", "chapter_number", "ability", "causal_actor", "ending_fate")
YES = ("1", "true", "yes", "y", "是")
#: The lists of texts in a profile.
PROFILE_LISTS = ("narrative_role", "personality_and_style", "appearance", "goals_and_motivation", "stance_and_alignment", "abilities_and_resources", "stable_profile", "speech_style", "current_state", "turning_points", "key_events")
KEY_ENTITIES = {"protagonists": ("protagonists",), "important_characters": ("important_characters", "new_characters"), "organizations": ("organizations", "factions"), "characters_who_appear": ("characters_who_appear", "all_characters"), "factions_who_appear": ("factions_who_appear", "all_factions", "organizations", "factions")}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def clean(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def fields(raw: Column, *names: str) -> Column:
    """The named fields of a JSON object as raw texts; all null for what is no object."""
    return F.from_json(salvaged(raw), "struct<" + ",".join(f"`{n}`:string" for n in names) + ">")


def first_text(of: Column, names: tuple[str, ...]) -> Column:
    """The first of several fields that says something, trimmed; empty if none does."""
    return F.coalesce(*[F.nullif(F.trim(of[n]), F.lit("")) for n in names], F.lit(""))


def elements(raw: Column) -> Column:
    """The elements of a JSON list as raw texts; none for what is no list."""
    return F.filter(F.coalesce(F.when(clean(raw).startswith("["), F.from_json(clean(raw), "array<string>")), F.array().cast("array<string>")), lambda x: x.isNotNull())


def texts(raw: Column) -> Column:
    """The distinct non-empty texts of a JSON list, trimmed, in order."""
    return F.array_distinct(F.filter(F.transform(elements(raw), lambda x: F.trim(x)), lambda x: x != ""))


def integer(raw: Column, other: Column) -> Column:
    """A whole number that is not 0, else another one."""
    return let(F.trim(raw).try_cast("bigint"), lambda n: F.when(n != 0, n).otherwise(other))


def positive(raw: Column) -> Column:
    """The distinct positive whole numbers of a JSON list, in order."""
    return F.array_distinct(F.filter(F.transform(elements(raw), lambda x: x.try_cast("bigint")), lambda x: x > 0))


def is_yes(raw: Column, other: Column) -> Column:
    return F.when(raw.isNull(), other).otherwise(F.lower(F.trim(raw)).isin(*YES))


def described(raw: Column) -> Column:
    """array<struct<name, description>>: a list of objects (fields by several names) or of names, an object of name and description, or one name; distinct, those without either left out."""
    none = F.array().cast("array<struct<name:string,description:string>>")
    pair = lambda n, d: F.struct(n.alias("name"), d.alias("description"))
    one = lambda x: F.when(F.trim(x).startswith("{"), let(fields(x, *dict.fromkeys(NAME + DESCRIPTION)), lambda o: pair(first_text(o, NAME), first_text(o, DESCRIPTION)))).otherwise(pair(F.trim(x), F.lit("")))
    object_ = F.transform(F.map_entries(F.from_json(clean(raw), "map<string,string>")), lambda e: pair(F.trim(e["key"]), clean(e["value"])))
    found = F.when(clean(raw).startswith("["), F.transform(elements(raw), one)).when(clean(raw).startswith("{"), F.coalesce(object_, none)).when(clean(raw) != "", F.array(pair(clean(raw), F.lit("")))).otherwise(none)
    return F.array_distinct(F.filter(found, lambda x: (x["name"] != "") | (x["description"] != "")))


def mentions(raw: Column) -> Column:
    """array<struct<surface_name, description, evidence_excerpt>> of a list of objects; distinct, empty ones left out."""
    one = lambda x: let(fields(x, *dict.fromkeys(SURFACE + DESCRIPTION + EXCERPT)), lambda o: F.struct(first_text(o, SURFACE).alias("surface_name"), first_text(o, DESCRIPTION).alias("description"), first_text(o, EXCERPT).alias("evidence_excerpt")))
    found = F.transform(F.filter(elements(raw), lambda x: F.trim(x).startswith("{")), one)
    return F.array_distinct(F.filter(found, lambda x: (x["surface_name"] != "") | (x["description"] != "") | (x["evidence_excerpt"] != "")))


def lines(items: Column) -> Column:
    """Lines `name：description` (either alone if the other is missing); null without any."""
    one = lambda x: F.when((x["name"] != "") & (x["description"] != ""), F.concat(x["name"], F.lit("："), x["description"])).otherwise(F.concat(x["name"], x["description"]))
    return F.nullif(F.array_join(F.transform(items, one), "\n"), F.lit(""))


def chapter_payload(raw: Column) -> Column:
    """struct(chapter_summary, character, special_existence, organizations, world_rules, payload) of a chapter's answer: the summary (the whole text without one), the lists as lines, and all as canonical JSON."""
    known = fields(raw, "chapter_summary", "ambiguous_character_mentions", *dict.fromkeys(n for ns in FIELDS.values() for n in ns))

    def shaped(o: Column) -> Column:
        given = lambda names: F.coalesce(*[F.nullif(F.nullif(F.nullif(o[n], F.lit("")), F.lit("[]")), F.lit("{}")) for n in names])
        lists = {name: described(given(names)) for name, names in FIELDS.items()}
        summary = F.coalesce(F.nullif(clean(o["chapter_summary"]), F.lit("")), clean(raw))
        whole = F.to_json(F.struct(summary.alias("chapter_summary"), lists["character"].alias("character"), mentions(o["ambiguous_character_mentions"]).alias("ambiguous_character_mentions"), *[lists[n].alias(n) for n in ("special_existence", "organizations", "world_rules")]))
        return F.struct(summary.alias("chapter_summary"), F.coalesce(lines(lists["character"]), F.lit("")).alias("character"), *[lines(lists[n]).alias(n) for n in ("special_existence", "organizations", "world_rules")], whole.alias("payload"))

    return let(known, shaped)


def payload_fault(raw: Column) -> Column:
    """Why a chapter's answer can't be kept: null if it can. All four lists must be there, as lists of objects with a name and a description; mentions may be missing."""
    lists = ("character", "special_existence", "world_rules", "organizations")
    known = fields(raw, "chapter_summary", "ambiguous_character_mentions", *dict.fromkeys(n for ns in FIELDS.values() for n in ns))
    names = (*NAME, "rule", "label")

    def of_list(name: str, value: Column) -> Column:
        each = F.transform(elements(value), lambda x, i: F.when(~F.trim(x).startswith("{"), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("] is not an object"))).otherwise(let(fields(x, *dict.fromkeys(names + DESCRIPTION)), lambda o: F.when(first_text(o, names) == "", F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("] missing name"))).when(first_text(o, DESCRIPTION) == "", F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("] missing description"))))))
        return F.when(~clean(value).startswith("["), f"{name} is not a list").otherwise(F.get(F.array_compact(each), F.lit(0)))

    def of_mentions(value: Column) -> Column:
        missing = lambda o, i: F.coalesce(*[F.when(first_text(o, ns) == "", F.concat(F.lit("ambiguous_character_mentions["), i.cast("string"), F.lit(f"] missing {n}"))) for n, ns in (("surface_name", SURFACE), ("description", DESCRIPTION), ("evidence_excerpt", EXCERPT))])
        each = F.transform(elements(value), lambda x, i: let(fields(x, *dict.fromkeys(SURFACE + DESCRIPTION + EXCERPT)), lambda o: missing(o, i)))
        return F.when(value.isNotNull(), F.when(~clean(value).startswith("["), "ambiguous_character_mentions is not a list").otherwise(F.get(F.array_compact(each), F.lit(0))))

    def fault(o: Column) -> Column:
        value = {n: F.coalesce(*[o[k] for k in FIELDS[n][:2]]) for n in lists}
        return F.coalesce(F.when(o.isNull() | (salvaged(raw) == ""), "payload is not a JSON object"), F.when(clean(o["chapter_summary"]) == "", "missing chapter_summary"), *[of_list(n, value[n]) for n in lists], of_mentions(o["ambiguous_character_mentions"]))

    return let(known, fault)


def style_batch(raw: Column) -> Column:
    """struct(speech_style_signals, style_samples) of a roleplay batch; samples need a scene and a quote."""
    sample = lambda x: let(fields(x, "scene", "quote"), lambda o: F.struct(clean(o["scene"]).alias("scene"), clean(o["quote"]).alias("quote")))
    good = lambda xs: F.filter(F.transform(xs, sample), lambda s: (s["scene"] != "") & (s["quote"] != ""))
    return let(fields(raw, "speech_style_signals", "style_samples"), lambda o: F.struct(texts(o["speech_style_signals"]).alias("speech_style_signals"), good(elements(o["style_samples"])).alias("style_samples")))


def relation_summary(raw: Column) -> Column:
    """struct(target_character, relation_summary, primary_relation_type, secondary_emotional_tendencies, intensity, current_status, timeline): the timeline's entries need a chapter and a summary, in order of their chapters."""
    names = ("target_character", "relation_summary", "primary_relation_type", "secondary_emotional_tendencies", "intensity", "current_status", "timeline")
    entry = lambda x: let(fields(x, "chapter_start", "chapter_end", "summary"), lambda o: let(integer(o["chapter_start"], F.lit(0)), lambda s: F.struct(s.alias("chapter_start"), F.greatest(s, integer(o["chapter_end"], s)).alias("chapter_end"), clean(o["summary"]).alias("summary"))))
    line = lambda xs: F.array_sort(F.filter(F.transform(xs, entry), lambda e: (e["chapter_start"] > 0) & (e["summary"] != "")))
    return let(fields(raw, *names), lambda o: F.struct(*[clean(o[n]).alias(n) for n in names[:3]], texts(o["secondary_emotional_tendencies"]).alias("secondary_emotional_tendencies"), F.coalesce(F.nullif(F.lower(clean(o["intensity"])), F.lit("")), F.lit("medium")).alias("intensity"), clean(o["current_status"]).alias("current_status"), line(elements(o["timeline"])).alias("timeline")))


def relation_candidates(raw: Column, low: Column, high: Column) -> Column:
    """array<struct> of a batch's emotional candidates with a target, held within the window's chapters; missing evidence is the first chapter."""
    names = ("target_character", "primary_relation_type", "emotional_signals", "interaction_signals", "explicitness", "confidence", "intensity", "chapter_start", "chapter_end", "evidence_chapters", "summary")
    word = lambda c, other: F.coalesce(F.nullif(F.lower(clean(c)), F.lit("")), F.lit(other))

    def one(o: Column) -> Column:
        start = integer(o["chapter_start"], low)
        return let(F.greatest(low, start), lambda a: F.struct(
            clean(o["target_character"]).alias("target_character"), clean(o["primary_relation_type"]).alias("primary_relation_type"), texts(o["emotional_signals"]).alias("emotional_signals"), texts(o["interaction_signals"]).alias("interaction_signals"),
            word(o["explicitness"], "implicit").alias("explicitness"), word(o["confidence"], "low").alias("confidence"), word(o["intensity"], "medium").alias("intensity"), a.alias("chapter_start"), F.least(high, F.greatest(a, integer(o["chapter_end"], start))).alias("chapter_end"),
            let(positive(o["evidence_chapters"]), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(a))).alias("evidence_chapters"), clean(o["summary"]).alias("summary"),
        ))

    given = let(fields(raw, "emotional_relation_candidates"), lambda o: elements(o["emotional_relation_candidates"]))
    return F.filter(F.transform(given, lambda x: let(fields(x, *names), one)), lambda x: x["target_character"] != "")


def profile(raw: Column, first: Column, last: Column, aliases: Column) -> Column:
    """A profile's eighteen fields: identity (own aliases and chapters where the answer has none), lists of texts, style, relations, the course by volumes, and evidence with a chapter."""
    volume_lists = ("role_in_volume", "goals", "state_changes", "relationship_changes")
    known = fields(raw, "identity", "style_summary", "style_samples", "emotional_relations", "volume_arc", "critical_evidence", *PROFILE_LISTS)

    def identity(o: Column) -> Column:
        given = F.when(clean(o["aliases"]).startswith("["), texts(o["aliases"])).otherwise(F.array_distinct(F.filter(F.transform(aliases, lambda x: F.trim(x)), lambda x: x != "")))
        return F.struct(clean(o["summary"]).alias("summary"), given.alias("aliases"), integer(o["first_chapter_index"], first).alias("first_chapter_index"), integer(o["last_chapter_index"], last).alias("last_chapter_index"))

    def volume(o: Column) -> Column:
        n = integer(o["volume_index"], F.lit(0))
        title = F.when(n != 0, F.coalesce(F.nullif(clean(o["volume_title"]), F.lit("")), F.concat(F.lit("第"), n.cast("string"), F.lit("卷")))).otherwise(clean(o["volume_title"]))
        return F.struct(n.alias("volume_index"), title.alias("volume_title"), clean(o["summary"]).alias("summary"), *[texts(o[c]).alias(c) for c in volume_lists])

    objects = lambda raw_list: F.filter(elements(raw_list), lambda x: F.trim(x).startswith("{"))

    def shaped(o: Column) -> Column:
        arc = F.transform(objects(o["volume_arc"]), lambda x: let(fields(x, "volume_index", "volume_title", "summary", *volume_lists), volume))
        evidence = F.transform(objects(o["critical_evidence"]), lambda x: let(fields(x, "chapter_index", "reasons"), lambda e: F.struct(integer(e["chapter_index"], F.lit(0)).alias("chapter_index"), texts(e["reasons"]).alias("reasons"))))
        samples = style_batch(F.concat(F.lit('{"style_samples":'), F.coalesce(o["style_samples"], F.lit("[]")), F.lit("}")))["style_samples"]
        return F.struct(
            let(fields(o["identity"], "summary", "aliases", "first_chapter_index", "last_chapter_index"), identity).alias("identity"), *[texts(o[c]).alias(c) for c in PROFILE_LISTS[:8]], clean(o["style_summary"]).alias("style_summary"), samples.alias("style_samples"),
            F.transform(objects(o["emotional_relations"]), relation_summary).alias("emotional_relations"), arc.alias("volume_arc"), *[texts(o[c]).alias(c) for c in PROFILE_LISTS[8:]], F.filter(evidence, lambda e: e["chapter_index"] > 0).alias("critical_evidence"),
        )

    return let(known, shaped)


def key_entities(raw: Column) -> Column:
    """struct of a plot's five lists of names; an older field stands in for an empty one."""
    known = fields(raw, *dict.fromkeys(n for ns in KEY_ENTITIES.values() for n in ns))
    first = lambda o, names: F.coalesce(*[let(texts(o[n]), lambda t: F.when(F.size(t) > 0, t)) for n in names], F.array().cast("array<string>"))
    return let(known, lambda o: F.struct(*[first(o, names).alias(n) for n, names in KEY_ENTITIES.items()]))


def present(raw: Column, kind: str = "character") -> Column:
    """array<struct> of the people (or factions) in a plot that have a name."""
    lists = ("aliases", "major_actions") if kind == "character" else ("aliases", "members_involved", "major_actions", "status_change")
    scalars = ("role_in_plot", "dialogue_presence", "importance") if kind == "character" else ("role_in_plot", "importance")
    one = lambda o: F.struct(first_text(o, ("name", f"{kind}_name")).alias("name"), *[texts(o[c]).alias(c) for c in lists], *[clean(o[c]).alias(c) for c in scalars])
    found = F.transform(F.filter(elements(raw), lambda x: F.trim(x).startswith("{")), lambda x: let(fields(x, "name", f"{kind}_name", *lists, *scalars), one))
    return F.filter(found, lambda x: x["name"] != "")


def interactions(raw: Column) -> Column:
    """array<struct<participants, type, chapter_range, summary, importance>> of those with a summary or participants."""
    names = ("participants", "characters", "summary", "desc", "type", "interaction_type", "chapter_range", "importance")
    one = lambda o: F.struct(texts(F.coalesce(o["participants"], o["characters"])).alias("participants"), first_text(o, ("type", "interaction_type")).alias("type"), clean(o["chapter_range"]).alias("chapter_range"), first_text(o, ("summary", "desc")).alias("summary"), clean(o["importance"]).alias("importance"))
    found = F.transform(F.filter(elements(raw), lambda x: F.trim(x).startswith("{")), lambda x: let(fields(x, *names), one))
    return F.filter(found, lambda x: (x["summary"] != "") | (F.size(x["participants"]) > 0))


def plot_facts(raw: Column, older: Column) -> Column:
    """struct(foreshadowing, world_rules, major_rewards, major_losses); what an older plot says elsewhere stands in for empty lists."""
    now = fields(raw, "foreshadowing", "world_rules", "major_rewards", "major_losses")
    then = fields(older, "foreshadowing", "items_obtained", "skills_learned", "status_change")
    marked = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    either = lambda a, b: let(a, lambda x: F.when(F.size(x) > 0, x).otherwise(b))
    return let(now, lambda n: let(then, lambda t: F.struct(
        either(texts(n["foreshadowing"]), texts(t["foreshadowing"])).alias("foreshadowing"), texts(n["world_rules"]).alias("world_rules"),
        either(texts(n["major_rewards"]), F.array_distinct(F.concat(texts(t["items_obtained"]), marked("技能成长: ", texts(t["skills_learned"]))))).alias("major_rewards"), either(texts(n["major_losses"]), marked("状态变化: ", texts(t["status_change"]))).alias("major_losses"),
    )))


def chapter_result(raw: Column, needs_fulltext: Column) -> Column:
    """struct(status, hit_chapters, best_evidence, needs_fulltext, coverage, reason) of a batch's answer; of one that is no object the chapters that it names as `Chapter 5`."""
    known = fields(raw, "status", "hit_chapters", "best_evidence", "needs_fulltext", "coverage", "reason")
    named = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"Chapter\s*\[?\s*(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))))
    hit = lambda xs: F.when(F.size(xs) > 0, "HIT").otherwise("MISS")
    beginning = F.substring(clean(raw), 1, 220)

    def shaped(o: Column) -> Column:
        hits = F.array_sort(F.array_distinct(F.filter(F.transform(elements(o["hit_chapters"]), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())))
        said = F.upper(clean(o["status"]))
        covered = let(fields(o["coverage"], *COVERAGE), lambda c: F.struct(*[is_yes(c[k], F.lit(False)).alias(k) for k in COVERAGE]))
        good = F.struct(F.when(said.isin("HIT", "MISS"), said).otherwise(hit(hits)).alias("status"), hits.alias("hit_chapters"), clean(o["best_evidence"]).alias("best_evidence"), is_yes(o["needs_fulltext"], needs_fulltext).alias("needs_fulltext"), covered.alias("coverage"), clean(o["reason"]).alias("reason"))
        nothing = F.struct(*[F.lit(False).alias(k) for k in COVERAGE])
        bad = F.struct(hit(named).alias("status"), named.alias("hit_chapters"), beginning.alias("best_evidence"), (needs_fulltext & (F.size(named) > 0)).alias("needs_fulltext"), nothing.alias("coverage"), beginning.alias("reason"))
        return F.when(salvaged(raw) == "", bad).otherwise(good)

    return let(known, shaped)
