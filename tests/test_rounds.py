"""The rounds of search against a plain loop, over whole small tables and on hand-made cases."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from inkloom.operators import rounds
from inkloom.operators.search import STOPWORDS
from inkloom.plans import questions, registry


def terms(text):
    found = []
    for w in re.findall("[一-鿿a-z0-9_]+", (text or "").lower()):
        if w not in STOPWORDS and w not in found:
            found.append(w)
    return found


def windows_of(scores, done):
    """The best cluster of a part's chapters that it hasn't done with, clipped."""
    left = sorted(c for c in scores if c not in done)
    groups = []
    for c in left:
        if groups and c - groups[-1][-1] <= 2:
            groups[-1].append(c)
        else:
            groups.append([c])
    if not groups:
        return None
    best = max(groups, key=lambda g: (round(sum(scores[c] for c in g), 9), -g[0]))
    return best[0], min(best[-1], best[0] + 7)


def by_hand(parts, hits, share):
    """{part: (status, reason, rounds, calls, windows, chapters)}; share(part, chapter) gives the shares of its terms in the summary and the text, or None where its windows can't look."""
    state = {p["part_id"]: {**p, "calls": 0, "windows": 0, "stale": 0, "pending": None, "status": None, "reason": None} for p in parts}
    pool, done = collections.defaultdict(list), collections.defaultdict(set)
    for part, source, chapter, score in hits:
        pool[part].append((source, chapter, score))
    for _ in range(20):
        plan = {}
        spent = collections.Counter()
        for s in state.values():
            spent[s["query_id"], "calls"] += s["calls"]
            spent[s["query_id"], "windows"] += s["windows"]
        for part, s in state.items():
            if s["status"]:
                continue
            scores = collections.defaultdict(float)
            for _, chapter, score in pool[part]:
                scores[chapter] += score
            window = s["pending"] or windows_of(scores, done[part])
            why = "resolved" if any(x[0] == "chapters" for x in pool[part]) else "no_new_coordinates" if s["stale"] >= 2 else "no_candidates" if window is None else None
            if why:
                s["status"], s["reason"] = "resolved" if why == "resolved" else "unresolved", why
                continue
            direct = s["intent"] in ("first_appearance", "ending_fate", "quote_micro_detail") and window[1] - window[0] + 1 <= 3
            plan[part] = ("read" if s["pending"] or direct else "check", window)
        nth = collections.Counter()
        for part in sorted(plan, key=lambda p: (not state[p]["explicit"], state[p]["priority"], p)):
            s, (action, (low, high)) = state[part], plan[part]
            q = s["query_id"]
            nth[q] += 1
            nth[q, "read"] += action == "read"
            no = "tool_budget" if nth[q] > s["tool_calls"] - spent[q, "calls"] else "fulltext_budget" if action == "read" and nth[q, "read"] > s["fulltext_windows"] - spent[q, "windows"] else None
            if no:
                s["status"], s["reason"] = "unresolved", no
                continue
            s["calls"] += 1
            s["windows"] += action == "read"
            shown = [c for c in range(low, high + 1) if share(part, c) and share(part, c)[action == "read"] >= (0.8 if action == "read" else 0.3)]
            known = {c for _, c, _ in pool[part]}
            s["stale"] = 0 if set(shown) - known else s["stale"] + 1
            s["pending"] = (min(shown), min(max(shown), min(shown) + 7)) if action == "check" and shown else None
            if action == "read":
                pool[part] = [x for x in pool[part] if not (x[0] == "chapter_summaries_verify" and low <= x[1] <= high)]
            pool[part] += [("chapters" if action == "read" else "chapter_summaries_verify", c, 0.95 if action == "read" else 0.66) for c in shown]
            if action == "read" or not shown:
                done[part] |= set(range(low, high + 1))
        if all(s["status"] for s in state.values()):
            break
    return {p: (s["status"], s["reason"], s["calls"], s["calls"], s["windows"], ",".join(map(str, sorted({c for k, c, _ in pool[p] if k == "chapters"})))) for p, s in state.items()}


def rows_of(found):
    return {r.part_id: (r.status, r.reason, r.rounds, r.calls, r.windows, r.chapters) for r in found.collect()}


def test_research_rounds(spark, small):
    got = registry.queries()["research_rounds"](spark, small)
    parts, hits = questions.round_parts(spark, small)
    parts, hits = [r.asDict() for r in parts.collect()], [tuple(r) for r in hits.select("part_id", "source", "chapter_index", "score").collect()]
    from inkloom.sources import tables

    chapters = {(r.book_id, r.chapter_index): (r.chapter_summary.lower(), r.content.lower()) for r in tables.chapters(spark, small).collect()}
    home, words = {p["part_id"]: p["book_id"] for p in parts}, {p["part_id"]: terms(p["question"]) for p in parts}
    reach = collections.defaultdict(set)
    for part, _, chapter, _ in hits:
        reach[part] |= {chapter - 1, chapter, chapter + 1}

    def share(part, chapter):
        texts = chapters.get((home[part], chapter)) if chapter in reach[part] else None
        return texts and tuple(sum(w in t for w in words[part]) / max(1, len(words[part])) for t in texts)

    want = by_hand(parts, hits, share)
    assert rows_of(got) == want
    assert {x[1] for x in want.values()} >= {"resolved", "no_candidates", "no_new_coordinates", "fulltext_budget"}
    spent = collections.Counter()
    for p in parts:
        spent[p["query_id"]] += want[p["part_id"]][3]
    assert all(spent[p["query_id"]] <= p["tool_calls"] for p in parts)


PARTS = "query_id bigint, part_id bigint, priority bigint, explicit boolean, book_id bigint, intent string, question string, tool_calls bigint, fulltext_windows bigint"


@pytest.mark.parametrize("calls, windows", [(9, 9), (9, 1), (2, 9), (0, 0)])
def test_budgets_are_kept(spark, calls, windows):
    """Two parts of one question and one of another; what one part uses is missing to the next."""
    parts = [(1, 1, 0, False, 1, "general_fact", "red apple tree", calls, windows), (1, 2, 1, True, 1, "general_fact", "blue stone wall", calls, windows), (2, 3, 0, False, 1, "ending_fate", "green river", calls, windows), (3, 4, 0, True, 9, "general_fact", None, calls, windows)]
    texts = {1: ("red apple", "a red apple tree"), 2: ("", ""), 3: ("blue", "blue stone wall"), 20: ("stone wall", "a blue wall"), 30: ("", "green river"), 31: (None, None)}
    chapters = spark.createDataFrame([(1, c, s, t) for c, (s, t) in texts.items()], "book_id bigint, chapter_index bigint, chapter_summary string, content string")
    hits = [(1, "plots", 1, 0.5), (1, "plots", 2, 0.1), (2, "plots", 3, 0.2), (2, "plots", 20, 0.4), (3, "plots", 30, 0.3)]
    got = rounds.research_rounds(spark.createDataFrame(parts, PARTS), spark.createDataFrame(hits, "part_id bigint, source string, chapter_index bigint, score double"), chapters, STOPWORDS)
    names = [x.split(" ")[0] for x in PARTS.split(", ")]
    rows = [dict(zip(names, p)) for p in parts]
    words = {p[1]: terms(p[6]) for p in parts}
    share = lambda part, c: texts.get(c) and tuple(sum(w in (t or "") for w in words[part]) / max(1, len(words[part])) for t in texts[c])
    want = by_hand(rows, hits, share)
    assert rows_of(got) == want
    if calls == windows == 9:
        assert [want[p][:2] for p in (1, 2, 3, 4)] == [("resolved", "resolved"), ("unresolved", "no_new_coordinates"), ("resolved", "resolved"), ("unresolved", "no_candidates")]


def test_no_parts(spark):
    nothing = lambda schema: spark.createDataFrame([], schema)
    found = rounds.research_rounds(nothing(PARTS), nothing("part_id bigint, source string, chapter_index bigint, score double"), nothing("book_id bigint, chapter_index bigint, chapter_summary string, content string"), STOPWORDS)
    assert found.where(F.lit(True)).count() == 0
