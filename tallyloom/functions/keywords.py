"""Keyword rules over text: categories, scores and counts.  Rules are small config tables and
enter the plan as literal expressions, so classifying never joins or shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import first_per


def any_of(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w.lower()))
    return hit


def keyword_count(text: Column, words: list[str]) -> Column:
    """Number of distinct keywords present (case-insensitive substring)."""
    low, n = F.lower(text), F.lit(0)
    for w in dict.fromkeys(words):
        n = n + F.contains(low, F.lit(w.lower())).cast("int")
    return n


def first_category(text: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """First rule, in order, with any keyword in the text."""
    low, out = F.lower(text), None
    for name, words in rules:
        c = any_of(low, words)
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(F.lit(default)) if default is not None else out


def best_keyword(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Rule with most keywords present; the first wins ties; null when none is present."""
    scored = F.array(*[F.struct(keyword_count(text, ws).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("id"))
                       for i, (n, ws) in enumerate(rules)])
    best = F.array_max(scored)
    return F.when(best["s"] > 0, best["id"])


# Calendar categories, non-declarable ones first, with keywords and calendar names.
NON_DECLARABLE = [
    ("personal_appointments", ["dentist", "doctor", "medical", "appointment", "checkup", "consultation", "therapy", "physio"],
     ["personal", "health", "medical"], "personal"),
    ("family_commitments", ["family", "personal", "home", "childcare", "school", "parent", "family time", "vacation"],
     ["family", "personal", "home"], "personal"),
    ("travel_time", ["travel", "commute", "transport", "driving", "flight", "train", "bus", "transit"],
     ["travel", "commute"], "travel"),
    ("breaks_meals", ["lunch", "dinner", "breakfast", "break", "coffee", "tea", "rest", "meal"],
     ["breaks", "meals"], "break"),
    ("administrative", ["admin", "paperwork", "billing", "invoicing", "accounting", "hr", "general admin"],
     ["admin", "administrative"], "work"),
    ("social_events", ["party", "social", "recreation", "hobby", "sports", "exercise", "entertainment", "leisure"],
     ["social", "recreation", "hobbies"], "personal"),
]
DECLARABLE = [
    ("work_sessions", ["development", "coding", "programming", "implementation", "ai framework", "agent development",
                       "security", "privacy", "research", "investigation", "testing", "debugging", "documentation",
                       "technical writing", "architecture", "system design", "algorithm", "optimization"],
     ["work", "development", "research", "wbso", "ai", "tech"], 1.0),
    ("technical_meetings", ["technical review", "code review", "architecture review", "security review", "privacy review",
                            "system design", "technical discussion", "development planning"],
     ["work", "development", "tech meetings"], 0.8),
    ("research_learning", ["research", "learning", "study", "investigation", "technology evaluation",
                           "framework research", "security research", "privacy research"],
     ["research", "learning", "study"], 0.9),
]
DEFAULT_CATEGORY = "work_sessions"


def calendar_category(title: Column, description: Column, calendar: Column) -> Column:
    """struct(category, declarable, conflict_type): keywords are sought in all three texts,
    calendar names in the calendar only; non-declarable rules come first."""
    low, cal = F.lower(F.concat_ws(" ", title, description, calendar)), F.lower(calendar)
    out = None
    for rules, declarable in ((NON_DECLARABLE, False), (DECLARABLE, True)):
        for name, words, calendars, extra in rules:
            hit = any_of(low, words) | any_of(cal, calendars)
            val = F.struct(F.lit(name).alias("category"), F.lit(declarable).alias("declarable"),
                           F.lit(None if declarable else extra).cast("string").alias("conflict_type"))
            out = F.when(hit, val) if out is None else out.when(hit, val)
    return out.otherwise(F.struct(F.lit(DEFAULT_CATEGORY).alias("category"), F.lit(True).alias("declarable"),
                                  F.lit(None).cast("string").alias("conflict_type")))


# Repository description rules, in order; each inner list must all be matched by one word.
REPOSITORY_RULES = [
    ("AI_FRAMEWORK", [["ai"], ["agent", "framework"]]),
    ("ACCESS_CONTROL", [["auth", "access", "security"]]),
    ("PRIVACY_CLOUD", [["privacy", "cloud"]]),
    ("AUDIT_LOGGING", [["audit", "log"]]),
    ("DATA_INTEGRITY", [["data"], ["integrity", "corruption"]]),
    ("TESTING_FRAMEWORK", [["test", "testing"]]),
    ("DOCUMENTATION", [["doc", "readme"]]),
    ("PROJECT_SETUP", [["setup", "config"]]),
    ("SYSTEM_ARCHITECTURE", [["architect", "system"]]),
]


def repository_category(description: Column) -> Column:
    low, out = F.lower(description), None
    for name, groups in REPOSITORY_RULES:
        hit = F.lit(True)
        for words in groups:
            hit = hit & any_of(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("GENERAL_RD")


def session_category(sessions: DataFrame, sid: str, repositories: DataFrame, description: str, order: str) -> DataFrame:
    """The commonest repository category of each session (ties: earliest, then by name); UNKNOWN without a repository."""
    each = repositories.filter(F.col(description).isNotNull()).select(sid, F.col(order).alias("__o"), repository_category(F.col(description)).alias("category"))
    n = each.groupBy(sid, "category").agg(F.count("*").alias("n"), F.min("__o").alias("__o"))
    best = first_per(n, [sid], [F.desc("n"), "__o", "category"]).drop("__o")
    return sessions.join(best, sid, "left").withColumns({"category": F.coalesce("category", F.lit("UNKNOWN")), "n": F.coalesce("n", F.lit(0).cast("long"))})


def activity_score(activity: dict, repo_text: Column, commit_text: Column) -> Column:
    """Keyword hits on the description, on commit text (half weight per keyword) and the best
    sub-activity (half weight), divided by what could be reached.  Null commit text = no commits."""
    words = activity["keywords"]
    subs = [s["keywords"] for s in activity.get("sub_activities", []) if s["keywords"]]
    score, top = F.lit(0.0), F.lit(0.0)
    if words:
        score = score + F.least(keyword_count(repo_text, words) / len(words), F.lit(1.0))
        score = score + F.when(commit_text.isNotNull(), F.least(keyword_count(commit_text, words) / (2 * len(words)), F.lit(1.0))).otherwise(0.0)
        top = top + 1.0 + F.when(commit_text.isNotNull(), 1.0).otherwise(0.0)
    if subs:
        ratios = [F.least(keyword_count(repo_text, ws) / len(ws), F.lit(1.0)) for ws in subs]
        score = score + (F.greatest(*ratios) if len(ratios) > 1 else ratios[0]) * 0.5
        top = top + 0.5
    return F.when(top > 0, score / top).otherwise(0.0)
