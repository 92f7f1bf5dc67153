"""What to do with a question before anything is retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import text


def question_router(questions: DataFrame, question: str = "question", has_history: str | None = None) -> DataFrame:
    """Add route: smalltalk, library_wide, follow_up (to be resolved) or ranked; and what fired."""
    q = F.col(question)
    later = F.col(has_history) if has_history else F.lit(False)
    kind = text.smalltalk_kind(q)
    route = (
        F.when(kind.isNotNull(), "smalltalk")
        .when(later & ~text.looks_self_contained(q), "follow_up")
        .when(text.is_library_wide(q), "library_wide")
        .otherwise("ranked")
    )
    return (
        questions.withColumn("smalltalk", kind)
        .withColumn("matched", text.matched_pattern(q))
        .withColumn("route", route)
    )


def rule_plan(question: Column, attempt: Column, allowed: Column, web_pending: Column) -> Column:
    """Tools chosen by rule, kept to what the composition allows."""
    def permitted(preferred: list[str]) -> Column:
        kept = F.array_intersect(F.array(*[F.lit(p) for p in preferred]), allowed)
        searches = F.slice(F.filter(allowed, lambda t: t.endswith("_search")), 1, 2)
        return (
            F.when(F.size(kept) > 0, kept)
            .when(F.size(searches) > 0, searches)
            .otherwise(F.slice(allowed, 1, 1))
        )

    web = F.array_contains(allowed, "web_search") & web_pending
    return (
        F.when(text.is_library_wide(question), permitted(["aggregate_search"]))
        .when((attempt > 0) & web, permitted(["web_search", "hybrid_search"]))
        .when(attempt > 0, permitted(["hybrid_search", "keyword_search"]))
        .otherwise(permitted(["hybrid_search", "hierarchical_search"]))
    )
