"""One front for the ways to certain answers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from certus.functions.storage import within
from certus.operators import certain, denial, ranges, search
from certus.plans.analyze import analyze
from certus.plans.query import Database, Query


class Engine:
    """Answers queries over a database that violates its keys."""

    def __init__(self, db: Database):
        self.db = db

    def analyze(self, q: Query) -> dict:
        return analyze(self.db, q)

    def possible(self, q: Query) -> DataFrame:
        return certain.possible(self.db, q)

    def certain(self, *queries: Query, strategy: str = "auto") -> DataFrame:
        """Certain answers; strategy: auto, clean (sound only), division, blocks or search."""
        if len(queries) > 1:
            return search.by_search(self.db, *queries)
        if strategy == "auto":  # blocks for forests, division for other first-order queries, search
            strategy = analyze(self.db, queries[0])["strategy"]
        ways = {"clean": certain.from_clean_part, "division": certain.by_division, "blocks": certain.by_blocks, "search": search.by_search}
        return ways[strategy](self.db, queries[0])

    def suspect(self, q: Query) -> DataFrame:
        """Possible answers that aren't certain."""
        return certain.suspect(self.db, q, self.certain(q))

    def ranges(self, q: Query, value: str, function: str | None = None) -> DataFrame:
        """Ranges of a variable; AVG and DISTINCT raise ranges.UnsupportedAggregate."""
        return ranges.ranges(self.db, q, value, function)

    def within(self, answers: DataFrame, seconds: float) -> DataFrame:
        """Answers computed in that time, or a TimeoutError."""
        return within(answers, seconds)

    def certain_values(self, table: str, columns: list[str]) -> DataFrame:
        """Certain values under the database's denial constraints."""
        return denial.certain_values(self.db, table, columns)

    def certain_answers_under_denials(self, *queries: Query) -> DataFrame:
        """Certain answers of a query, or of a union, under the database's denial constraints."""
        return denial.certain_answers(self.db, *queries)
