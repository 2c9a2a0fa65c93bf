"""The table under test with the figures its rules share."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import PERIOD_MAX_DISTINCT, rule_config
from tablevitals.functions.columns import ROW_INDEX, col, text_columns
from tablevitals.operators import roles
from tablevitals.operators.profile import is_measured, stats_table, value_counts


@dataclass
class Batch:
    """A DataFrame, its row key and the rule parameters.

    ``row_key`` names a unique column; findings refer to rows by it. Left out,
    it is the position column added by ``with_row_index``. ``columns`` are the
    columns judged, by default all but the position.
    """

    df: DataFrame
    row_key: str = ROW_INDEX
    columns: list[str] | None = None
    config: dict | None = None
    group_by: str | None = None
    period_by: str | None = None
    id_columns: list[str] | None = None  # not measures; guessed by name where not given
    _persisted: list[DataFrame] = field(default_factory=list, repr=False)

    def __post_init__(self):
        self.config = rule_config(self.config)
        if self.columns is None:
            self.columns = [c for c in self.df.columns if c != ROW_INDEX]

    def params(self, rule: str) -> dict:
        return self.config[rule]

    def enabled(self, rule: str) -> bool:
        return self.config[rule].get("enabled", True)

    @property
    def key(self) -> Column:
        return col(self.row_key)

    @cached_property
    def stats(self):
        """The stats pass: one aggregate row on the driver."""
        return self._stats_plan.first()

    @cached_property
    def _stats_plan(self) -> DataFrame:
        return stats_table(self.df, self.columns)

    def stats_table(self) -> DataFrame:
        """The stats row as a table, without scanning again once it is known."""
        if "stats" not in self.__dict__:
            return self._stats_plan
        return self.df.sparkSession.createDataFrame([self.stats], self._stats_plan.schema)

    @property
    def rows(self) -> int:
        return self.stats["n"]

    def stat(self, figure: str, column: str):
        return self.stats[f"{figure}_{self.columns.index(column)}"]

    @cached_property
    def counted_columns(self) -> list[str]:
        """Columns whose values are counted: all profiled as text, and period candidates."""
        periods = roles.period_like_columns(self.df, self.columns)
        return [c for c in self.columns if c in periods or not is_measured(self.df.schema[c].dataType)]

    @cached_property
    def value_stats(self) -> dict[str, tuple[int, int]]:
        """The value-count pass: distinct and rare values per column.

        The counts themselves are not kept; a free-text column has about as
        many as rows.
        """
        rare = self.params("consistency").get("min_value_count", 2)
        figures = (
            value_counts(self.df, self.counted_columns)
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("value_count") < rare).alias("rare"))
        )
        return {r["column"]: (r["distinct"], r["rare"]) for r in figures.collect()}

    @property
    def distinct(self) -> dict[str, int]:
        return {c: n for c, (n, _) in self.value_stats.items()}

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` kept (memory, then disk) until ``release``."""
        df = df.persist()
        self._persisted.append(df)
        return df

    @property
    def texts(self) -> list[str]:
        return text_columns(self.df, self.columns)

    @cached_property
    def period_column(self) -> str | None:
        return self.period_by or roles.guess_period_column(
            self.df, self.columns, self.distinct, self.params("completeness").get("period_max_distinct", PERIOD_MAX_DISTINCT)
        )

    @cached_property
    def entity_column(self) -> str | None:
        if self.group_by:
            return self.group_by
        exclude = roles.period_like_columns(self.df, self.columns)
        return roles.guess_entity_column(self.df, self.columns, exclude, self.distinct, self.rows)

    @cached_property
    def notes(self) -> list[tuple[str, str]]:
        """``(column, note)`` for what the rules left out: period columns with many values, candidates beyond a caller's limit."""
        found = []
        most = self.params("completeness").get("period_max_distinct", PERIOD_MAX_DISTINCT)
        if self.enabled("completeness") and not self.period_by:
            found += [(c, period_note(n, most)) for c, n in roles.unjudged_periods(self.df, self.columns, self.distinct, most).items()]
        limit = self.params("consistency").get("max_common_candidates")
        if self.enabled("consistency") and limit is not None:
            frequent = {c: n - rare for c, (n, rare) in self.value_stats.items() if c in self.texts}
            found += [(c, candidate_note(n, limit)) for c, n in frequent.items() if n > limit]
        return found

    def release(self) -> None:
        for df in self._persisted:
            df.unpersist()
        self._persisted.clear()


def period_note(values: int, most: int) -> str:
    return f"not judged for absent entities: {values} periods, more than {most}"


def candidate_note(values: int, limit: int) -> str:
    return f"{values} frequent values, of which the {limit} most frequent were candidates"


def literal_map(values: dict[str, object], key: Column) -> Column:
    """A lookup in a small driver-side dict as a CASE expression."""
    expression = F.lit(None)
    chain = None
    for k, v in values.items():
        chain = F.when(key == k, F.lit(v)) if chain is None else chain.when(key == k, F.lit(v))
    return expression if chain is None else chain
