"""Contracts of tables: what a reader may rely on, checked in one aggregation, or used to route bad rows aside.

A contract names columns with their types, whether they may be null, whether they are finite, and their bounds; and for a table in order, that no two rows of a key share a time and that times lie on a grid without gaps. Columns beyond the
contract pass through. All problems are found at once. The row before each is found in two levels (plans.blocks.previous), so a long series is no one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import previous


class ContractError(ValueError):
    """A table breaks its contract; the message lists every problem."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str | None = None
    nullable: bool = True
    finite: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple | None = None

    def __post_init__(self):
        if not self.name:
            raise ValueError("a column needs a name")
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValueError(f"{self.name}: low {self.low} is above high {self.high}")

    def rules(self, type_: str) -> dict[str, SparkColumn]:
        """By rule, whether a row breaks it; never null."""
        x = F.col(f"`{self.name}`")
        number = type_ in ("double", "float")
        broken = {}
        if not self.nullable:
            broken["null"] = x.isNull()
        if number and self.finite:
            broken["not finite"] = F.isnan(x) | (F.abs(x) == float("inf"))
        # what is no number lies in no bounds, and is told once
        known = ~F.isnan(x) if number else F.lit(True)
        if self.low is not None:
            broken["below"] = known & (x < self.low)
        if self.high is not None:
            broken["above"] = known & (x > self.high)
        if self.values is not None:
            broken["not listed"] = ~x.isin(*self.values)
        return {rule: F.coalesce(b, F.lit(False)) for rule, b in broken.items()}


@dataclass(frozen=True)
class Contract:
    """key and time: rows of a key have different times (a column of timestamps without zone). step: seconds between them, counted from 1970, without gaps."""

    name: str
    columns: tuple[Column, ...] = ()
    key: str | None = None
    time: str | None = None
    step: int | None = None
    bucket_steps: int = 10_000

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: a column is named twice")
        if (self.time is None) != (self.key is None) or (self.step is not None and self.time is None):
            raise ValueError(f"{self.name}: a grid needs a key and a time")

    def extend(self, name: str, *more: Column) -> Contract:
        return Contract(name, (*self.columns, *more), self.key, self.time, self.step, self.bucket_steps)

    def structure(self, df: DataFrame) -> list[tuple[str, str]]:
        """Missing columns and wrong types, from the schema alone."""
        have = dict(df.dtypes)
        wanted = [*self.columns, *[Column(c) for c in (self.key, self.time) if c and c not in {x.name for x in self.columns}]]
        missing = [(c.name, "missing") for c in wanted if c.name not in have]
        return missing + [(c.name, f"is {have[c.name]}, not {c.type}") for c in wanted if c.name in have and c.type and have[c.name] != c.type]

    def _marked(self, df: DataFrame) -> tuple[DataFrame, dict[tuple[str, str], SparkColumn]]:
        """df with what the rules need, and by column and rule whether a row breaks it."""
        types = dict(df.dtypes)
        broken = {(c.name, rule): b for c in self.columns if c.name in types for rule, b in c.rules(types[c.name]).items()}
        if self.time and self.time in types and self.key in types:
            micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{self.time}`)")
            step = (self.step or 3600) * 1_000_000
            df = df.withColumns({"_at": micros, "_turn": F.struct(micros.alias("at"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("tie"))})
            df = previous(df, "_before", F.col("_at"), self.key, F.floor(F.col("_at") / (step * self.bucket_steps)), "_turn")
            at, before = F.col("_at"), F.col("_before")
            broken[self.time, "repeated"] = F.coalesce(at == before, F.lit(False))
            if self.step is not None:
                broken[self.time, "off grid"] = F.coalesce(at % step != 0, F.lit(True))
                broken[self.time, "after a gap"] = F.coalesce(at - before > step, F.lit(False))
        return df, broken

    def check(self, df: DataFrame) -> DataFrame:
        """column, rule and n, the rows that break it, for every rule of the data; one aggregation. Columns that are missing have none."""
        marked, broken = self._marked(df)
        if not broken:
            return df.sparkSession.createDataFrame([], "column string, rule string, n long")
        counts = marked.agg(*[F.count_if(b).alias(f"_{i}") for i, b in enumerate(broken.values())])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"_{i}").alias("n")) for i, (c, rule) in enumerate(broken)])
        return counts.select(F.explode(cells).alias("c")).select("c.*")

    def require(self, df: DataFrame, data: bool = True) -> DataFrame:
        """df, or a ContractError with all problems of its structure and, with data, of its rows."""
        problems = [f"{c}: {what}" for c, what in self.structure(df)]
        if data:
            problems += [f"{r['column']}: {r.n} rows {r.rule}" for r in self.check(df).filter("n > 0").orderBy("column", "rule").collect()]
        if problems:
            raise ContractError(f"{self.name}: " + "; ".join(problems))
        return df

    def route(self, df: DataFrame, ignore: tuple[str, ...] = ("after a gap",)) -> tuple[DataFrame, DataFrame]:
        """The rows that keep the contract, and the others with broken, the list of `column: rule`. Rules to ignore are told by check() only; a wrong structure is a ContractError."""
        self.require(df, data=False)
        marked, broken = self._marked(df)
        told = F.array_compact(F.array(*[F.when(b, F.lit(f"{c}: {rule}")) for (c, rule), b in broken.items() if rule not in ignore]).cast("array<string>"))
        marked = marked.select(*[F.col(f"`{c}`") for c in df.columns], told.alias("broken"))
        return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)
