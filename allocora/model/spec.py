"""Model description and its design columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelSpec:
    """Outcome, numeric terms, categorical terms with their reference level, products.

    A reference of None stands for the lowest level found. ``products`` are pairs
    of numeric columns that enter as ``a:b``.
    """

    outcome: str
    numeric: tuple[str, ...]
    categorical: tuple[tuple[str, object], ...] = ()
    products: tuple[tuple[str, str], ...] = ()
    cluster: str = "unit"

    @property
    def numeric_terms(self) -> tuple[str, ...]:
        return self.numeric + tuple(f"{a}:{b}" for a, b in self.products)

    def term_column(self, term: str) -> Column:
        for a, b in self.products:
            if term == f"{a}:{b}":
                return (F.col(a) * F.col(b)).cast("double")
        return F.col(term).cast("double")

    @property
    def inputs(self) -> list[str]:
        used = [self.outcome, *self.numeric, *[c for c, _ in self.categorical]]
        for pair in self.products:
            used += pair
        return list(dict.fromkeys(used))

    def complete(self, df: DataFrame) -> DataFrame:
        return df.na.drop(subset=self.inputs)


def dummy_name(column: str, level: object) -> str:
    return f"{column}[{level}]"


@dataclass(frozen=True)
class Design:
    """A spec with the levels found in the data and the centres of its numeric terms."""

    spec: ModelSpec
    levels: Mapping[str, Sequence[object]]
    centres: Mapping[str, float]
    outcome_centre: float
    references: Mapping[str, object] = field(default_factory=dict)

    @property
    def dummies(self) -> list[tuple[str, object]]:
        return [
            (c, level)
            for c, _ in self.spec.categorical
            for level in self.levels[c]
            if level != self.references[c]
        ]

    @property
    def terms(self) -> list[str]:
        return ["Intercept", *self.spec.numeric_terms, *[dummy_name(c, v) for c, v in self.dummies]]

    def centred(self, term: str) -> Column:
        return self.spec.term_column(term) - F.lit(self.centres[term])

    def linear(self, coefficients: Mapping[str, float] | Mapping[str, Column]) -> Column:
        """Σ coefficient × design column on the original scale, as one expression.

        A categorical term becomes one branch expression, not a sum over dummies.
        """

        def as_lit(v):
            return v if isinstance(v, Column) else F.lit(float(v))

        total = as_lit(coefficients["Intercept"])
        for term in self.spec.numeric_terms:
            if term in coefficients:
                total = total + as_lit(coefficients[term]) * self.spec.term_column(term)
        for column, _ in self.spec.categorical:
            effect = None
            for level in self.levels[column]:
                name = dummy_name(column, level)
                value = as_lit(coefficients.get(name, 0.0))
                test = F.col(column) == F.lit(level)
                effect = F.when(test, value) if effect is None else effect.when(test, value)
            total = total + effect
        return total
