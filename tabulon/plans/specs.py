"""Declarative query specifications that a user can store as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from tabulon.errors import InvalidRequest

# Operator and aggregate names, and the largest page each entry point returns.
FILTER_OPS = (
    "eq", "ne", "contains", "not_contains", "gt", "gte", "lt", "lte",
    "between", "is_null", "not_null", "in_list",
)
PLAN_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in")
AGGREGATES = ("sum", "mean", "min", "max", "count", "n_unique")
EXPLORE_LIMIT = 2000
PLAN_LIMIT = 200


@dataclass(frozen=True)
class FilterSpec:
    column: str
    op: str = "eq"
    value: Any = None

    @staticmethod
    def of(spec: FilterSpec | dict) -> FilterSpec:
        if isinstance(spec, FilterSpec):
            return spec
        return FilterSpec(spec.get("column") or "", (spec.get("op") or "eq").lower(), spec.get("value"))


@dataclass(frozen=True)
class AggSpec:
    column: str
    agg: str = "sum"
    alias: str | None = None

    @staticmethod
    def of(spec: AggSpec | dict) -> AggSpec:
        if isinstance(spec, AggSpec):
            return spec
        return AggSpec(spec.get("column") or "", (spec.get("agg") or "sum").lower(), spec.get("alias"))


@dataclass
class QuerySpec:
    """Filters, then a grouping or a column choice, then sort, offset and limit."""

    mode: str = "raw"
    filters: list[FilterSpec] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregations: list[AggSpec] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    sort_by: str | None = None
    sort_dir: str = "asc"
    limit: int | None = None
    offset: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("raw", "grouped"):
            raise InvalidRequest("mode must be raw or grouped")
        self.filters = [FilterSpec.of(f) for f in self.filters]
        self.aggregations = [AggSpec.of(a) for a in self.aggregations]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> QuerySpec:
        return QuerySpec(**json.loads(text))


@dataclass
class Plan:
    """The stricter form a question is turned into: fewer operators, at most 200 rows."""

    filters: list[FilterSpec] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregations: list[AggSpec] = field(default_factory=list)
    columns: list[str] | None = None
    sort_by: str | None = None
    sort_dir: str = "desc"
    limit: int = 50
    explanation: str | None = None

    def __post_init__(self) -> None:
        self.filters = [FilterSpec.of(f) for f in self.filters]
        self.aggregations = [AggSpec.of(a) for a in self.aggregations]
        for spec in self.filters:
            if spec.op not in PLAN_OPS:
                raise InvalidRequest(f"unsupported filter op: {spec.op}")
        for spec in self.aggregations:
            if spec.agg not in AGGREGATES:
                raise InvalidRequest(f"unsupported aggregation: {spec.agg}")
        if not 1 <= self.limit <= PLAN_LIMIT:
            raise InvalidRequest(f"limit must lie between 1 and {PLAN_LIMIT}")

    @staticmethod
    def of(plan: Plan | dict | str) -> Plan:
        if isinstance(plan, Plan):
            return plan
        return Plan(**(json.loads(plan) if isinstance(plan, str) else plan))
