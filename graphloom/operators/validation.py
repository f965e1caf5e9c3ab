"""Constraint checks of artifacts: every violation as a row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    """What a column must satisfy."""

    column: str
    required: bool = False
    pattern: str | None = None
    one_of: list[str] = field(default_factory=list)
    at_least: float | None = None
    at_most: float | None = None

    def problems(self) -> list[tuple[str, Column]]:
        c = F.col(self.column)
        out = []
        if self.required:
            out.append(("required", c.isNull()))
        if self.pattern is not None:
            out.append(("pattern", ~c.rlike(self.pattern)))
        if self.one_of:
            out.append(("enum", ~c.isin(self.one_of)))
        if self.at_least is not None:
            out.append(("minimum", c < self.at_least))
        if self.at_most is not None:
            out.append(("maximum", c > self.at_most))
        return [(name, F.coalesce(bad, F.lit(False))) for name, bad in out]


# Rules of the stored tables.
SCHEMAS: dict[str, list[Rule]] = {
    "scan": [Rule("path", True, "^.+$"), Rule("size", True, at_least=0), Rule("hash", True, "^[0-9a-f]{64}$"), Rule("kind", True, one_of=["code", "config", "doc", "asset", "test", "schema", "unknown"])],
    "nodes": [Rule("id", True, "^(file|symbol|folder|package|external-symbol|domain|layer|endpoint|flow|step|concept):.+$"), Rule("type", True), Rule("label", True)],
    "edges": [Rule("src", True), Rule("dst", True), Rule("type", True), Rule("weight", at_least=0)],
    "subset": [Rule("change_id", True, "^[a-zA-Z0-9._-]+$"), Rule("n_nodes", True, at_least=0), Rule("n_edges", True, at_least=0), Rule("depth", True, at_least=0), Rule("mode", one_of=["compact", "full"])],
    "ledger": [Rule("baseline", True, at_least=0), Rule("packed", True, at_least=0), Rule("baseline_files", at_least=0), Rule("packed_files", at_least=0), *(Rule(f"n_{m}", at_least=0) for m in ("full", "excerpt", "summary"))],
    "plan": [Rule("task", True, at_least=1), Rule("path", True, "^.+$"), Rule("max_loc", True, at_least=1), Rule("max_files", at_least=1), Rule("status", one_of=["plan_only", "approved_for_edit", "rejected", "completed"])],
    "manifest": [Rule("path", True), Rule("name", True), Rule("reason", True), Rule("match_type", one_of=["domain", "alwaysApply", "explicit"])],
    "spec": [Rule("change_id", True, "^[a-z0-9][a-z0-9-]*$"), Rule("path", True, "^.+$"), Rule("reason", True), Rule("mode", True, one_of=["full", "excerpt", "summary"]), Rule("domain", True, "^.+$")],
    "pack": [Rule("path", True), Rule("mode", True, one_of=["full", "excerpt", "summary"]), Rule("reason", True, one_of=["seed", "direct_import", "transitive_dep", "test_for", "referenced_symbol", "called_by_seed", "manual"])],
}


def violations(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, column, problem): all that breaks a rule, in one pass."""
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(r.column).alias("column"), F.lit(name).alias("problem"))) for r in rules for name, bad in r.problems())))
    return df.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("key", "v.column", "v.problem")


def validate_or_raise(df: DataFrame, schema: str, key: str) -> None:
    """Raise with the first problems of a table that breaks its schema."""
    bad = violations(df, SCHEMAS[schema], key).limit(20).collect()
    if bad:
        raise ValueError(f"{schema}: " + "; ".join(f"{r['key']}.{r['column']} {r['problem']}" for r in bad))
