"""Rules and how a set of them becomes one pass over a table.

A rule is a name, a level and a Spark SQL predicate over the columns of the
job's input. ``{p}`` in a predicate stands for the rule's parameter. A job
evaluates all its rules in one projection: every row yields an array of the
rules it breaks, which is exploded into violation rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix of the numbered names of the second catalogue.
NUMBER_PREFIX = "R"


def numbered(number: int, prefix: str | None = None) -> str:
    return f"{NUMBER_PREFIX if prefix is None else prefix}{number:05d}"


@dataclass(frozen=True)
class Rule:
    name: str
    level: str
    what: str
    predicate: str
    param: str | None = None
    enabled: bool = True

    def sql(self) -> str:
        return self.predicate.replace("{p}", self.param or "")

    def message(self) -> str:
        return self.what if self.param is None else f"{self.what} ({self.param})"


@dataclass(frozen=True)
class Setting:
    """What a template sets for a rule: level, parameter, on or off."""

    level: str | None = None
    param: str | None = None
    enabled: bool = True


def both(what: str, predicate: str, first=None, second=None) -> list[Rule]:
    """The rule under its name in the first catalogue and its number in the
    second: ``first=(name, level[, param])``, ``second=(number, level[, param])``."""
    made = []
    if first:
        made.append(Rule(first[0], first[1], what, predicate, *first[2:3]))
    if second:
        made.append(Rule(numbered(second[0]), second[1], what, predicate, *second[2:3]))
    return made


def configure(rules: Iterable[Rule], settings: dict[str, Setting] | None) -> list[Rule]:
    """Rules with a template's settings; rules it does not name are left out."""
    if settings is None:
        return list(rules)
    chosen = []
    for r in rules:
        s = settings.get(r.name)
        if s is not None and s.enabled:
            chosen.append(replace(r, level=s.level or r.level, param=s.param if s.param is not None else r.param))
    return chosen


def settings_from(gated: DataFrame) -> dict[str, Setting]:
    """Settings out of the rule gate's output: one row per rule of a template, as its author wrote them."""
    rows = gated.select("rule_name", "level", "params").collect()
    return {r["rule_name"]: Setting(r["level"], r["params"]) for r in rows}


VIOLATIONS = "array<struct<rule_name:string,level:string,message:string>>"


def broken(rules: Iterable[Rule]) -> Column:
    """Array of (rule_name, level, message) of the rules a row breaks.

    Rules that share a predicate are tested once.
    """
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.sql(), []).append(r)
    entry = lambda r: F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.level).alias("level"), F.lit(r.message()).alias("message"))
    if not groups:
        return F.array().cast(VIOLATIONS)
    cases = [F.when(F.expr(sql), F.array(*[entry(r) for r in same])) for sql, same in groups.items()]
    return F.flatten(F.array_compact(F.array(*cases)))


def violations(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """One row per broken rule: keys, rule_name, level, message, execution_failed."""
    found = df.select(*keys, F.explode(broken(rules)).alias("_v"))
    return found.select(*keys, "_v.rule_name", "_v.level", "_v.message", F.lit(False).alias("execution_failed"))


def violations_by(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """Violations of each key with at least one row that breaks the rule.

    One flag per predicate is or-ed map-side, so a task sends one narrow row
    per key, and the names are attached after the shuffle.
    """
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.sql(), []).append(r)
    flags = {f"_f{i}": (sql, same) for i, (sql, same) in enumerate(groups.items())}
    reduced = df.groupBy(key).agg(*[F.bool_or(F.expr(sql)).alias(name) for name, (sql, _) in flags.items()])
    named = [replace(r, predicate=name, param=None, what=r.message()) for name, (_, same) in flags.items() for r in same]
    return violations(reduced, named, key)


# Pieces of predicates.


def needed(pattern: str) -> str | None:
    """A word every match of the pattern must hold, if one is plain to see.

    Searching for a word is much cheaper than running a pattern, and most
    statements lack it.
    """
    runs, run, depth, i = [], "", 0, 0
    if pattern.startswith("(?"):
        return None
    while i < len(pattern):
        ch = pattern[i]
        after = pattern[i + 1 : i + 2]
        if depth == 0 and ch == "|":
            return None
        if ch == "[":
            i = pattern.index("]", i + 2)
            ch = ""
        elif ch == "\\":
            i += 1
            ch = ""
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if depth == 0 and ch and (ch.isupper() or ch == "_") and after not in ("?", "*", "{"):
            run += ch
        else:
            runs, run = [*runs, run], ""
        i += 1
    best = max([*runs, run], key=len)
    return best if len(best) >= 3 else None


def m(column: str, pattern: str) -> str:
    """The column matches."""
    test = f"regexp_like({column}, r'{pattern}')"
    word = needed(pattern)
    return f"(contains({column}, '{word}') AND {test})" if word else test


def n(column: str, pattern: str) -> str:
    """How often the column matches."""
    return f"regexp_count({column}, r'{pattern}')"
