"""Per-namespace settings from exact and wildcard rules.

The setting ``key`` of namespace ``ns`` is looked up under the name
``ns + key``: an exact rule wins, then the wildcard rule with the longest
prefix, then the longest suffix. Prefix and suffix may not overlap. A rule
without a value means the default.

A wildcard rule is its prefix, ``*`` and its suffix. For the lengths of these
two that occur among the rules, a name's only candidate is its own start, ``*``
and its own end, so every candidate is found by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A policy is configuration: it is read to the driver, and more rules than this are refused.
MOST_RULES = 100_000


def as_flag(value: Column) -> Column:
    """Only ``true`` in any case is true."""
    return F.lower(value) == "true"


def _shapes(rules: list) -> list[tuple[int, int]]:
    """Lengths of prefix and suffix that occur, the first to be tried first."""
    return sorted({(len(r.prefix), len(r.suffix)) for r in rules if r.prefix is not None}, key=lambda s: (-s[0], -s[1]))


def _candidate(name: Column, prefix: int, suffix: int) -> Column:
    """The wildcard rule of that shape which fits ``name``; null where the name is too short."""
    length = F.length(name)
    text = F.concat(F.substring(name, 1, prefix), F.lit("*"), F.substring(name, length - suffix + 1, F.lit(suffix)))
    return F.when(length >= prefix + suffix, text)


def _rules(policy: DataFrame) -> list:
    rules = policy.limit(MOST_RULES + 1).collect()
    if len(rules) > MOST_RULES:
        raise ValueError(f"a policy has at most {MOST_RULES} rules")
    return rules


def resolve_policy(namespaces: DataFrame, policy: DataFrame, key: str, default: str) -> DataFrame:
    """One row per distinct ``namespace``: its ``value`` and the ``rule`` it comes from.

    A name brings one candidate per shape to an equality join with the rules.
    Runs a job while the plan is built: the shapes of the rules are collected.
    """
    names = namespaces.select("namespace").filter("namespace is not null").distinct()
    name = F.concat("namespace", F.lit(key))
    shapes = _shapes(policy.filter("prefix is not null").select("prefix", "suffix").distinct().limit(MOST_RULES).collect())
    tried = F.array(name, *[_candidate(name, p, s) for p, s in shapes])
    candidates = names.select("namespace", F.posexplode(tried).alias("rank", "rule"))
    # An exact rule has no prefix, so a name that holds a star meets no wildcard rule by its own text.
    known = policy.select("rule", "value", F.col("prefix").isNull().alias("exact"))
    found = candidates.join(known, "rule").filter((F.col("rank") == 0) == F.col("exact"))
    best = found.groupBy("namespace").agg(F.min_by(F.struct("rule", "value"), "rank").alias("best"))
    return names.join(best, "namespace", "left").select(
        "namespace",
        F.lit(key).alias("setting"),
        F.coalesce("best.value", F.lit(default)).alias("value"),
        F.col("best.rule").alias("rule"),
    )


def setting_flag(namespace: Column, rules: list, key: str, default: str) -> Column:
    """The flag ``key`` of a namespace: set lookups of its candidates, in order of precedence."""
    fallback = default.lower() == "true"
    name = F.concat(namespace, F.lit(key))
    # The rules of each shape (None: exact) by flag; those that cannot name this setting are left out.
    by_shape: dict[tuple[int, int] | None, dict[bool, list[str]]] = {}
    for r in rules:
        fits = r.rule.endswith(key) if r.prefix is None else key.endswith(r.suffix) or r.suffix.endswith(key)
        if fits:
            shape = None if r.prefix is None else (len(r.prefix), len(r.suffix))
            flag = fallback if r.value is None else r.value.lower() == "true"
            by_shape.setdefault(shape, {}).setdefault(flag, []).append(r.rule)
    out = F.when(namespace.isNull(), fallback)
    for shape in sorted(by_shape, key=lambda s: (0, 0, 0) if s is None else (1, -s[0], -s[1])):
        candidate = name if shape is None else _candidate(name, *shape)
        for flag, texts in by_shape[shape].items():
            out = out.when(candidate.isin(texts), flag)
    return out.otherwise(fallback)


def attach_settings(df: DataFrame, policy: DataFrame, settings: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one boolean column per ``{column: (key, default)}``, resolved by ``namespace``.

    One expression for a policy of any size, on a table or a stream: no join
    and no shuffle. Runs a job while the plan is built: the rules are collected.
    """
    rules = _rules(policy)
    flags = {col: setting_flag(F.col("namespace"), rules, key, default) for col, (key, default) in settings.items()}
    return df.withColumns(flags)
