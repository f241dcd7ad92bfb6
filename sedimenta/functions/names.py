"""Names: commits, stable ids, fingerprints, entities, words (Column in, Column out)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT_TYPES = ("feat", "fix", "refactor", "docs", "test", "chore", "style", "perf", "ci", "build")
VERBS = ("get_", "post_", "put_", "delete_", "patch_", "head_")


def chain(pairs: list[tuple[Column, Column | str | None]], otherwise: Column | str | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def commit_type(message: Column) -> Column:
    """Conventional type: what stands before the first colon begins with; null without a colon or a known type."""
    head = F.lower(F.trim(F.substring_index(F.trim(message), ":", 1)))
    known = chain([(head.startswith(t), t) for t in COMMIT_TYPES])
    return F.when(message.contains(":"), known)


def tags_of(refs: Column) -> Column:
    """Tag names of a list of refs such as `HEAD -> main, tag: v1`."""
    parts = F.transform(F.split(F.coalesce(refs, F.lit("")), ","), lambda x: F.trim(x))
    return F.transform(F.filter(parts, lambda x: x.startswith("tag: ")), lambda x: F.substring(x, 6, 10_000))


def parent_of(parents: Column, last: bool = False) -> Column:
    """First (or last) of a blank-separated list of parents; null where there is none."""
    parts = F.filter(F.split(F.coalesce(parents, F.lit("")), " "), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1 if last else 1))


def module_of(stable_id: Column) -> Column:
    """The file part of `file::function`."""
    return F.when(stable_id.contains("::"), F.substring_index(stable_id, "::", 1)).otherwise(F.lit(""))


def class_of(stable_id: Column) -> Column:
    """The class of `file::Class.method`, else the file's stem, else the id itself."""
    tail = F.substring_index(stable_id, "::", -1)
    stem = F.regexp_extract(F.substring_index(module_of(stable_id), "/", -1), r"^([^.]*)", 1)
    return chain([(tail.contains("."), F.regexp_extract(tail, r"^(.*)\.[^.]*$", 1)), (stem != "", stem)], tail)


def tree_fingerprint(names: Column) -> Column:
    """Distinct lower-case last parts of qualified names."""
    return F.array_sort(F.array_distinct(F.transform(names, lambda x: F.lower(F.element_at(F.split(x, r"::|\."), -1)))))


def content_fingerprint(content: Column) -> Column:
    """Lower-case tokens, underscores opened, numbers left out."""
    tokens = F.split(F.lower(F.translate(content, "_", " ")), r"\s+")
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.rlike("^[0-9]+$")), " ")


def jaccard(a: Column, b: Column) -> Column:
    """|a n b| / |a u b| of arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; no composition of built-in functions gives it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def entry_signature(kind: Column, name: Column, file: Column) -> Column:
    """What identifies an entry point: the lower-case name, the name, or file and name."""
    return chain([(kind == "http", F.lower(name)), (kind == "cli", name)], F.concat_ws(":", file, name))


def name_words(name: Column) -> Column:
    """Distinct lower-case words of a camel-case or snake-case name."""
    found = F.regexp_extract_all(F.translate(name, "_", " "), F.lit("([A-Z]?[a-z0-9]+)"), 1)
    words = F.array_distinct(F.transform(found, F.lower))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lower(name)))


FAMILIES = {
    "service": "svc", "repository": "repo", "controller": "ctrl", "manager": "mgr", "configuration": "config",
    "request": "req", "response": "resp", "message": "msg", "metadata": "meta", "application": "app",
}


def _stem(name: Column, family: tuple[str, str]) -> Column:
    """The name without the family's suffix, longest spelling first; itself where it has none."""
    spellings = sorted(family, key=len, reverse=True)
    out = name
    for s in reversed(spellings):
        title = s[0].upper() + s[1:]
        out = F.when(name.endswith(f"_{s}"), F.substring(name, F.lit(1), F.length(name) - len(s) - 1)).when(
            name.endswith(title) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))
        ).otherwise(out)
    return out


def _word_score(a: Column, b: Column) -> Column:
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    score = jaccard(a, b)
    return F.when(inside, F.greatest(score, F.lit(0.7))).otherwise(score)


def entity_similarity(a: Column, b: Column) -> Column:
    """Word overlap; 0.7 at least where one name's words hold the other's; 0.85 for equal stems of one suffix
    family, 0.75 where a stem lies within the other name."""
    score = _word_score(name_words(a), name_words(b))
    for long, short in FAMILIES.items():
        x, y = _stem(a, (long, short)), _stem(b, (long, short))
        both = (x != a) & (y != b) & (F.lower(x) == F.lower(y))
        one = ((x != a) & F.lower(b).contains(F.lower(x))) | ((y != b) & F.lower(a).contains(F.lower(y)))
        score = F.greatest(score, F.when(both, F.lit(0.85)).when(one, F.lit(0.75)).otherwise(F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(score)


def normalised_similarity(a: Column, b: Column) -> Column:
    """Word overlap with long suffix words shortened first (the first five families)."""
    short = F.create_map(*[F.lit(x) for k, v in list(FAMILIES.items())[:5] for x in (k, v)])

    def words(name: Column) -> Column:
        found = F.regexp_extract_all(F.translate(name, "_", " "), F.lit("([A-Z]?[a-z0-9]+)"), 1)
        return F.array_distinct(F.transform(found, lambda w: F.coalesce(short[F.lower(w)], F.lower(w))))

    x, y = words(a), words(b)
    return chain([(a == b, F.lit(1.0)), ((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))], _word_score(x, y))


def relationship(a: Column, b: Column, score: Column) -> Column:
    low_a, low_b = F.lower(a), F.lower(b)
    return chain([((a == b) | (score >= 0.9), "same"), (low_a.contains(low_b) | low_b.contains(low_a), "subset")], "related")


def description(func: Column, file: Column) -> Column:
    """`Get user by id (user api)` from `get_user_by_id` in `user_api.py`."""
    stem = F.regexp_extract(F.substring_index(file, "/", -1), r"^([^.]*)", 1)
    words = F.lower(F.translate(F.trim(F.translate(func, "_", " ")), "_", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000), F.lit(" ("), F.translate(stem, "_", " "), F.lit(")"))


CAPABILITIES = {"store": "storage", "repository": "storage", "service": "business service", "controller": "interface", "api": "interface", "client": "integration", "engine": "engine", "parser": "parsing", "manager": "management"}


def capability_label(name: Column) -> Column:
    return chain([(F.lower(name).contains(k), v) for k, v in CAPABILITIES.items()], name)
