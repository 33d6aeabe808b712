"""Text expressions: all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: White space at both ends, as a Unicode-aware trim.
_ENDS = r"(?U)^\s+|\s+$"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _ENDS, "")


def blank_to_null(col: Column) -> Column:
    """The stripped text, null if nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def tokens(col: Column) -> Column:
    """Search tokens with repeats: lower-case runs of two or more letters or digits, and
    the overlapping pairs of ideograph runs. Null gives none."""
    low = F.lower(F.coalesce(col, F.lit("")))
    spaced = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}&&[^一-鿿]]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(spaced, pairs)


def token_set(col: Column) -> Column:
    """Evaluation tokens: each ideograph alone, else runs of ASCII word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[一-鿿]|[A-Za-z0-9_]+"), F.lit(0)))


def normalize_tag(col: Column) -> Column:
    """Without leading ``#`` signs, lower case; null if nothing is left."""
    return F.nullif(F.lower(strip(F.regexp_replace(strip(col), r"(?U)^(#\s*)+", ""))), F.lit(""))


def split_path(col: Column) -> Column:
    """Comma-separated path as an array; empty segments are dropped, null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), strip), lambda x: x != "")


def section_key(col: Column) -> Column:
    return F.regexp_replace(col, r",\s*\[Part \d+\]$", "")


def clip(col: Column, n: int, suffix: str = "…") -> Column:
    """At most ``n`` characters; a cut text is right-trimmed and gets the suffix."""
    return F.when(F.length(col) > n, F.concat(F.regexp_replace(F.substring(col, 1, n), r"(?U)\s+$", ""), F.lit(suffix))).otherwise(col)


def activity_snippet(col: Column) -> Column:
    line = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), "\n", " ")
    return F.when(line == "", "(empty message)").when(F.length(line) > 80, F.concat(F.substring(line, 1, 77), F.lit("..."))).otherwise(line)


def to_day(col: Column) -> Column:
    """The date of ``Y-m-d``, ``Y-m-d H:M:S`` or ``Y-m-dTH:M:S``; else null."""
    return F.to_date(F.coalesce(*[F.try_to_timestamp(col, F.lit(x)) for x in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")]))


def quality(score: Column) -> Column:
    """Band of a relevance score; what isn't a number in [0, 1] is medium."""
    x = score.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    return F.when(bad, "medium").when(x >= vocab.HIGH, "high").when(x >= vocab.MEDIUM, "medium").otherwise("low")


def citation_coverage(answer: Column, sources: Column) -> Column:
    """Share of the numbered sources that the answer cites as ``[N]``."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")))
    valid = F.size(F.filter(cited, lambda x: (x >= 1) & (x <= sources)))
    return F.when(sources > 0, F.least(F.lit(1.0), valid / sources)).otherwise(0.0)


def normalize_relation_type(col: Column) -> Column:
    """One of the relation types, by name or synonym; else RELATED_TO."""
    known = F.create_map(*[F.lit(x) for pair in vocab.RELATION_SYNONYMS.items() for x in pair])
    label = strip(F.coalesce(col, F.lit("")))
    upper = F.upper(label)
    return F.when(upper.isin(*vocab.RELATION_TYPES), upper).otherwise(F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(label), "[ -]", "_")), F.lit("RELATED_TO")))


def category(type_: Column) -> Column:
    """First category with a keyword that the lower-cased type contains, else other."""
    low, out = F.lower(F.coalesce(type_, F.lit("ENTITY"))), None
    for name, words in vocab.CATEGORIES.items():
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def greedy_object(col: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(col, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


def greedy_array(col: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col, F.lit("")), r"(?s)\[.*\]", 0), F.lit(""))
