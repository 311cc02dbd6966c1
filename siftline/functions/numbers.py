"""Lenient numbers, softmax, and per-record sequence flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"(?i)\A\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*\z"


def to_double(c: Column) -> Column:
    """Text to double; null where the text is not a number."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """A column of ``df`` as double, parsed leniently if it is text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_double(F.col(name))
    return F.col(name).cast("double")


def first_metric(df: DataFrame, names: list[str]) -> Column:
    """First non-empty value of the named columns that ``df`` has, as double."""
    present = []
    for n in names:
        if n in df.columns:
            if isinstance(df.schema[n].dataType, T.StringType):
                text = F.col(n)
                bad = F.raise_error(F.concat(F.lit(f"metric {n} is not a number: "), text))
                present.append(
                    F.when(
                        F.nullif(text, F.lit("")).isNotNull(),
                        F.coalesce(to_double(text), bad.cast("double")),
                    )
                )
            else:
                present.append(F.col(n).cast("double"))
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def composite_score(dockq: Column, iptm: Column, interface: Column) -> Column:
    """``100 * iptm - interface`` if both are known, else dockq, else iptm."""
    return F.coalesce(100 * iptm - interface, dockq, iptm)


def softmax(logits: Column) -> Column:
    """Softmax of an array of logits, inside the row."""
    peak = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x.cast("double") - peak.cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raised, lambda x: x / total)


def complement(c: Column) -> Column:
    """Complementary RNA strand, letter by letter."""
    return F.translate(c, "ACGU", "UGCA")


def gc_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^GC]", "")) / F.length(c)


def sequence_flags(
    c: Column,
    gc_min: float = 0.3,
    gc_max: float = 0.65,
    run: int = 5,
    gc_run: int = 6,
    palindrome: int = 4,
) -> dict[str, Column]:
    """Rule flags of a short RNA sequence; the limits are parameters.

    A sequence can fold if it shares a stretch of ``palindrome`` letters with its
    own reverse complement.
    """
    share = gc_share(c)
    both = F.concat(c, F.lit("\x00"), F.reverse(complement(c)))
    folded = both.rlike(rf"(?s)([^\x00]{{{palindrome}}})[^\x00]*+\x00.*?\1")
    return {
        "gc_flag": ((share < gc_min) | (share > gc_max)).cast("int"),
        "run_flag": c.rlike(rf"(?s)(.)\1{{{run - 1}}}").cast("int"),
        "gc_run_flag": c.rlike(f"[GC]{{{gc_run},}}").cast("int"),
        "palindrome_flag": folded.cast("int"),
    }
