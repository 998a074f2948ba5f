"""Places of matches in texts, and what is said of them, as expressions: no Python worker.

Spark tells matches but not where they are; the pieces between them do, by their lengths. Patterns are read with
Unicode's words and digits, and a dot stops at line feeds only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What denies, doubts or merely mentions a finding, and how far around it that is looked for.
DENIAL = r"(?:\b(?:no|not|without|denies|denied|never|cannot|can't|don['’]t|doesn['’]t|didn['’]t|isn['’]t|wasn['’]t)\b|\b(?:negative for|absence of)\b)(?:\W+\w+){0,8}\W*$"
DENIAL_AFTER = r"\W{0,12}(?:(?:is|are|was|were)\W+)?(?:absent|negative|denied|not present)\b"
DOUBT = r"\b(?:don['’]t|doesn['’]t|didn['’]t|do not|does not|did not)\b.{0,35}\b(?:know|say|mention|tell)\b.{0,25}\b(?:if|whether|any)\b|\b(?:not sure|unclear)\b.{0,25}\b(?:if|whether)\b"
MENTION = r"\b(?:from what i(?:'ve| have) learned\b.{0,80}|symptoms? (?:are|include)|signs? (?:are|include)|worried about|concerned about|afraid of|could this be|is this (?:a |an )?)\W*$"
SCOPE_END = r"\b(?:but|however|yet|although)\b|[.!?;]"
BEFORE, AFTER, AROUND = 90, 50, (100, 40)


SCOPE_WORD = 8  # the longest word in SCOPE_END


def exact_case(pattern: str) -> str:
    return f"(?dU){pattern}"


def any_case(pattern: str) -> str:
    return f"(?idU){pattern}"


def holds(text: Column, pattern: str) -> Column:
    return text.rlike(exact_case(pattern))


def first_at(text: Column, pattern: str) -> Column:
    """The place (from 1) of the first match, null where there is none."""
    return F.nullif(F.regexp_instr(text, F.lit(exact_case(pattern))), F.lit(0))


def folded(text: Column, pattern: str, first: Column, step: Callable, groups: tuple[int, ...] = ()) -> Column:
    """A fold over the matches in order: step(state, start, end, groups), places in characters from 0.

    groups has a field of each asked group's number. The pattern must not match empty text. A step is an
    expression as well; the text is cut once, whatever the number of matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(str(g)) for g in groups])

    def one(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["hit"])
        return F.struct(end.alias("at"), step(acc["state"], start, end, m).alias("state"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), first.alias("state")), one, lambda acc: acc["state"])


def between(text: Column, start: Column, end: Column) -> Column:
    start = F.greatest(start, F.lit(0))
    return F.substring(text, start + 1, end - start)


def is_said(text: Column, start: Column, end: Column) -> Column:
    """Nothing denies, doubts or merely mentions text[start:end].

    The clause's beginning is looked for as far back as it can matter, and a word more, so that none is cut.
    """
    back = between(text, start - (BEFORE + SCOPE_WORD + 3), start)
    clause = F.regexp_replace(back, any_case(f"(?s)^.*(?:{SCOPE_END})"), "")
    lead = F.right(clause, F.lit(BEFORE))
    denied = lead.rlike(any_case(DENIAL)) | between(text, end, end + AFTER).rlike(any_case(f"^(?:{DENIAL_AFTER})"))
    doubted = between(text, start - AROUND[0], end + AROUND[1]).rlike(any_case(DOUBT))
    return ~(denied | lead.rlike(any_case(MENTION)) | doubted)


def asserted(patterns: Iterable[str], text: Column) -> Column:
    """Does a pattern match where nothing denies, doubts or only mentions it? Null texts assert nothing.

    Texts without a match stop at one look; the others take time by matches times length.
    """
    text, found = F.coalesce(text, F.lit("")), F.lit(False)
    for p in map(any_case, patterns):
        said = folded(text, p, F.lit(False), lambda state, start, end, _: F.when(state, state).otherwise(is_said(text, start, end)))
        found |= F.when(text.rlike(p), said).otherwise(F.lit(False))
    return found
