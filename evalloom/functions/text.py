"""Text rules as Column functions; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
# Answer formats and markers.
ANSWER = r"(?i)ACUITY\s*[:\-]\s*([A-D])"
REASONING = r"(?is)REASONING\s*[:\-]\s*(.*?)(?=\nACUITY|$)"
LABEL_LEAK = r"(?i)\b(?:acuity|disposition)\s*(?:label|category)?\s*[:=]\s*[abcd]\b"
SLICE_FROM, SLICE_TO = "About me:", "Please answer in exactly"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def digest12(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON, keys in order, nulls told."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def between_markers(text: Column, start: str = SLICE_FROM, end: str = SLICE_TO) -> Column:
    """From the first start marker on, up to the first end marker after it; a missing marker cuts nothing."""
    at = F.instr(text, start)
    head = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    stop = F.instr(head, end)
    return strip(F.when(stop > 0, F.substring(head, F.lit(1), stop - 1)).otherwise(head))


def answer_label(text: Column) -> Column:
    """The first label that an answer gives, or null."""
    return F.upper(F.nullif(F.regexp_extract(text, ANSWER, 1), F.lit("")))


def answer_reasoning(text: Column) -> Column:
    return F.coalesce(strip(F.regexp_extract(text, REASONING, 1)), F.lit(""))


def messages(json: Column) -> Column:
    """A JSON list of messages, reduced to role and content."""
    return F.from_json(json, MESSAGES)


def chat_text(chat: Column) -> Column:
    """Messages as text: a line with the role, then the content."""
    role = lambda m: F.when(m["role"] == "user", "[USER]").when(m["role"] == "assistant", "[ASSISTANT]").otherwise(F.concat(F.lit("["), F.upper(F.coalesce(m["role"], F.lit("unknown"))), F.lit("]")))
    return F.array_join(F.transform(chat, lambda m: F.concat(role(m), F.lit("\n"), F.coalesce(m["content"], F.lit("")))), "\n\n")


def user_text(chat: Column) -> Column:
    """What the user wrote, messages joined by a blank line; null if nothing."""
    mine = F.filter(chat, lambda m: F.coalesce((F.lower(m["role"]) == "user") & (strip(m["content"]) != ""), F.lit(False)))
    return F.nullif(F.array_join(F.transform(mine, lambda m: m["content"]), "\n\n"), F.lit(""))


def message_text(json: Column) -> Column:
    """The contents of a JSON list of messages, a line each; the text itself where it is none."""
    chat = F.from_json(json, MESSAGES)
    return F.coalesce(F.array_join(F.transform(chat, lambda m: m["content"]), "\n"), json)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders replaced one after another, in the order given; any that is left raises."""
    for k, v in values.items():
        template = F.replace(template, F.lit(k), F.coalesce(v, F.lit("")))
    return F.when(F.contains(template, F.lit("{{")), F.raise_error(F.lit("Unresolved placeholder"))).otherwise(template)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def normalised(text: Column) -> Column:
    return F.array_join(words(text), " ")


def trigrams(tokens: Column) -> Column:
    """Distinct runs of three tokens; none where there are fewer."""
    n = F.size(tokens)
    k = F.greatest(n - 2, F.lit(0))
    shifted = [F.slice(tokens, i, k) for i in (1, 2, 3)]  # a lambda over slices of tokens would compute them anew for each
    some = F.array_distinct(F.zip_with(F.zip_with(shifted[0], shifted[1], lambda a, b: F.concat_ws(" ", a, b)), shifted[2], lambda a, b: F.concat_ws(" ", a, b)))
    return F.when(n >= 3, some).otherwise(F.array().cast("array<string>"))


def containment(a: Column, b: Column) -> Column:
    """Shared share of the smaller set; 0 where one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))), F.lit(0.0))


def relative_score(sequence: Column, contained: Column, exact: Column, at_sequence: float, at_contained: float) -> Column:
    return F.greatest(sequence / at_sequence, contained / at_contained, F.when(exact, 2.0).otherwise(0.0))


def segments(text: Column) -> Column:
    """Sentences and list items; the text itself where nothing is left."""
    lines = F.filter(F.transform(F.split(text, r"\n+"), strip), lambda s: s != "")
    parts = F.flatten(F.transform(lines, lambda s: F.split(s, r"""(?<=[.!?])\s+(?=[A-Z0-9"'])""")))
    clean = F.transform(parts, lambda s: strip(F.regexp_replace(F.regexp_replace(strip(s), r"^#{1,6}\s*", ""), r"^(?:[-*•]|\d+[.)])\s+", "")))
    kept = F.filter(clean, lambda s: s != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


def opening(fragments: Column, most: int = 3, characters: int = 140) -> Column:
    """The first fragments, until there are three or 140 characters."""
    before = lambda i: F.aggregate(F.slice(fragments, 1, i), F.lit(0), lambda acc, s: acc + F.length(s))
    return F.filter(fragments, lambda s, i: (i == 0) | ((i < most) & (before(i) < characters)))


def pattern_group(text: Column, groups: dict[str, list[str]], other: str = "general_other") -> Column:
    """The group whose patterns match most often, first by name of equals; other if none does."""
    scored = [F.struct((-sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in ps), F.lit(0))).alias("s"), F.lit(g).alias("g")) for g, ps in sorted(groups.items())]
    best = F.array_min(F.array(*scored))
    return F.when(best["s"] < 0, best["g"]).otherwise(other)


def information_score(known: Column, fragments: Column, length: Column) -> Column:
    return known * 5 + F.least(fragments, F.lit(25)) + F.least(F.floor(length / 200), F.lit(12)) - F.greatest(F.lit(0), F.floor((length - 3000) / 250))


def redacted(message: Column, secret: Column, most: int = 4000) -> Column:
    hidden = F.when(F.length(secret) > 0, F.replace(message, secret, F.lit("[REDACTED]"))).otherwise(message)
    return F.substring(hidden, 1, most)


def unsafe_labels(gold: Column) -> Column:
    """All labels less severe than the reference."""
    return F.filter(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: x < gold)


def chat_prompt(text: Column, is_chat: Column) -> Column:
    """A conversation as it is, other text as one user message, both as JSON lists of messages."""
    return F.when(is_chat, text).otherwise(F.to_json(F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))))


def first_with_prefix(tags: Column, prefix: str) -> Column:
    return F.substring(F.get(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(0)), len(prefix) + 1, 1 << 20)


def label_basis(method: Column, dataset: Column, special: str = "healthbench") -> Column:
    """How a label came about."""
    return F.when(method == "median", "released_five_physician_panel_median").when((dataset == special) & (method == "direct"), "healthbench_physician_agreed_emergent_category").otherwise("released_direct_source_mapping")


def usable_length(text: Column, least: int, most: int, exclusions: list[str]) -> Column:
    """Is the text so many characters long, and does no pattern match in it? A null text is not."""
    clean = F.lit(True)
    for p in exclusions:
        clean = clean & ~text.rlike(p)
    return F.coalesce(F.length(text).between(least, most) & clean, F.lit(False))


def numbered_id(name: Column, idx: Column) -> Column:
    """A name on one line, and the row's place in its file."""
    return F.concat_ws("_", strip(F.replace(name, F.lit("\n"), F.lit(" "))), idx.cast("string"))


def nice_step(span: Column, ticks: int = 6) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that cuts the span into at most so many steps; 1 for none."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    steps = F.filter(F.array(*[F.lit(x) for x in (1.0, 2.0, 2.5, 5.0, 10.0)]), lambda s: s * power >= raw * (1 - 1e-12))
    return F.when((span > 0) & ~span.isin(float("inf")), F.array_min(steps) * power).otherwise(F.lit(1.0))


def _decimals(value: Column, places: int) -> Column:
    return F.format_number(value, places)


def money_text(value: Column) -> Column:
    """Dollars: whole ones without decimals, others with one."""
    return F.concat(F.lit("$"), F.when(F.abs(value - F.bround(value, 0)) <= 1e-9 * F.abs(value), _decimals(F.bround(value, 0), 0)).otherwise(_decimals(value, 1)))


def duration_text(value: Column) -> Column:
    """Seconds: whole ones without decimals, others with one, those under a second with two; zeros at the end go."""
    short = F.regexp_replace(F.when(F.abs(value) < 1, _decimals(value, 2)).otherwise(_decimals(value, 1)), r"\.?0+$", "")
    return F.concat(F.when(F.abs(value - F.bround(value, 0)) <= 1e-9 * F.abs(value), _decimals(F.bround(value, 0), 0)).otherwise(short), F.lit("s"))
