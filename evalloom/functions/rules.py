"""The few rules that need Python: each is a pandas UDF over Arrow batches, with its reason.

object_text: scanning for the first parsable object needs a JSON parser that can stop anywhere.
sequence_ratio: its scores are defined by the matching-blocks algorithm of Python's difflib.
tidy: Spark has no Unicode compatibility normalisation; all else of it is native.
"""

from __future__ import annotations

import json
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from evalloom.functions.text import strip


def first_object(text: str | None) -> str | None:
    """The first JSON object in a text, fences and other words around it aside, as canonical JSON."""
    if text is None:
        return None
    text = text.strip()
    if text.startswith("```"):
        text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text, flags=re.IGNORECASE))
    reader, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found = reader.raw_decode(text, at)[0]
            return json.dumps(found, sort_keys=True, ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def object_text(s: pd.Series) -> pd.Series:
    return s.map(first_object)


def ratio(a: str | None, b: str | None, least: float = 0.0) -> float:
    """difflib's ratio of a to b, a null being empty; 0 where it can't reach least. Screens score by functions.alike, too."""
    a, b = a or "", b or ""
    m = SequenceMatcher(None, a, b)
    return m.ratio() if least <= 0 or m.quick_ratio() >= least else 0.0


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: What normalisation can change: characters beyond ASCII, and the one before them, which they may join. Nothing joins across the ASCII character after them.
FOREIGN = r"[\x00-\x7F]?[^\x00-\x7F]+"


def tidy(text: Column) -> Column:
    """NFKC, line ends as newlines, blanks and blank lines squeezed; only what isn't ASCII passes through Python.

    Of a text, its runs of other characters do, put together with the NULs that it no longer has; what is between them never leaves Spark.
    """
    text = F.replace(text, F.lit("\x00"), F.lit(""))
    runs = F.split(_nfkc(F.array_join(F.regexp_extract_all(text, F.lit(FOREIGN), F.lit(0)), "\x00")), "\x00", -1)
    plain = F.array_join(F.zip_with(F.split(text, FOREIGN, -1), runs, lambda gap, run: F.concat(gap, F.coalesce(run, F.lit("")))), "")
    for pattern, by in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        plain = F.regexp_replace(plain, pattern, by)
    return strip(plain)
