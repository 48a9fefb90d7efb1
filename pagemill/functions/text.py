"""Text expressions: Column to Column, no Python in the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip takes for space, as a character class (a fixed value).
SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode space."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def file_kind(path: Column) -> Column:
    """pdf or image, by the suffix of the last path segment; a name that is only a suffix has none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(F.lower(name).rlike(r"(?s)^.+\.pdf$"), "pdf").otherwise("image")


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", 100 * c)


def encode_targets(text: Column, vocabulary: str) -> Column:
    """Class of each character that the vocabulary has, by its first place there."""
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & (F.instr(F.lit(vocabulary), c) > 0))
    return F.transform(chars, lambda c: F.instr(F.lit(vocabulary), c) - 1)
