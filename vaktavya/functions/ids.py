"""Spelling of utterance ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A call number and a turn number, whatever folder, extension, case or joining mark surrounds them.
ID_PATTERN = r"(?i)(?:^|[/\\])c([0-9]+)[_\- ]t([0-9]+)(?:\.[a-z0-9]+)?$"


def plain_id(raw: Column) -> Column:
    """``c`` + call of at least 8 digits + ``_t`` + turn of at least 4 digits.

    Folder, file extension, outer blanks, letter case, joining mark and zero padding don't
    matter. A value that holds no such id comes back trimmed; null stays null.
    """
    text = F.regexp_replace(raw, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")

    def padded(group: int, width: int) -> Column:
        digits = F.regexp_replace(F.regexp_extract(text, ID_PATTERN, group), r"^0+(?=[0-9])", "")
        return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))

    return F.when(text.rlike(ID_PATTERN), F.concat(F.lit("c"), padded(1, 8), F.lit("_t"), padded(2, 4))).otherwise(text)
