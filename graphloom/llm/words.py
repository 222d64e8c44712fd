"""The one definition of "words" and "likeness" that the text operators share.

Words are maximal runs of letters or digits after lower-casing.  Likeness of
two texts is |distinct words in both| / |distinct words in either|.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The same set of characters, once for the JVM and once for Python.
JAVA_WORD = r"[\p{L}\p{N}]+"
PY_WORD = re.compile(r"[^\W_]+")


def words(text: Column) -> Column:
    """All words in order; NULL text gives NULL, text without words an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(JAVA_WORD), F.lit(0))


def py_words(text: str) -> list[str]:
    return PY_WORD.findall(text.lower())


def least_overlap(a: Column, b: Column, t: float) -> Column:
    """Smallest |A∩B| with which sets of these sizes reach Jaccard ``t``."""
    return F.ceil(F.lit(t) / (1 + F.lit(t)) * (a + b) - 1e-9)
