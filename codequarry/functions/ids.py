"""Cleaning of identifiers: surrounding white space and Unicode composition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Marked so that filters on its result stay above it; pushed below, they would run it twice.
_nfc_once = _nfc.asNondeterministic()


def clean_id(c: Column) -> Column:
    """The id without surrounding white space, composed (NFC); null where nothing is left.

    Spark has no composition function. Only ids with characters beyond ASCII go to Python;
    all others pass a null there, so the Arrow batches stay almost empty. The trimming
    expression runs only where the first or last character may be white space.
    """
    edge = lambda x: (F.ascii(x) <= 32) | (F.ascii(x) >= 0x80)
    space = r"(?U)^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$"
    trimmed = F.when(edge(c) | edge(F.substring(c, -1, 1)), F.regexp_replace(c, space, "")).otherwise(c)
    rare = F.when(F.octet_length(c) != F.char_length(c), trimmed)
    out = F.coalesce(_nfc_once(rare), trimmed)
    return F.when(out != "", out)
