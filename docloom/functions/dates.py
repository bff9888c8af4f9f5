"""Send dates of mail headers: a ladder of native patterns, then a general parser for what is left."""

from __future__ import annotations

import re

import pandas as pd
from dateutil import parser as _parser
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.functions import fixed

_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
# Shapes (Y for four digits, d for one or two, a for AM or PM, L and S for long and short months) and their formats.
_MONTHS_FIRST = {
    "d/d/Y d:d:d a": "M/d/yyyy h:mm:ss a", "d/d/Y d:d a": "M/d/yyyy h:mm a", "d/d/Y d:d": "M/d/yyyy H:mm", "d/d/Y": "M/d/yyyy", "L d, Y d:d:d a": "MMMM d, yyyy h:mm:ss a", "L d, Y d:d a": "MMMM d, yyyy h:mm a",
    "L d, Y": "MMMM d, yyyy", "S d, Y d:d a": "MMM d, yyyy h:mm a", "Y-d-d d:d:d": "yyyy-MM-dd HH:mm:ss", "Y-d-d": "yyyy-MM-dd",
}
_DAYS_FIRST = {"d/d/Y d:d a": "d/M/yyyy h:mm a", "d/d/Y d:d": "d/M/yyyy HH:mm", "d/d/Y": "d/M/yyyy"}
_SHAPE = [(r"(?i)\b[ap]m$", "a"), (r"\d{4}", "Y"), (r"\d{1,2}", "d"), (r"^(?:[A-Za-z]{4,9}|[Mm]ay)\b", "L"), (r"^[A-Za-z]{3}\b", "S")]


@pandas_udf(T.TimestampType())
def _general(raw: pd.Series) -> pd.Series:
    def one(text):
        if text is None or not _YEAR.search(text):
            return None
        try:
            return _parser.parse(text, fuzzy=True, dayfirst=bool(re.search(r"(?i)\(GMT[+\-]", text))).replace(tzinfo=None)
        except (ValueError, OverflowError, TypeError):
            return None

    return pd.Series([one(t) for t in raw], dtype="datetime64[ns]")


# A filter on the result must not be inferred through the parse and evaluated on every row before the join.
_general = _general.asNondeterministic()


def native_sent(raw: Column) -> Column:
    """The date by known shapes, null for others. A zone in brackets after GMT marks the day-first shapes.

    The shape of a value, in which digits and months are letters, names the one format that it is parsed with.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\s*\([^)]*\)\s*$", ""), r"(?i)^(mon|tues|wednes|thurs|fri|satur|sun)day,\s*", ""))
    shape = plain
    for pattern, letter in _SHAPE:
        shape = F.regexp_replace(shape, pattern, letter)
    tagged = F.concat(F.when(raw.rlike(r"(?i)\(GMT[+\-]"), "D").otherwise("M"), shape)
    formats = {"M" + k: v for k, v in _MONTHS_FIRST.items()} | {"D" + k: v for k, v in _DAYS_FIRST.items()}
    form = F.try_element_at(F.create_map(*[F.lit(x) for pair in formats.items() for x in pair]), tagged)
    return F.when(raw.rlike(r"\b(?:19|20)\d{2}\b"), F.try_to_timestamp(plain, form))


def parse_sent(rows: DataFrame, column: str = "sent_raw", out: str = "sent_at") -> DataFrame:
    """rows with the send date added; each distinct value is parsed once, years outside the corpus give null.

    The general parser gets nulls for all values that a known shape has settled.
    """
    values = rows.select(F.col(column).alias("_v")).filter(F.col("_v").isNotNull()).distinct().withColumn("_known", native_sent(F.col("_v")))
    parsed = values.select("_v", F.coalesce("_known", _general(F.when(F.col("_known").isNull(), F.col("_v")))).alias("_n"))
    inside = F.year("_n").between(*fixed.CORPUS_YEARS)
    parsed = parsed.select("_v", F.when(inside, F.col("_n").cast("timestamp_ntz")).alias(out), (F.col("_n").isNotNull() & ~inside).alias("out_of_range"))
    return rows.join(parsed, F.col(column) == F.col("_v"), "left").drop("_v").withColumn("out_of_range", F.coalesce("out_of_range", F.lit(False)))
