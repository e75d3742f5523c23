"""Journal entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import utf8_text

#: Bytes, and nulls for zeros, as a JSON array has them.
_BYTE = "(?:null|0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BYTES = rf"\A\[\s*(?:{_BYTE}(?:\s*,\s*{_BYTE})*\s*)?\]\z"


def parse_journal(df: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines to `(fields, cursor, realtime)`; bad JSON is skipped, `__` keys go.

    A string is used as it is, whatever it looks like; an array of bytes becomes their text, any other value is kept as JSON
    (without blanks between its parts, and numbers as doubles print). What kind a value is tells the line read as a variant. One that has a key twice can't be read so;
    there an array of bytes and a string of that form are told apart no longer.
    """
    m = df.withColumns({"_m": F.from_json(line, "map<string,string>"), "_v": F.try_parse_json(line)}).filter("_m is not null")
    m = m.withColumn("_strings", F.map_keys(F.map_filter(F.col("_v").try_cast("map<string,variant>"), lambda _, v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))))
    numbers = lambda v: F.split(F.regexp_replace(F.regexp_replace(v, "null", "0"), r"[\[\]\s]", ""), ",")
    decoded = lambda v: utf8_text(F.unhex(F.array_join(F.transform(numbers(v), lambda b: F.when(b == "", "").otherwise(F.lpad(F.hex(b.try_cast("int")), 2, "0"))), "")))
    plain = lambda k: F.coalesce(F.array_contains("_strings", k), F.lit(False))
    shown = lambda k, v: F.when(v.isNull(), "null").when(~v.startswith("[") | plain(k), v).when(v.rlike(BYTES), decoded(v)).otherwise(v)
    fields = F.transform_values(F.map_filter("_m", lambda k, _: ~k.startswith("__")), shown)
    return m.select(*[c for c in df.columns if c != line], fields.alias("fields"), F.try_element_at("_m", F.lit("__CURSOR")).alias("cursor"), F.try_element_at("_m", F.lit("__REALTIME_TIMESTAMP")).try_cast("long").alias("realtime"))
