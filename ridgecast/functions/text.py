"""Call signs, labels and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_empty(column) -> Column:
    """The value, null where it is an empty string."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normalize_call(call: Column) -> Column:
    """Stripped, then upper case, then without asterisks; null becomes ''."""
    return F.coalesce(F.replace(F.upper(F.regexp_replace(call, r"^\s+|\s+$", "")), F.lit("*"), F.lit("")), F.lit(""))


def record_key(callsign: Column, name: Column) -> Column:
    """The call sign, else the name, normalised."""
    return normalize_call(F.coalesce(non_empty(callsign), name, F.lit("")))


def coerce_number(text: Column) -> Column:
    """A double, null where the text is no number."""
    return text.try_cast("double")


def escape_text(text: Column) -> Column:
    """&, < and > as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def station_label(kind: Column, call: Column, comment: Column, length: int = 40) -> Column:
    """[TYPE] CALL — comment, the comment cut to length."""
    head = F.concat(F.lit("["), F.upper(kind), F.lit("] "), call)
    return F.when(F.coalesce(comment, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(" — "), F.substring(comment, 1, length)))


def safe_name(call: Column) -> Column:
    """A call sign usable as a file name."""
    return F.translate(call, "-/ ", "___")
