"""Name clean-up as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points Python calls whitespace; Java's plain `\s` is
# narrower. Texts are lower case when DROPPED sees them, so A-Z need not be kept.
# Written with the property, eight tasks filter eight times as much text as one;
# a list of ranges makes Java's matcher contend for a cache line and gains nothing.
WHITESPACE = r"\p{IsWhite_Space}\x1C-\x1F"
DROPPED = f"[^a-z0-9{WHITESPACE}]"
OUTER_WHITESPACE = f"^[{WHITESPACE}]+|[{WHITESPACE}]+$"
TOKEN = "[a-z0-9]{2,}"


def normalize(name: Column) -> Column:
    """Lower-case and delete everything but letters a-z, digits and whitespace.

    Null becomes "". Accented letters and hyphens are deleted, inner and outer
    whitespace is kept as it is.
    """
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), DROPPED, "")


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(text, OUTER_WHITESPACE, "")


def is_valid(name: Column) -> Column:
    """True when the raw name has more than one character once stripped."""
    return F.coalesce(F.length(strip(name)) > 1, F.lit(False))


def tokens(normalized: Column) -> Column:
    """Runs of two or more letters or digits, in order, repeats kept."""
    return F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0))


def capitalize(text: Column) -> Column:
    """First character up, all others down."""
    return F.concat(
        F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text)))
    )


def drop_char(text: Column, position: Column) -> Column:
    """Delete the character at the 0-based position; "" stays ""."""
    return F.concat(
        F.substring(text, F.lit(1), position),
        F.substring(text, position + 2, F.length(text)),
    )
