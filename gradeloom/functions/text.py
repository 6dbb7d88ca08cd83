"""Text clean-up as native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from gradeloom import constants as K

_SPACE_RUN = "[" + "".join(re.escape(c) for c in K.WHITESPACE) + "]+"


def strip(text: Column) -> Column:
    """Trim every whitespace character, not only the plain space that ``trim`` removes."""
    return F.btrim(text, F.lit(K.WHITESPACE))


def fold(text: Column) -> Column:
    """Collapse whitespace runs, trim, lower-case: the form two strings are compared in."""
    return F.lower(strip(F.regexp_replace(text, _SPACE_RUN, " ")))


def word_count(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _SPACE_RUN))).cast("long")


def unfence(text: Column, pattern: str = K.FENCE_PATTERN) -> Column:
    """Body of a text that is one fenced block, else the text."""
    fenced = text.startswith("```") & text.rlike(pattern)
    return F.when(fenced, strip(F.regexp_extract(text, pattern, 1))).otherwise(text)


def _extract(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def outer_json(text: Column) -> Column:
    """Slice from the first opening bracket to the last closer of its kind; the text if there is none."""
    whole = (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]"))
    return F.when(whole, text).otherwise(F.coalesce(_extract(text, r"(?s)^[^\[{]*+(\{.*\}|\[.*\])"), text))


def outer_braces(text: Column) -> Column:
    """Slice from the first ``{`` to the last ``}``; NULL if there is no such span."""
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(_extract(text, r"(?s)^[^{]*+(\{.*\})"))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, K.SMART_QUOTES, K.PLAIN_QUOTES)


def snippet(text: Column, n: int = 150) -> Column:
    """First ``n`` characters on one line, newlines marked."""
    return F.translate(F.substring(F.coalesce(text, F.lit("")), 1, n), "\n", K.NEWLINE_MARK)


def fmt_delta(value: Column, decimals: int = 3) -> Column:
    """Signed fixed-point text; anything that rounds to zero is written without a sign."""
    rounded = F.round(value, decimals)
    return F.when(rounded == 0, F.lit(f"{0.0:.{decimals}f}")).otherwise(
        F.format_string(f"%+.{decimals}f", rounded)
    )


def category_of(prompt_id: Column) -> Column:
    """Task category from the id prefix, '?' if the prefix is unknown."""
    names = F.create_map(*[F.lit(x) for kv in K.PREFIX_CATEGORY.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.substring_index(prompt_id, "-", 1)), F.lit("?"))


def friendly_model(model: Column) -> Column:
    """Short model name: the known map, else the id without its date suffix."""
    names = F.create_map(*[F.lit(x) for kv in K.FRIENDLY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, model), F.regexp_replace(model, K.DATE_SUFFIX_PATTERN, ""))


def provider_of(model: Column) -> Column:
    """Provider family by id prefix."""
    out = F.lit(K.PROVIDER_DEFAULT)
    for prefix, provider in K.PROVIDER_BY_PREFIX.items():
        out = F.when(model.startswith(prefix), F.lit(provider)).otherwise(out)
    return out


def half_up(value: Column, decimals: int) -> Column:
    """Decimal half-up rounding of a double, the form published columns take."""
    return F.round(value.cast("decimal(38,12)"), decimals).cast("double")
