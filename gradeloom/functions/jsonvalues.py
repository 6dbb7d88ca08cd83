"""Typed JSON values as VARIANT columns: parsing, kinds and equality."""

from __future__ import annotations

import struct
from collections.abc import Callable
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import VariantVal

from gradeloom import constants as K
from gradeloom.functions import text as T


def _variant(text: Column) -> Column:
    # the quick parser refuses NaN and infinities, which the other one reads as numbers
    return F.when(text.rlike("NaN|Infinity"), F.from_json(text, "variant")).otherwise(F.try_parse_json(text))


def field(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def as_variant(df: DataFrame, column: str) -> Column:
    """A JSON column as VARIANT, whether it is stored as text or as VARIANT."""
    return _variant(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a Column so that an expression using it several times computes it once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def document(text: Column) -> Column:
    """VARIANT of a text that holds exactly one JSON document, else NULL.

    Spark's parser stops after the first document and ignores what follows.  Parsing the
    text as a list item (or, for a list, as a field) exposes trailing content: it breaks the
    wrapper or adds a second item.  Only content that opens with the wrapper's own closer
    slips through, so texts where that could be are parsed in the other wrapper as well.
    """
    is_list = text.startswith("[")
    doubtful = (
        F.when(is_list, text.rlike(r"\]\s*[},]"))
        .when(text.startswith("{"), text.rlike(r"\}\s*\]"))
        .otherwise(F.contains(text, F.lit("]")))
    )
    as_item, as_field = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))

    def only(items: Column) -> Column:
        return F.when(field(items, "$[1]").isNull(), field(items, "$[0]"))

    def both(w: Column) -> Column:
        return F.when(w["o"].isNotNull(), only(w["l"]))

    # an object whose only closing brace is its last character cannot end early; most answers are such
    closed = F.when(text.startswith("{"), F.instr(text, "}") == F.length(text)).when(is_list, F.instr(text, "]") == F.length(text))
    # telling these apart is far cheaper than letting the parser raise
    broken = text.startswith("{") & ~(text.endswith("}") & text.rlike(r"^\{\s*[\"}]"))
    careful = let(F.struct(_variant(as_item).alias("l"), _variant(as_field).alias("o")), both)
    return (F.when(text.isNull() | broken, F.lit(None).cast("variant")).when(closed, _variant(text)).when(doubtful, careful)
            .when(is_list, field(_variant(as_field), "$.v")).otherwise(let(_variant(as_item), only)))


def kind_of(value: Column) -> Column:
    """null, bool, int, float, str, list or dict; NULL when the value is absent."""
    # whole numbers beyond 64 bits arrive as wide decimals without fraction digits
    shape = F.regexp_extract(F.schema_of_variant(value), r"^(DECIMAL\((?:19|2\d|3\d),0\)|[A-Z]{2})", 1)
    names = {"VO": "null", "BO": "bool", "BI": "int", "DE": "float", "DO": "float", "ST": "str", "AR": "list", "OB": "dict"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, shape), F.lit("int")))


def is_number(value: Column) -> Column:
    """Whether a value is there and of kind int or float, from the first letters of its type alone."""
    return F.coalesce(~F.substring(F.schema_of_variant(value), 1, 2).isin("VO", "BO", "ST", "AR", "OB"), F.lit(False))


def is_text(value: Column) -> Column:
    """Whether a value is there and of kind str."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def entries(value: Column) -> Column:
    """Top-level keys and values of a JSON object, NULL for anything else."""
    return value.try_cast("map<string,variant>")


def items(value: Column) -> Column:
    return value.try_cast("array<variant>")


def typed(value: Column, depth: int = 2) -> Column:
    """``struct(kind, text, number, items)``: what equality looks at, read from the VARIANT once.

    ``depth`` is the number of list levels that are opened; values that ``needs_walk`` names are
    compared elsewhere, whatever their depth.
    """

    def build(kind: Column) -> Column:
        fields = [
            kind.alias("kind"),
            F.when(kind == "str", T.fold(value.try_cast("string"))).otherwise(F.to_json(value)).alias("text"),
            F.when(kind.isin("int", "float"), value.try_cast("double")).alias("number"),
        ]
        if depth:
            fields.append(F.when(kind == "list", F.transform(items(value), lambda v: typed(v, depth - 1))).alias("items"))
        return F.struct(*fields)

    return let(kind_of(value), build)


def types_match(got: Column, expected: Column) -> Column:
    """Kind check of two ``typed`` values; booleans are not numbers, whole numbers pass as floats."""
    g, e = got["kind"], expected["kind"]
    return (
        F.when(g.isNull(), F.lit(False))
        .when(e == "null", g != "str")
        .when(e == "float", g.isin("int", "float"))
        .otherwise(g == e)
    )


def _take_out(rest: Column, wanted: Column, depth: int) -> Column:
    """``rest`` without its first item equal to ``wanted``; NULL if none is."""

    def cut(hit: Column) -> Column:
        at = hit.cast("int")
        return F.when(at > 0, F.concat(F.slice(rest, F.lit(1), at - 1), F.slice(rest, at + 1, F.size(rest) - at)))

    return let(F.array_position(F.transform(rest, lambda m: values_equal(m, wanted, depth)), True), cut)


def values_equal(got: Column, expected: Column, depth: int = 2) -> Column:
    """Equality of two ``typed`` values of the same depth.

    Numbers within the float tolerance, strings folded, lists in any order: each expected
    item uses up the first equal one that is left.
    """
    g, e = got["kind"], expected["kind"]
    same_text = got["text"] == expected["text"]
    close = F.abs(got["number"] - expected["number"]) < F.lit(K.FLOAT_TOLERANCE)
    whole = got["number"] == F.floor(got["number"])
    lists = same_text
    if depth:
        left = F.aggregate(expected["items"], got["items"], lambda rest, want: _take_out(rest, want, depth - 1))
        lists = (F.size(got["items"]) == F.size(expected["items"])) & left.isNotNull()
    result = (
        F.when(e == "int", ((g == "int") & same_text) | ((g == "float") & close & whole))
        .when(e == "float", g.isin("int", "float") & close)
        .when(e == "list", (g == "list") & lists)
        .otherwise((g == e) & same_text)
    )
    return F.coalesce(result, F.lit(False))


def typed_fields(value: Column) -> Column:
    """``array(struct(key, value))`` of an object, values ``typed``."""
    return F.transform(F.map_entries(entries(value)),
                       lambda kv: F.struct(kv["key"].alias("key"), typed(kv["value"]).alias("value")))


def field_pairs(got: Column, wanted: Column) -> Column:
    """For each wanted field (see ``typed_fields``) the pair ``struct(want, got)``."""
    return let(entries(got), lambda have: F.transform(wanted, lambda w: F.struct(
        w["value"].alias("want"), typed(F.try_element_at(have, w["key"])).alias("got"))))


def needs_walk(expected: Column) -> Column:
    """TRUE for an expected object (VARIANT) whose fields hold objects, or lists below a second level.

    Columns express the comparison of scalars and of lists down to two levels; anything deeper has
    to be walked value by value.
    """
    plain = F.regexp_replace(F.to_json(expected), r'"(?:[^"\\]|\\.)*"', "0")
    shallow = F.regexp_replace(F.regexp_replace(plain, r"\[[^\[\]{}]*\]", "0"), r"\[[^\[\]{}]*\]", "0")
    return F.coalesce(F.contains(shallow, F.lit("[")) | F.contains(F.substring(plain, F.lit(2), F.length(plain)), F.lit("{")), F.lit(False))


#: Tags of a VARIANT's plain values: constants, and little-endian whole numbers by their bytes.
_CONSTANTS, _WHOLE_BYTES = {0: None, 4: True, 8: False}, {12: 1, 16: 2, 20: 4, 24: 8}
#: Bytes of the unscaled number of a decimal.
_DECIMAL_BYTES = {32: 4, 36: 8, 40: 16}
_DOUBLE = struct.Struct("<d").unpack_from


class _OtherType(ValueError):
    """A value that JSON text cannot hold, such as a date."""


@lru_cache(4096)  # rows of one kind have the same names
def _keys(metadata: bytes) -> list[str]:
    """The names of a VARIANT's fields, by number."""
    width = (metadata[0] >> 6) + 1
    n = int.from_bytes(metadata[1:1 + width], "little")
    ends = [int.from_bytes(metadata[i:i + width], "little") for i in range(1 + width, 1 + (n + 2) * width, width)]
    start = 1 + (n + 2) * width
    return [metadata[start + a:start + b].decode() for a, b in zip(ends, ends[1:])]


def _read(v: bytes, at: int, keys: list[str]) -> object:
    """The value at a place of a VARIANT's bytes: None, bool, int, float, str, list or dict.

    Decimals without fraction digits (whole numbers beyond 64 bits) are ints, others floats.
    """
    tag = v[at]
    kind = tag & 3
    if kind == 1:
        return v[at + 1:at + 1 + (tag >> 2)].decode()
    if kind == 0:
        if tag in _WHOLE_BYTES:
            return int.from_bytes(v[at + 1:at + 1 + _WHOLE_BYTES[tag]], "little", signed=True)
        if tag in _CONSTANTS:
            return _CONSTANTS[tag]
        if tag in _DECIMAL_BYTES:
            unscaled = int.from_bytes(v[at + 2:at + 2 + _DECIMAL_BYTES[tag]], "little", signed=True)
            return unscaled / 10 ** v[at + 1] if v[at + 1] else unscaled
        if tag == 28:
            return _DOUBLE(v, at + 1)[0]
        if tag == 64:
            return v[at + 5:at + 5 + int.from_bytes(v[at + 1:at + 5], "little")].decode()
        raise _OtherType(tag)
    width = ((tag >> 2) & 3) + 1
    if (tag >> (6 if kind == 2 else 4)) & 1:
        n, names = int.from_bytes(v[at + 1:at + 5], "little"), at + 5
    else:
        n, names = v[at + 1], at + 2
    name_width = ((tag >> 4) & 3) + 1 if kind == 2 else 0
    place = names + n * name_width
    data = place + (n + 1) * width
    if width == 1:
        values = [_read(v, data + offset, keys) for offset in v[place:place + n]]
    else:
        values = [_read(v, data + int.from_bytes(v[i:i + width], "little"), keys) for i in range(place, place + n * width, width)]
    if kind == 3:
        return values
    if name_width == 1:
        return {keys[k]: x for k, x in zip(v[names:place], values)}
    return {keys[int.from_bytes(v[i:i + name_width], "little")]: x for i, x in zip(range(names, place, name_width), values)}


def _value(value: bytes, metadata: bytes) -> object:
    try:
        return _read(value, 0, _keys(metadata))
    except _OtherType:
        return VariantVal(value, metadata).toPython()


def _whole(value: object) -> bool:
    """A JSON number without fraction or exponent; wide ones may arrive as decimals."""
    return isinstance(value, int) or (isinstance(value, Decimal) and value.as_tuple().exponent == 0)


def _number(value: object) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def _same(got: object, want: object) -> bool:
    """Plain equality inside objects: numbers by value, booleans as 1 and 0, texts and lists as they are."""
    if isinstance(want, dict):
        return isinstance(got, dict) and got.keys() == want.keys() and all(_same(got[k], v) for k, v in want.items())
    if isinstance(want, list):
        return isinstance(got, list) and len(got) == len(want) and all(map(_same, got, want))
    if isinstance(want, (bool, int, float, Decimal)):
        if not isinstance(got, (bool, int, float, Decimal)):
            return False
        return got == want if _whole(got) and _whole(want) else float(got) == float(want)
    return type(got) is type(want) and got == want


def _walk(got: object, want: object) -> bool:
    """Equality of two values at any depth, by the rules of ``values_equal``."""
    if isinstance(want, str):
        return isinstance(got, str) and (got == want or " ".join(got.split()).lower() == " ".join(want.split()).lower())
    if isinstance(want, list):
        if not isinstance(got, list) or len(got) != len(want):
            return False
        rest = got.copy()
        for item in want:
            for i, x in enumerate(rest):
                if _walk(x, item):
                    del rest[i]
                    break
            else:
                return False
        return True
    if isinstance(want, dict):
        return _same(got, want)
    if _number(want):
        if not _number(got) or (_whole(want) and not _whole(got) and float(got) % 1):
            return False
        return got == want if _whole(got) and _whole(want) else abs(float(got) - float(want)) < K.FLOAT_TOLERANCE
    return type(got) is type(want) and got == want


def _fields_equal(got: object, want: object, kinds: bool) -> bool:
    """Whether every wanted field is there and equal, and with ``kinds`` also of the right kind.

    Of the kinds only that of whole numbers is left to look at: where a field is wanted, ``_walk`` sees to the others.
    """
    if not isinstance(want, dict) or not isinstance(got, dict):
        return want == {} and kinds  # no field is wanted
    for k, v in want.items():
        if k not in got or not _walk(got[k], v) or (kinds and _number(v) and _whole(v) and not _whole(got[k])):
            return False
    return True


def walked_equal(got: Column, expected: Column, kinds: bool = False) -> Column:
    """TRUE if every field of the expected object equals that of the other; NULL inputs are passed over.

    With ``kinds`` the fields must also be of the right kind, and NULLs count as values without fields.
    One vectorised Python function over the bytes of the values, at any depth.
    """
    @F.arrow_udf("boolean")
    def walked(got: pa.Array, expected: pa.Array) -> pa.Array:
        columns = [c.to_pylist() for x in (got, expected) for c in (x.field("value"), x.field("metadata"), x.is_null())]
        out = []
        for g, gm, no_g, e, em, no_e in zip(*columns, strict=True):
            if not kinds and (no_g or no_e):
                out.append(None)
                continue
            have = None if no_g else _value(g, gm)
            same = not no_g and not no_e and g == e and gm == em
            out.append(_fields_equal(have, have if same else None if no_e else _value(e, em), kinds))
        return pa.array(out, pa.bool_())

    return walked(got, expected)


def json_equal(got: Column, expected: Column) -> Column:
    """TRUE if every field of the expected object is there, of the right kind and equal (both VARIANT).

    For expected objects that don't need a walk; ``with_json_equal`` takes any.
    """
    return F.coalesce(F.forall(
        field_pairs(got, typed_fields(expected)),
        lambda p: types_match(p["got"], p["want"]) & values_equal(p["got"], p["want"]),
    ), F.lit(False))


def with_json_equal(df: DataFrame, got: Column, expected: Column, name: str) -> DataFrame:
    """Add a column that is TRUE where two JSON objects (VARIANT) are equal in every expected field, at any depth.

    All rows take the walk over the values' bytes: it costs a fraction of ``json_equal``, whose lambdas are interpreted.
    """
    return df.withColumn(name, walked_equal(got, expected, kinds=True))
