"""Strict JSON over text columns, through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from negmine.functions.binding import let

# Texts may be of any length; only what the JSON standard allows is JSON.
_ANY_LENGTH = {"maxStringLen": str((1 << 31) - 1), "allowSingleQuotes": "false"}
_STRICT = {**_ANY_LENGTH, "allowNonNumericNumbers": "false"}


def _in_braces(t: Column, options: dict) -> Column:
    return F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "variant", options)


def strict_json(text: Column) -> Column:
    """The JSON value of the whole text as VARIANT, or NULL.

    The parser stops after the first value, so trailing characters would pass.
    Inside brackets only a value followed by ``]`` could still hide them, and
    inside braces only one followed by ``}``; demanding both leaves no gap.
    """
    def single(t: Column) -> Column:
        return let(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "variant", _STRICT), lambda v: F.when(
            (F.size(F.try_variant_get(v, "$", "array<variant>")) == 1) & _in_braces(t, _STRICT).isNotNull(),
            F.try_variant_get(v, "$[0]", "variant")))

    return let(text, single)


def strict_record(text: Column, schema: T.StructType) -> Column:
    """The one JSON object that the whole text is, as ``schema``; NULL for anything else.

    Two records on a line, trailing characters and repeated keys are no record.  NaN passes as a number.
    """
    def single(t: Column) -> Column:
        listed = F.from_json(F.concat(F.lit("["), t, F.lit("]")), T.ArrayType(schema), _ANY_LENGTH)
        return let(listed, lambda r: F.when(
            (F.size(r) == 1) & _in_braces(t, _ANY_LENGTH).isNotNull(), F.get(r, F.lit(0))))

    return let(text, single)


def record_with(text: Column, schema: T.StructType, key: str) -> Column:
    """``strict_record`` of an object that has ``key``, be its value null or not; NaN is no number here."""
    def single(t: Column) -> Column:
        listed = F.from_json(F.concat(F.lit("["), t, F.lit("]")), T.ArrayType(schema), _STRICT)
        both = F.struct(listed.alias("listed"), _in_braces(t, _STRICT).alias("braced"))
        return let(both, lambda b: F.when(
            (F.size(b["listed"]) == 1) & has_key(b["braced"], f"v.{key}"), F.get(b["listed"], F.lit(0))))

    return let(text, single)


def needed_record(text: Column, schema: T.StructType) -> Column:
    """``strict_record``, where a text that is no record stops the job."""
    start = F.substring(text, 1, 200)
    return let(strict_record(text, schema), lambda r: F.when(r.isNotNull(), r).otherwise(
        F.raise_error(F.concat(F.lit("malformed record: "), start))))


def variant_kind(value: Column) -> Column:
    """STRING, OBJECT, ARRAY, BIGINT, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def string_or_null(value: Column, path: str) -> Column:
    """A text member; NULL for numbers, lists and objects."""
    return let(F.try_variant_get(value, path, "variant"), lambda m: F.when(
        variant_kind(m) == "STRING", F.try_variant_get(m, "$", "string")))


def has_key(value: Column, key: str) -> Column:
    """Whether an object has the key, be its value null or not."""
    return F.try_variant_get(value, f"$.{key}", "variant").isNotNull()
