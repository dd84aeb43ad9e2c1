"""JSON functions: H5-H8 and H11.

JSON is kept as text in every public column; variants appear only inside expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON token patterns, applied to text Spark itself has rendered.
MARKER = r'(?<!\\)"__attachment__"\s*:\s*"((?:[^"\\]|\\.)*)"'
TOKEN = r'("(?:[^"\\]|\\.)*"\s*:?|-?\d[-+0-9.eE]*|true|false)'


def is_json(text: Column, parsed: Column | None = None) -> Column:
    """Whether the whole text is one JSON value; ``parsed`` is its variant if at hand.

    The variant parser is strict inside the value but ignores what follows it; wrapping the
    text in an array and in an object leaves no room for a second value.  The three parsers
    together accept exactly one complete value.
    """
    as_item = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    as_field = F.size(F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}")))) == 1
    parsed = F.try_parse_json(text) if parsed is None else parsed
    return F.coalesce(parsed.isNotNull() & as_item & as_field, F.lit(False))


def try_json(text: Column) -> Column:
    """H6: the text itself if it is valid JSON, else NULL."""
    return F.when(is_json(text), text)


def json_get(text: Column, path: str) -> Column:
    """H7: scalar at a JSON path as text; objects and arrays come back as JSON text."""
    return F.get_json_object(text, path)


def json_items(text: Column) -> Column:
    """H8: the items of a JSON array as an array of JSON texts, ready to ``explode``."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return F.transform(items, lambda item: F.to_json(item))


def _string_token(token: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(token), "$", "string")


def state_markers(json_text: Column) -> Column:
    """H5: every string held under an ``__attachment__`` key, at any depth.

    Rendering the parsed text again first removes ``\\u`` escapes in keys and yields NULL
    for invalid JSON, so one pattern over the rendered text is enough.
    """
    rendered = F.to_json(F.try_parse_json(json_text))
    raw = F.regexp_extract_all(rendered, F.lit(MARKER), F.lit(1))
    names = F.transform(raw, lambda t: _string_token(F.concat(F.lit('"'), t, F.lit('"'))))
    return F.coalesce(F.array_distinct(names), F.array().cast("array<string>"))


def _float_label(token: Column) -> Column:
    """A JSON number as label text: shortest digits, exponent form from 1e6 and below 1e-4."""
    value = token.cast("double")
    size = F.abs(value)
    java = size.cast("string")
    digits = F.regexp_replace(F.regexp_replace(java, r"E.*$|\.", ""), r"^0+|0+$", "")
    plain = F.regexp_replace(java, r"\.0$", "")
    # floor(log10) from Java's own rendering, which is exact where a logarithm is not.
    sci = F.regexp_extract(java, r"E(-?\d+)$", 1)
    whole = F.length(F.substring_index(java, ".", 1))
    exponent = F.when(sci != "", sci.try_cast("int")).otherwise(whole - 1)
    mantissa = F.concat(
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(""),
    )
    text = (
        F.when(size == 0, F.lit("0"))
        .when(size >= 1e6, F.concat(mantissa, F.lit("e+"), F.lpad(exponent.cast("string"), 2, "0")))
        .when(size < 1e-4, F.concat(mantissa, F.lit("e-"), F.lpad(F.abs(exponent).cast("string"), 2, "0")))
        .when(size < 1e-3, F.concat(F.lit("0.000"), digits))
        .otherwise(plain)
    )
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def _leaf_labels(json_text: Column) -> Column:
    """The non-empty scalars of a JSON value in order, object fields in key order."""
    tokens = F.regexp_extract_all(json_text, F.lit(TOKEN), F.lit(1))
    leaves = F.filter(tokens, lambda t: ~t.endswith(":"))
    labels = F.transform(
        leaves,
        lambda t: F.when(t.startswith('"'), _string_token(t))
        .when(t.isin("true", "false"), t)
        .otherwise(_float_label(t)),
    )
    return F.filter(labels, lambda t: t.isNotNull() & (t != ""))


def filter_labels(filters: Column) -> Column:
    """``key: label/label`` per filter, keys sorted, empty filters left out.

    A variant renders its object fields in key order, so the leaves of a nested list or of
    an id-to-label map come out in the order they are shown.
    """
    fields = F.try_variant_get(F.try_parse_json(filters), "$", "map<string,variant>")
    entries = F.array_sort(
        F.transform(
            F.map_entries(fields),
            lambda e: F.struct(
                e["key"].alias("key"),
                F.array_join(_leaf_labels(F.to_json(e["value"])), "/").alias("label"),
            ),
        )
    )
    shown = F.filter(entries, lambda e: e["label"] != "")
    return F.transform(shown, lambda e: F.concat(e["key"], F.lit(": "), e["label"]))
