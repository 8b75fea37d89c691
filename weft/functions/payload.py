"""Event payloads with any keys.

A payload travels as JSON text and is read as a VARIANT, so unknown and nested
keys stay: :func:`parsed` parses it, :func:`field` takes a typed value with a
default, ``to_json`` writes it whole. :func:`python_text` prints the text the way
Python prints a dictionary, in the keys' own order (a VARIANT sorts its keys).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The payload as a VARIANT; null if it isn't JSON."""
    return F.try_parse_json(text)


def field(payload: Column, path: str, kind: str, default=None) -> Column:
    """The value at a JSON path as a type; ``default`` where it is missing, null
    or of another kind."""
    value = F.try_variant_get(payload, path, kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def _unescaped(piece: Column) -> Column:
    """A JSON escape as Python prints the character (inside quotes)."""
    code = F.regexp_replace(piece, r"\\u", "")
    return (F.when(piece.isin('\\"', "\\/"), F.substring(piece, 2, 1))
            .when(piece == "\\b", "\\x08").when(piece == "\\f", "\\x0c")
            .when(piece.startswith("\\u00") & (F.length(piece) == 6) & (F.substring(piece, 5, 1).isin("0", "1")),
                  F.concat(F.lit("\\x"), F.lower(F.substring(piece, 5, 2))))
            .when(piece.startswith("\\u"), F.decode(F.unhex(code), "UTF-16BE"))
            .otherwise(piece))


def _string(token: Column) -> Column:
    """A JSON string as Python prints it: in single quotes, in double ones if it has
    single quotes only."""
    pieces = F.regexp_extract_all(F.substr(token, F.lit(2), F.length(token) - 2), F.lit(r"(?s)\\u00[01][0-9A-Fa-f]|(?:\\u(?!00[01])[0-9A-Fa-f]{4})+|\\.|[^\\]+"), 0)
    body = F.array_join(F.transform(pieces, _unescaped), "")
    plain = F.array_join(F.filter(pieces, lambda p: ~p.startswith("\\") | (p == '\\"')), "")
    double = F.contains(body, F.lit("'")) & ~F.contains(plain, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))) \
            .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def python_text(text: Column) -> Column:
    """A JSON document as Python prints it (numbers as they are written)."""
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"|[^"]+'), 0)

    def other(t: Column) -> Column:
        t = F.regexp_replace(t, r"\s+", "")
        for word, shown in (("true", "True"), ("false", "False"), ("null", "None")):
            t = F.replace(t, F.lit(word), F.lit(shown))
        return F.replace(F.replace(t, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))

    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), _string(t)).otherwise(other(t))), "")
