"""A lexer for source text as two regular expressions.

The first removes what is no code: triple-quoted, plain and escaped strings
become their opening quote, comments become ``#`` and a joined line's break
goes, so that nothing runs together and line beginnings stay what they are. The
second yields the code's tokens that measures need, in order: indentation of
lines with code, brackets, decision keywords and whole numbers. A string prefix
(``r``, ``b``, ``f``) stays as a name; an f-string counts as one string.

Each pattern has a form for the JVM engine (possessive, so that long strings
need no stack) and one for RE2, which the SQL oracle uses; both match the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import rules as R


def _jvm_string(q: str) -> str:
    return rf"({q}){q}{q}(?:[^{q}\\]|\\[\s\S]|{q}(?!{q}{q}))*+{q}{q}{q}"


def _jvm_plain(q: str) -> str:
    return rf"({q})[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+{q}"


NO_CODE_JVM = ("(?d)(?=[\"'#\\\\])(?:" + "|".join([
    _jvm_string('"'), _jvm_string("'"), _jvm_plain('"'), _jvm_plain("'"), r"(#)[^\n]*+", r"(\\)\r?\n"]) + ")")
NO_CODE_RE2 = "|".join(
    [rf"({q}){q}{q}(?:[^\\]|\\(?s:.))*?{q}{q}{q}" for q in "\"'"]
    + [rf"({q})(?:[^{q}\\\n]|\\(?s:.))*{q}" for q in "\"'"] + [r"(#)[^\n]*", r"(\\)\r?\n"])
KEPT_JVM, KEPT_RE2 = "".join(f"${i}" for i in range(1, 7)), "".join(f"\\{i}" for i in range(1, 7))

_KEYWORDS = "|".join(R.DECISION_KEYWORDS)
_FIRST = "".join(sorted({k[0] for k in R.DECISION_KEYWORDS}))
TOKEN_JVM = (rf"(?dm)(?=[ (){{}}\[\]0-9{_FIRST}])(?:^ ++(?![#\n]|\z)|[\[\](){{}}]"
             rf"|(?<![A-Za-z0-9_])(?:{_KEYWORDS})(?![A-Za-z0-9_])|(?<![A-Za-z0-9_.])[0-9]{{2,}}+(?![A-Za-z0-9_]))")
#: Indentation and brackets alone (an indentation that ends in # or a line break has no code after it).
LAYOUT_RE2 = r"(?m)^ +[#\n]|^ +|[\[\](){}]"

#: Import statements of code without strings (also in brackets over several lines).
IMPORT_STATEMENT = (r"(?m)(?:^|;)[ \t]*(?:import[ \t]+[^\n;#]+"
                    r"|from[ \t]+[A-Za-z0-9_. \t]*?[ \t.]import(?:[ \t]*\([^)]*\)|[ \t]+[^\n;#(]+))")


def code_of(text: Column) -> Column:
    """The text without the content of strings and comments."""
    return F.regexp_replace(text, NO_CODE_JVM, KEPT_JVM)


def tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKEN_JVM), 0)


def _first_between(t: Column, low: str, high: str) -> Column:
    return (t >= low) & (t < high)


def keyword_count(toks: Column) -> Column:
    return F.size(F.filter(toks, lambda t: _first_between(t, "a", "{")))


def number_count(toks: Column) -> Column:
    return F.size(F.filter(toks, lambda t: _first_between(t, "0", ":")))


def nesting(toks: Column) -> Column:
    """Deepest indentation (4 spaces a level) of a line with code that doesn't
    stand inside brackets: a fold over brackets and indentations."""
    layout = F.filter(toks, lambda t: ~_first_between(t, "a", "{") & ~_first_between(t, "0", ":"))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("deep"))

    def step(acc: Column, t: Column) -> Column:
        level = F.floor(F.length(t) / 4).cast("int")
        return F.struct(
            (acc["open"] + F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)).alias("open"),
            F.when(t.startswith(" ") & (acc["open"] <= 0), F.greatest(acc["deep"], level)).otherwise(acc["deep"]).alias("deep"))

    return F.aggregate(layout, start, step, lambda acc: acc["deep"])
