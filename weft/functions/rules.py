"""Fixed rule sets for the source and markup scans (our heuristics).

Patterns avoid ``\\b`` and ``\\s`` and use explicit ASCII classes, so the
JVM regex engine and RE2 (used by the SQL oracle) agree on every match.
"""

# Line rules for source text, in report order.
# (rule, category, severity, pattern)
SOURCE_RULES = [
    ("hardcoded_secret", "secret", "high",
     r"(?i)(^|[^A-Za-z0-9_])[A-Za-z0-9_]*(password|passwd|secret|token|api_?key|access_?key|private_?key)"
     r"[A-Za-z0-9_]*[ \t]*[:=][ \t]*[\"'][^\"'\n]{4,}[\"']"),
    ("sql_injection", "sql", "high",
     r"(?i)(execute|executemany|raw)[ \t]*\([ \t]*(f[\"']|[\"'][^\"']*[\"'][ \t]*(\+|%|\.format))"),
    ("command_injection", "command", "high",
     r"(os\.system|os\.popen|subprocess\.[A-Za-z_]+[ \t]*\([^)\n]*shell[ \t]*=[ \t]*True"
     r"|(^|[^A-Za-z0-9_.])(eval|exec)[ \t]*\()"),
]



def jvm(pattern: str) -> str:
    """The pattern for the JVM engine: ``(?d)`` makes ``\\n`` the only line
    terminator for ``^``/``$``/``.``, as in RE2 (the oracle's engine)."""
    return "(?d)" + pattern


def any_line_pattern(patterns) -> str:
    """One multiline pattern matching a text if any line could match one of
    ``patterns`` (a superset test used to skip texts before splitting)."""
    return "(?m)" + "|".join(f"(?:{p.replace('(?i)', '(?i:', 1) + ')' if p.startswith('(?i)') else p})"
                             for p in patterns)


# Line rules are not applied to whole-line comments.
COMMENT_LINE = r"^[ \t]*#"

# Literals a line must contain for each rule to match (any
# one of them, case as written) — a cheap substring guard before the regex.
RULE_GUARDS = {
    "hardcoded_secret": ["=", ":"],
    "sql_injection": ["("],
    "command_injection": ["os.system", "os.popen", "subprocess.", "eval", "exec"],
}

# Markup rules for raw pages. (rule, severity, pattern)
MARKUP_RULES = [
    ("inline_script", "low", r"(?i)<script"),
    ("event_handler_attribute", "medium", r"(?i)<[^>]+[ \t]on[a-z]+[ \t]*="),
    ("javascript_url", "medium", r"(?i)javascript:"),
    ("eval_call", "high", r"eval[ \t]*\("),
]

# Structure and complexity patterns.
DEF_PATTERN = r"(?m)^[ \t]*(async[ \t]+)?def[ \t]+[A-Za-z_][A-Za-z0-9_]*"
CLASS_PATTERN = r"(?m)^[ \t]*class[ \t]+[A-Za-z_][A-Za-z0-9_]*"
DEF_PARAMS_PATTERN = r"def[ \t]+[A-Za-z_][A-Za-z0-9_]*[ \t]*\(([^)]*)\)"
DECISION_KEYWORDS = ["if", "elif", "for", "while", "except", "and", "or", "case"]

# Score weights in half points (2.0 = 4 halves) and bands.
WEIGHT_HALVES = {"secret": 4, "sql": 4, "command": 4, "complexity_over_10": 2,
                 "complexity_over_20": 4, "smell": 1}
SIZE_UNIT = 100   # lines of text the penalties are weighed against
RATING_BANDS = [(8, "Excellent"), (6, "Good"), (4, "Fair")]
RATING_FLOOR = "Poor"
DEEP_NESTING_LEVEL = 4
LONG_PARAMETER_LIST = 6

# Recommendation texts, in report order.
RECOMMENDATIONS = [
    ("secret", "Move hard-coded secrets out of the source"),
    ("sql", "Use parameterized queries instead of string-built SQL"),
    ("command", "Avoid shell commands and eval/exec on untrusted input"),
    ("complexity", "Split complex code into smaller functions"),
    ("nesting", "Flatten deeply nested blocks"),
    ("params", "Group long parameter lists into objects"),
    ("magic", "Replace magic numbers with named constants"),
]
