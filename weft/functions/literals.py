"""Literals that a regular expression can't match without.

Walks the parsed pattern: of a sequence the best of its parts counts, of an
alternation one literal per branch is needed, a repeated part counts if it must
occur at least once. Case-insensitive patterns give lower-case literals, to be
looked for in lower-case text.
"""

from __future__ import annotations

import re
from re import _constants as k, _parser as parser


def needed(pattern: str) -> tuple[list[str], bool] | None:
    """(literals of which one must occur, whether case is ignored), or None if there is no such set.

    Ignoring case also covers patterns that do so in a part only. Letters whose
    lower case is not one ASCII character are never used then."""
    tree = parser.parse(pattern)
    fold = bool(tree.state.flags & re.IGNORECASE) or _folds(tree)
    found = _of(list(tree), fold)
    return (sorted(set(found)), fold) if found else None


def _folds(items) -> bool:
    for op, arg in items:
        if op is k.SUBPATTERN and (arg[1] & re.IGNORECASE or _folds(arg[3])):
            return True
        if op is k.BRANCH and any(_folds(b) for b in arg[1]):
            return True
        if op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and _folds(arg[2]):
            return True
        if op is k.ATOMIC_GROUP and _folds(arg):
            return True
    return False


def _score(words: list[str]) -> tuple[int, int]:
    return min(map(len, words)), -len(words)


def _of(items: list, fold: bool) -> list[str] | None:
    best, run = None, ""

    def offer(words: list[str] | None) -> None:
        nonlocal best
        if words and all(words) and (best is None or _score(words) > _score(best)):
            best = words

    for op, arg in items:
        if op is k.LITERAL and (not fold or arg < 128):
            run += chr(arg).lower() if fold else chr(arg)
            continue
        offer([run])
        run = ""
        if op is k.SUBPATTERN:
            offer(_of(list(arg[3]), fold))
        elif op is k.ATOMIC_GROUP:
            offer(_of(list(arg), fold))
        elif op is k.BRANCH:
            each = [_of(list(b), fold) for b in arg[1]]
            offer([w for ws in each for w in ws] if all(each) else None)
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT) and arg[0] > 0:
            offer(_of(list(arg[2]), fold))
    offer([run])
    return best
