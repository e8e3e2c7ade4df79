"""One pattern for a long list of names: the list as a prefix trie.

A regex engine tries the names of a plain alternation one after the other at every
place of a text; a trie decides by the next letter.  The pattern matches exactly
what the alternation in the list's order matches, names that begin other names
included: at a node, names that end there stand between the longer ones that come
before them in the list and those that come after.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence


def fold(letter: str) -> str:
    """The letter that stands for all that match it in any case."""
    low = letter.upper().lower()
    return low if len(low) == 1 else letter


def alternation(names: Sequence[str], escape: Callable[[str], str], icase: bool = False) -> str:
    """A pattern (without a group around it) for the names in their order; empty names are kept,
    repeated ones matter once."""
    key = (lambda x: "".join(map(fold, x))) if icase else (lambda x: x)
    seen, rest = set(), []
    for x in names:
        if key(x) not in seen:
            seen.add(key(x))
            rest.append((key(x), x))
    return _node(rest, 0, escape)


def _node(names: list[tuple[str, str]], depth: int, escape) -> str:
    """Names (key, spelling) that share their first ``depth`` letters."""
    stem = _shared(names, depth)
    if stem > depth:
        inner = _node(names, stem, escape)
        head = escape(names[0][1][depth:stem])
        return head + (f"(?:{inner})" if "|" in inner else inner)
    parts: list[str] = []
    block: dict[str, list] = {}

    def flush():
        parts.extend(_node(v, depth, escape) for v in block.values())
        block.clear()

    for k, x in names:
        if len(k) == depth:                       # ends here: after what came before, before what follows
            flush()
            parts.append("")
        else:
            block.setdefault(k[depth], []).append((k, x))
    flush()
    return "|".join(parts)


def _shared(names, depth: int) -> int:
    first = names[0][0]
    n = min(len(k) for k, _ in names)
    while depth < n and all(k[depth] == first[depth] for k, _ in names):
        depth += 1
    return depth
