"""What the documentation of a symbol says, and whether it says anything.

The symbols themselves, with their leading comments, come from ``corpusgate.sources.sourcecode``.
"""

from __future__ import annotations

import re

# Words that say nothing by themselves.
SMALL_WORDS = frozenset(
    "a an the this that these those it its and or but nor so if then else of to in on at by for from with without as into onto over under out up off per via about"
    " is are was were be been being has have had do does did not no will would can could may might shall should must i you he she we they them his her our your their"
    " what which who when where while there here than too also just".split()
)
# Texts that stand where documentation is still to be written.
PLACEHOLDERS = re.compile(
    r"(?i)^\W*(?:todo|fixme|xxx|tbd|wip|n/?a|none|placeholder|summary|docs?|undocumented|no-?op|see (?:above|below|code|docs?)|description goes here|missing (?:description|docs?)"
    r"|add (?:docs?|description)|document(?: this| me)?|no (?:docs?|description)|(?:todo|fixme|xxx)\b.*)\W*$"
)
_DIRECTIVE = re.compile(
    r"(?i)^(?:go:\w+|nolint\b|lint:\w+|\+build\b|export \w+$|line \S+:\d+|eslint\b|eslint-|tslint:|prettier-ignore|@ts-|istanbul\b|c8 ignore|v8 ignore|jshint\b|jslint\b|global \w|noqa\b|type:\s*ignore|pylint:|pragma\b|mypy:|ruff:|flake8:|isort:|fmt:|yapf:|coverage:|webpack\w*:|@flow\b|@jsx|sourcery\b|biome-ignore|deno-|swiftlint|sonar|nosec\b|nosonar\b)"
)
_TAG = re.compile(r"(?i)^(?:@\w+|\{@\w+[^}]*\}|:(?:param|type|returns?|rtype|raises?|arg|key|var|ivar|cvar|keyword|yields?|deprecated)\b[^:]*:|deprecated:|\.\. \w+::)")
_SECTION = re.compile(r"(?i)^(?:args|arguments|parameters|params|returns?|yields?|raises|attributes|examples?|notes?|see also|todo)\s*:?\s*$")
_CODE = re.compile(
    r":=|^\}|\{$|^(?:func|def|class|return|if|for|while|import|from|const|let|var|function|export|async|package|type|switch|case|try|else|elif|with|raise|throw|await|print|defer|go)\b.*[({:;=\[]|^[\w.\[\]]+\s*(?:[-+*/|&]?=)\s*\S|^[\w.]+\([^)]*\)\s*[;{]?$|^(?:break|continue|pass|return)\s*;?$|=>\s*\{?$|\)\s*;$|^@\w+(?:\(.*\))?$|^</?\w+.*>$"
)


def comment_lines(doc: str) -> list[str]:
    """The text of a documentation comment by lines, without the language's comment signs."""
    out = []
    for line in doc.replace("\r", "").split("\n"):
        line = line.strip()
        line = re.sub(r"^(?:/\*+!?|//+[/!]?|\*+(?!/)|#+!?)\s?|\s*\*+/$", "", line)
        out.append(re.sub(r"^\*+/$|\s*\*+/$", "", line).rstrip())
    return out


def described(doc: str) -> str:
    """What describes the symbol: without tags and their texts, directives, commented-out code and placeholders."""
    kept, in_tag = [], False
    for raw in comment_lines(doc):
        line = raw.strip()
        if not line:
            in_tag = False
            continue
        if _DIRECTIVE.match(line):
            continue
        if _TAG.match(line):
            rest = re.sub(r"(?i)^(?:@(?:summary|description|desc|remarks)\b:?\s*)", "", line)
            in_tag = rest == line
            if not in_tag:
                kept.append(rest)
            continue
        if _SECTION.match(line) or re.fullmatch(r"[-=~*_]{3,}", line):
            in_tag = bool(_SECTION.match(line)) or in_tag
            continue
        if in_tag or _CODE.search(line) or PLACEHOLDERS.match(line):
            continue
        kept.append(line)
    text = "\n".join(kept).strip()
    return "" if PLACEHOLDERS.match(text) else text


def _name_words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)}


_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?")


def tells(text: str, name: str, least: int = 5) -> bool:
    """Whether ``least`` words are left that are neither small words nor words of the symbol's own name, in any ending."""
    own, whole, n = _name_words(name), name.lower().strip("_"), 0
    stems = tuple((o[: max(3, len(o) - 1)], len(o) + 3) for o in own if len(o) > 2)
    for m in _WORD.finditer(text):
        low = m.group().lower()
        if low in SMALL_WORDS or low in own or low.strip("_") == whole or low in ("function", "method"):
            continue
        for stem, most in stems:
            if len(low) <= most and low.startswith(stem):
                break
        else:
            n += 1
            if n == least:
                return True
    return n >= least


def is_trivial(doc: str, name: str, least: int = 5) -> bool:
    """Whether fewer than ``least`` telling words are left of the documentation."""
    return not tells(described(doc), name, least)
