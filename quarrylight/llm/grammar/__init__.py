"""Grammars of six languages: whether a text is valid syntax, and of which language."""

from __future__ import annotations

import ast
import re
import sys
import warnings

from . import golang, java, javascript, rust
from .base import Bad

#: The language that an extension stands for.
EXTENSIONS = {"py": "python", "ts": "typescript", "js": "javascript", "rs": "rust", "go": "go", "java": "java"}
LANGUAGES = tuple(EXTENSIONS.values())

#: Tokens that speak for a language: pattern and weight, for the ranking alone.
SIGNS = {
    "python": [(r"^\s*def \w+\(.*:\s*$", 4), (r"^\s*(?:elif|except|with|class|if|for|while)\b.*:\s*$", 2), (r"^\s*from [\w.]+ import ", 4), (r"\bself\.", 1), (r"^\s*#", 1)],
    "typescript": [(r"\b(?:const|let|var) \w+: ", 4), (r"^\s*(?:export )?(?:interface|type) \w+", 4), (r"\w+\??: (?:string|number|boolean|unknown|void)\b", 3), (r" as [A-Za-z]", 1), (r"^import type ", 4), (r"=>", 1)],
    "javascript": [(r"\b(?:const|let|var) \w+ = ", 2), (r"=>", 1), (r"\bfunction\b", 2), (r"^import .* from ['\"]", 2), (r"===", 2), (r"^\s*//", 1)],
    "rust": [(r"\bfn \w+", 4), (r"\blet (?:mut )?\w+", 2), (r"^use [\w:]+", 3), (r"\bimpl\b", 3), (r"::", 1), (r"\bpub\b", 2)],
    "go": [(r"^package \w+\s*$", 5), (r"^func ", 4), (r":=", 2), (r"\bnil\b", 2), (r"^import \"", 3)],
    "java": [(r"^package [\w.]+;", 5), (r"\b(?:public|private|protected) (?:static |final )*[\w<>]+ \w+", 4), (r"^import [\w.*]+;", 3), (r"@Override", 3)],
}
_SIGNS = {k: [(re.compile(p, re.MULTILINE), w) for p, w in v] for k, v in SIGNS.items()}


def language_of(path: str | None) -> str | None:
    """The language of a path's extension, in any case; null without one."""
    if not path:
        return None
    name = path.rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[1].lower()) if "." in name else None


def python(text: str) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        raise Bad(max(0, (e.lineno or 1) - 1), e.msg or "") from None
    except ValueError as e:
        raise Bad(0, str(e)) from None


PARSERS = {
    "python": python, "typescript": lambda t: javascript.parse(t, True), "javascript": lambda t: javascript.parse(t, False), "rust": rust.parse, "go": golang.parse, "java": java.parse,
}


def clean(text: str) -> str:
    """Without the byte order mark."""
    return text[1:] if text[:1] == "﻿" else text


#: Frames of a parse, and of a second one of a text that is nested deeper: some hundred MB of memory at most.
FRAMES, MOST_FRAMES = 8_000, 1_000_000
TOO_DEEP = "nested too deeply"
SIGNS_IN_A_ROW = re.compile(r"[-+~](?:[ \t]*[-+~])+")


def deep(language: str, text: str) -> None:
    """A second parse of a text that is nested deeper than ``FRAMES``; a text that passes this too is a fault of its own."""
    old = sys.getrecursionlimit()
    try:
        if language == "python":
            # the language's own parser refuses so deep a text; long rows of signs before a value are as valid as one
            text = SIGNS_IN_A_ROW.sub("-", text)
        sys.setrecursionlimit(max(old, MOST_FRAMES))
        PARSERS[language](text)
    except (RecursionError, MemoryError) as e:
        if isinstance(e, MemoryError) and "stack" not in str(e).lower():
            raise
        raise Bad(0, TOO_DEEP) from None
    finally:
        sys.setrecursionlimit(old)


def fault(language: str, text: str) -> str | None:
    """Null if the text is valid syntax of the language, else what is wrong.

    A text nested deeper than ``FRAMES`` frames is parsed again with more; one that passes ``MOST_FRAMES`` can't be told
    and is given as ``TOO_DEEP``, never as valid. A worker that lacks memory fails its task, it doesn't judge.
    """
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    text = clean(text)
    try:
        try:
            PARSERS[language](text)
        except RecursionError:
            deep(language, text)
        except MemoryError as e:
            if "stack" not in str(e).lower():
                raise
            deep(language, text)
    except Bad as e:
        return e.what or "invalid syntax"
    return None


def ranked(text: str) -> list[str]:
    """All languages, the likeliest by its tokens first."""
    score = {k: sum(w * min(20, len(p.findall(text))) for p, w in v) for k, v in _SIGNS.items()}
    return sorted(LANGUAGES, key=lambda k: (-score[k], k))


def foreign(language: str, text: str) -> str | None:
    """The first other language, by rank, in which a text without success in its own parses."""
    return next((k for k in ranked(clean(text)) if k != language and fault(k, text) is None), None)
