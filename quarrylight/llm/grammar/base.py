"""What the parsers share: token lists, bracket pairs and a cursor."""

from __future__ import annotations

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Bad(Exception):
    """The text is no valid syntax; holds the offset."""

    def __init__(self, at: int, what: str = ""):
        super().__init__(what)
        self.at, self.what = at, what


class Tokens:
    """Tokens as rows while they come (kind, value of names and signs alone, start, end, newline before), then by column."""

    __slots__ = ("end", "kind", "nl", "pair", "rows", "start", "sub", "val")

    def __init__(self) -> None:
        self.rows: list[tuple[str, str | None, int, int, bool]] = []
        self.sub: dict[int, list[Tokens]] = {}
        self.pair: dict[int, int] = {}

    def close(self, at: int) -> Tokens:
        """End the list: an end token, and brackets matched."""
        self.rows.append(("e", None, at, at, True))
        self.kind, self.val, self.start, self.end, self.nl = zip(*self.rows)
        self.rows = []
        stack: list[tuple[str, int]] = []
        for i, (k, v) in enumerate(zip(self.kind, self.val)):
            if k != "p":
                continue
            if v in OPEN:
                stack.append((OPEN[v], i))
            elif v in CLOSE:
                if not stack or stack[-1][0] != v:
                    raise Bad(self.start[i], f"unmatched {v}")
                self.pair[stack.pop()[1]] = i
        if stack:
            raise Bad(self.start[stack[-1][1]], "bracket never closed")
        return self


class Cursor:
    """A place in a token list."""

    def __init__(self, t: Tokens):
        self.t, self.i = t, 0
        self.k, self.v, self.nl = t.kind, t.val, t.nl

    def fail(self, what: str = "unexpected token"):
        raise Bad(self.t.start[self.i], what)

    def at(self, *vals: str) -> bool:
        return self.v[self.i] in vals

    def eat(self, val: str) -> bool:
        if self.v[self.i] == val:
            self.i += 1
            return True
        return False

    def need(self, val: str) -> None:
        if self.v[self.i] != val:
            self.fail(f"expected {val}")
        self.i += 1

    def peek(self, n: int = 1) -> str | None:
        j = self.i + n
        return self.v[j] if j < len(self.v) else None

    def touching(self, n: int = 1) -> bool:
        """Whether the next n tokens follow without space."""
        t, i = self.t, self.i
        return i + n < len(self.v) and all(t.end[j] == t.start[j + 1] for j in range(i, i + n))

    def tried(self, f) -> bool:
        """Run f; on failure go back."""
        i = self.i
        try:
            f()
            return True
        except Bad:
            self.i = i
            return False

    def listed(self, close: str, one, sep: str = ",") -> None:
        """Items up to a closing sign, the last separator optional; eats the sign."""
        while not self.eat(close):
            one()
            if not self.eat(sep):
                self.need(close)
                return
