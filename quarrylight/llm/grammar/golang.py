"""Grammar of Go, with generics."""

from __future__ import annotations

import re

from .base import Bad, Cursor, Tokens

SCAN = re.compile(
    r"(?P<space>[ \t\r]+|//[^\n]*)|(?P<line>\n)|(?P<block>/\*[\s\S]*?\*/)|(?P<n>[^\W\d]\w*)"
    r"|(?P<d>(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?)"
    r"|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<c>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(?P<p>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[+\-*/%&|^]=|[+\-*/%&|^<>=!()\[\]{},;.:~])"
)
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}


def lex(text: str) -> Tokens:
    t, at, n = Tokens(), 0, len(text)
    rows = t.rows

    def ends() -> bool:
        if not rows:
            return False
        k, v = rows[-1][:2]
        return k in "dsc" or (k == "n" and (v not in KEYWORDS or v in ("break", "continue", "fallthrough", "return"))) or v in ("++", "--", ")", "]", "}")

    while at < n:
        m = SCAN.match(text, at)
        if not m or m.end() == at:
            raise Bad(at, "unknown character, or a literal never closed")
        kind, end = m.lastgroup, m.end()
        if kind in ("line", "block"):
            if (kind == "line" or "\n" in m.group()) and ends():
                rows.append(("p", ";", at, at, False))
        elif kind != "space":
            if kind == "d" and re.match(r"\w", text[end : end + 1]):
                raise Bad(at, "bad number")
            rows.append((kind, m.group() if kind in "np" else None, at, end, False))
        at = end
    if ends():
        rows.append(("p", ";", n, n, False))
    return t.close(n)


class Source(Cursor):
    def __init__(self, t: Tokens):
        super().__init__(t)
        self.header = False  # in the head of if, for or switch, where { begins the block

    def semi(self) -> None:
        if not self.eat(";") and not self.at(")", "}") and self.k[self.i] != "e":
            self.fail("expected ;")

    def name(self) -> None:
        if self.k[self.i] != "n" or self.v[self.i] in KEYWORDS:
            self.fail("expected a name")
        self.i += 1

    def is_name(self, n: int = 0) -> bool:
        return self.k[self.i + n] == "n" and self.v[self.i + n] not in KEYWORDS

    def program(self) -> None:
        self.need("package")
        self.name()
        self.semi()
        while self.at("import"):
            self.i += 1
            self.group(self.import_spec)
            self.semi()
        while self.k[self.i] != "e":
            if self.at("func"):
                self.i += 1
                if self.at("("):
                    self.params()
                self.name()
                if self.at("["):
                    self.type_params()
                self.signature()
                if self.at("{"):
                    self.block()
            elif self.at("var", "const", "type"):
                self.declaration()
            else:
                self.fail("expected a declaration")
            self.semi()

    def group(self, one) -> None:
        if self.eat("("):
            while not self.eat(")"):
                one()
                self.semi()
        else:
            one()

    def import_spec(self) -> None:
        if self.is_name():
            self.i += 1
        else:
            self.eat(".")
        if self.k[self.i] != "s":
            self.fail("expected a path")
        self.i += 1

    def declaration(self) -> None:
        v = self.v[self.i]
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[v])

    def names(self) -> None:
        self.name()
        while self.eat(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.eat("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.peek() != "]" and not (self.k[self.i + 1] == "d"):
            if not self.tried(self.generic_spec):
                self.type()
            return
        self.eat("=")
        self.type()

    def generic_spec(self) -> None:
        self.type_params()
        self.type()

    def type_params(self) -> None:
        self.need("[")
        if self.at("]"):
            self.fail()
        self.listed("]", self.type_param)

    def type_param(self) -> None:
        self.names()
        self.constraint()

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def signature(self) -> None:
        self.params()
        if self.at("("):
            self.params()
        elif not self.at("{", ";", ")", "]", "}", ",", "=", ":=", ":", ".", "==") and self.k[self.i] not in "es":
            self.type()

    def params(self) -> None:
        """Either types alone, or names with types."""
        self.need("(")
        named = typed = 0
        while not self.eat(")"):
            if self.eat("..."):
                self.type()
                typed += 1
            else:
                self.type()
                if not self.at(",", ")"):
                    if self.k[self.i - 1] != "n":
                        self.fail()
                    self.eat("...")
                    self.type()
                    named += 1
            if not self.eat(","):
                self.need(")")
                break

    def type(self) -> None:
        v = self.v[self.i]
        if self.eat("*"):
            return self.type()
        if self.eat("("):
            self.type()
            return self.need(")")
        if self.eat("["):
            if self.eat("]"):
                return self.type()
            if not self.eat("..."):
                old, self.header = self.header, False
                self.expression()
                self.header = old
            self.need("]")
            return self.type()
        if v == "<-" and self.peek() == "chan":
            self.i += 2
            return self.type()
        if self.k[self.i] != "n":
            return self.fail("expected a type")
        if v == "chan":
            self.i += 1
            self.eat("<-")
            return self.type()
        if v == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            return self.type()
        if v == "func":
            self.i += 1
            return self.signature()
        if v == "struct":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.semi()
            return None
        if v == "interface":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if self.is_name() and self.peek() == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            return None
        self.name()
        while self.eat("."):
            self.name()
        if self.at("[") and self.peek() != "]":
            self.tried(self.instance)
        return None

    def instance(self) -> None:
        self.need("[")
        self.listed("]", self.type)

    def field(self) -> None:
        if self.at("*") or (self.is_name() and (self.peek() in (".", ";", "}") or self.k[self.i + 1] == "s")):
            self.type()
        else:
            self.names()
            self.type()
        if self.k[self.i] == "s":
            self.i += 1

    # -- statements

    def block(self) -> None:
        self.need("{")
        old, self.header = self.header, False
        self.statements("}")
        self.header = old
        self.need("}")

    def statements(self, *ends: str) -> None:
        while not self.at(*ends):
            if self.k[self.i] == "e":
                self.fail()
            self.statement()
            if not self.at(*ends):
                self.need(";")

    def statement(self) -> None:
        v = self.v[self.i]
        if self.k[self.i] == "n" and v in KEYWORDS:
            if v in ("var", "const", "type"):
                return self.declaration()
            if v in ("go", "defer"):
                self.i += 1
                if self.expression() != "call":
                    self.fail("expected a call")
                return None
            if v == "return":
                self.i += 1
                if not self.at(";", "}"):
                    self.expressions()
                return None
            if v in ("break", "continue", "goto"):
                self.i += 1
                if self.is_name():
                    self.i += 1
                return None
            if v == "fallthrough":
                self.i += 1
                return None
            if v == "if":
                return self.s_if()
            if v == "for":
                return self.s_for()
            if v == "switch":
                return self.s_switch()
            if v == "select":
                self.i += 1
                return self.cases(self.simple)
        if v == "{":
            return self.block()
        if v in (";", "}"):
            return None
        if self.is_name() and self.peek() == ":":
            self.i += 2
            return None if self.at("}") else self.statement()
        return self.simple()

    def simple(self, ranged: bool = False) -> None:
        if ranged and self.at("range"):
            self.i += 1
            self.expression()
            return
        kind = self.expressions()
        v = self.v[self.i]
        if v in ASSIGN:
            if kind in ("call", "val"):
                self.fail("bad assignment target")
            self.i += 1
            if ranged and self.at("range"):
                self.i += 1
                self.expression()
            else:
                self.expressions()
        elif v in ("++", "--"):
            self.i += 1
        elif v == "<-":
            self.i += 1
            self.expression()

    def head(self, f) -> None:
        old, self.header = self.header, True
        f()
        self.header = old

    def s_if(self) -> None:
        self.need("if")
        self.head(self.if_head)
        self.block()
        if self.eat("else"):
            if self.at("if"):
                self.s_if()
            else:
                self.block()

    def if_head(self) -> None:
        if self.at("{"):
            self.fail("expected a condition")
        if not self.at(";"):
            self.simple()
        if self.eat(";"):
            if self.at("{"):
                self.fail("expected a condition")
            self.simple()

    def s_for(self) -> None:
        self.need("for")
        self.head(self.for_head)
        self.block()

    def for_head(self) -> None:
        if self.at("{"):
            return
        if not self.at(";"):
            self.simple(ranged=True)
        if self.eat(";"):
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at("{"):
                self.simple()

    def s_switch(self) -> None:
        self.need("switch")
        self.head(self.switch_head)
        self.cases(self.case_list)

    def switch_head(self) -> None:
        if self.at("{"):
            return
        if not self.at(";"):
            self.simple()
        if self.eat(";") and not self.at("{"):
            self.simple()

    def cases(self, one) -> None:
        self.need("{")
        old, self.header = self.header, False
        while not self.eat("}"):
            if not self.eat("default"):
                self.need("case")
                one()
            self.need(":")
            self.statements("case", "default", "}")
        self.header = old

    def case_list(self) -> None:
        while True:
            if not self.tried(self.case_value):
                self.type()
            if not self.eat(","):
                return

    def case_value(self) -> None:
        self.expression()
        if not self.at(",", ":"):
            self.fail()

    # -- expressions; each returns "ref", "call", "val" or "type"

    def expressions(self) -> str:
        out = self.expression()
        while self.eat(","):
            self.expression()
        return out

    def expression(self, least: int = 0) -> str:
        kind = self.unary()
        while self.k[self.i] == "p" and (p := BINARY.get(self.v[self.i], 0)) > least:
            self.i += 1
            self.expression(p)
            kind = "val"
        return kind

    def unary(self) -> str:
        v = self.v[self.i]
        if v in ("+", "-", "!", "^", "&", "<-", "*") and self.k[self.i] == "p":
            if v == "<-" and self.peek() == "chan":
                self.type()
                return self.postfix("type")
            self.i += 1
            self.unary()
            return "ref" if v == "*" else "val"
        return self.postfix(self.operand())

    def operand(self) -> str:
        v, kind = self.v[self.i], self.k[self.i]
        if kind in "dsc":
            self.i += 1
            return "val"
        if v == "(":
            self.i += 1
            old, self.header = self.header, False
            if not self.tried(lambda: self.closed(self.expression)):
                self.closed(self.type)
            self.header = old
            return "ref"
        if v == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
                return "val"
            return "type"
        if v in ("[", "map", "chan", "struct", "interface"):
            self.type()
            return "type"
        self.name()
        return "ref"

    def closed(self, f) -> None:
        f()
        self.need(")")

    def postfix(self, kind: str) -> str:
        while self.k[self.i] == "p":
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    kind = "val"
                else:
                    self.name()
                    kind = "ref"
            elif v == "[" and kind != "type":
                old, self.header = self.header, False
                if not self.tried(self.index):
                    self.instance()
                self.header = old
                kind = "ref"
            elif v == "(":
                self.i += 1
                old, self.header = self.header, False
                self.listed(")", self.argument)
                self.header = old
                kind = "call"
            elif v == "{" and (kind == "type" or (kind == "ref" and not self.header)):
                self.literal()
                kind = "val"
            else:
                return kind
        return kind

    def index(self) -> None:
        self.need("[")
        parts = 0
        if not self.at(":"):
            self.expression()
        while self.eat(":"):
            parts += 1
            if not self.at(":", "]"):
                self.expression()
        if parts > 2:
            self.fail()
        self.need("]")

    def argument(self) -> None:
        if not self.tried(self.value_argument):
            self.type()

    def value_argument(self) -> None:
        self.expression()
        self.eat("...")
        if not self.at(",", ")"):
            self.fail()

    def literal(self) -> None:
        self.need("{")
        old, self.header = self.header, False
        while not self.eat("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                self.need("}")
                break
        self.header = old

    def element(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.expression()


def parse(text: str) -> None:
    """Raises Bad if the text is no valid source file."""
    Source(lex(text)).program()
