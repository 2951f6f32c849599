"""Grammar of JavaScript (ES2022 modules and scripts) and, with ``types``, TypeScript."""

from __future__ import annotations

import re

from .base import Bad, Cursor, Tokens

SPACE = re.compile(r"(?:[ \t\f\v   -   　﻿]+|//[^\n\r  ]*)+")
BLOCK = re.compile(r"/\*[\s\S]*?\*/")
NAME = re.compile(r"#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|[‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
NUMBER = re.compile(r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)")
STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'")
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
PUNCT = re.compile(r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|<<|\*\*|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[+\-*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
#: After these words a slash begins a regular expression.
BEFORE_VALUE = set("return typeof case in of delete void throw new instanceof else do yield await extends default".split())
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, "<=": 8, "instanceof": 8, "in": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??="}


#: Space and comments, then one token. A slash that begins no comment is a sign here; whether it divides is told later.
SCAN = re.compile(
    rf"(?P<w>(?:[\n\r\u2028\u2029]|{SPACE.pattern}|{BLOCK.pattern})*)"
    rf"(?:(?P<n>{NAME.pattern})|(?P<d>{NUMBER.pattern})|(?P<s>{STRING.pattern})|(?P<t>`)|(?P<p>{PUNCT.pattern}))?"
)
BREAKS = re.compile(r"[\n\r\u2028\u2029]")


def template(text: str, at: int) -> tuple[list[Tokens], int]:
    """The parts within a template that begins at ``at``, and its end."""
    start, subs, n, at = at, [], len(text), at + 1
    while True:
        if at >= n:
            raise Bad(start, "template never closed")
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return subs, at + 1
        elif text.startswith("${", at):
            sub, at = lex(text, at + 2, inner=True)
            subs.append(sub)
        else:
            at += 1


def lex(text: str, at: int = 0, inner: bool = False) -> tuple[Tokens, int]:
    """Tokens from ``at`` to the end, or to the brace that ends a template's part."""
    t, n, depth = Tokens(), len(text), 0
    if at == 0 and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    value = False  # whether the last token ends a value, so that a slash divides
    rows, scan = t.rows, SCAN.match
    add = rows.append
    while at < n:
        m = scan(text, at)
        kind, begin, end = m.lastgroup, m.end("w"), m.end()
        nl = begin > at and BREAKS.search(text, at, begin) is not None
        if kind == "n":
            word = text[begin:end]
            add(("n", word, begin, end, nl))
            value = word not in BEFORE_VALUE or (len(rows) > 1 and rows[-2][1] in (".", "?."))
        elif kind == "p":
            p = text[begin:end]
            if p[0] == "/" and (not value or text.startswith("/*", begin)):
                if text.startswith("/*", begin):
                    raise Bad(begin, "comment never closed")
                if not (m := REGEX.match(text, begin)):
                    raise Bad(begin, "bad regular expression")
                end = m.end()
                add(("r", None, begin, end, nl))
                value = True
            else:
                if inner and p == "{":
                    depth += 1
                elif inner and p == "}":
                    if not depth:
                        return t.close(begin), begin + 1
                    depth -= 1
                add(("p", p, begin, end, nl))
                value = p in (")", "]") or (p in ("++", "--") and value)
        elif kind == "d":
            if end == begin or NAME.match(text, end) or text[end : end + 1].isdigit():
                raise Bad(begin, "bad number")
            add(("d", None, begin, end, nl))
            value = True
        elif kind == "s":
            add(("s", None, begin, end, nl))
            value = True
        elif kind == "t":
            subs, end = template(text, begin)
            t.sub[len(rows)] = subs
            add(("t", None, begin, end, nl))
            value = True
        elif begin < n:
            raise Bad(begin, "string never closed" if text[begin] in "\"'" else "unknown character")
        at = end
    if inner:
        raise Bad(at, "template never closed")
    return t.close(n), n


class Script(Cursor):
    def __init__(self, t: Tokens, types: bool):
        super().__init__(t)
        self.types = types
        self.fn, self.loop, self.switch, self.is_async, self.is_gen, self.no_in = 0, 0, 0, True, False, False
        self.cover: int | None = None
        self.ambient = False

    # -- statements

    def program(self) -> None:
        while self.k[self.i] != "e":
            self.statement(top=True)

    def semi(self) -> None:
        if self.cover is not None:
            self.fail("initializer outside a pattern")
        if not self.eat(";") and not (self.at("}") or self.k[self.i] == "e" or self.nl[self.i]):
            self.fail("expected ;")

    def name(self) -> None:
        w = self.v[self.i]
        if self.k[self.i] != "n" or w in RESERVED or w[0] == "#":
            self.fail("expected a name")
        self.i += 1

    def any_name(self) -> None:
        if self.k[self.i] != "n":
            self.fail("expected a name")
        self.i += 1

    def is_word(self, n: int = 0) -> bool:
        j = self.i + n
        return j < len(self.k) and self.k[j] == "n" and self.v[j] not in RESERVED

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def statement(self, top: bool = False) -> None:
        v, kind = self.v[self.i], self.k[self.i]
        if kind == "p":
            if v == "{":
                return self.block()
            if v == ";":
                self.i += 1
                return None
            if v == "@":
                self.decorators()
                return self.statement(top)
        if kind == "n":
            f = STATEMENTS.get(v)
            if f:
                return f(self)
            nxt, word_next = self.peek(), self.k[min(self.i + 1, len(self.k) - 1)] == "n" and not self.nl[min(self.i + 1, len(self.k) - 1)]
            if v == "let" and (word_next or nxt in ("[", "{")) and nxt not in ("in", "instanceof", "of"):
                return self.variables()
            if v == "async" and nxt == "function" and word_next:
                self.i += 1
                return self.function(declared=True, is_async=True)
            if v == "import" and nxt not in ("(", "."):
                return self.imports()
            if nxt == ":" and v not in RESERVED:
                self.i += 2
                return self.statement()
            if self.types and word_next or (self.types and v in ("module", "declare", "namespace") and self.k[self.i + 1] == "s"):
                if v == "interface":
                    self.i += 1
                    self.name()
                    self.type_params()
                    if self.eat("extends"):
                        self.type()
                        while self.eat(","):
                            self.type()
                    return self.object_type()
                if v == "type" and self.v[self.i + 2] in ("=", "<"):
                    self.i += 1
                    self.name()
                    self.type_params()
                    self.need("=")
                    self.type()
                    return self.semi()
                if v in ("namespace", "module"):
                    self.i += 1
                    if self.k[self.i] == "s":
                        self.i += 1
                        if not self.at("{"):
                            return self.semi()
                    else:
                        self.name()
                        while self.eat("."):
                            self.any_name()
                    return self.block()
                if v == "declare":
                    self.i += 1
                    old, self.ambient = self.ambient, True
                    if self.at("global") and self.peek() == "{":
                        self.i += 1
                        self.block()
                    else:
                        self.statement()
                    self.ambient = old
                    return None
                if v == "abstract" and nxt == "class":
                    self.i += 1
                    return self.klass(declared=True)
        self.expression()
        return self.semi()

    def variables(self, in_for: bool = False) -> None:
        constant = self.v[self.i] == "const"
        self.i += 1
        if constant and self.types and self.at("enum"):
            return self.enum()
        while True:
            plain = self.k[self.i] == "n"
            self.binding()
            if self.types:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            elif (constant or not plain) and not self.ambient and not (in_for and self.at("of", "in")):
                self.fail("expected a value")
            if not self.eat(","):
                break
        return None if in_for else self.semi()

    def binding(self) -> None:
        if self.at("["):
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.at("{"):
            self.i += 1
            self.listed("}", self.bound_property)
        else:
            self.name()

    def bound_property(self) -> None:
        if self.eat("..."):
            return self.binding()
        if self.is_word() and self.peek() != ":":
            self.name()
        else:
            self.key()
            self.need(":")
            self.binding()
        if self.eat("="):
            self.assignment()
        return None

    def params(self) -> None:
        self.need("(")
        self.listed(")", self.param)

    def param(self) -> None:
        self.decorators()
        if self.types:
            while self.at("public", "private", "protected", "readonly", "override") and self.k[self.i + 1] == "n":
                self.i += 1
        self.eat("...")
        if self.types and self.at("this"):
            self.i += 1
        else:
            self.binding()
        if self.types:
            self.eat("?")
            if self.eat(":"):
                self.type()
        if self.eat("="):
            self.assignment()

    def function(self, declared: bool = False, is_async: bool = False) -> None:
        self.need("function")
        gen = self.eat("*")
        if declared and not (self.at("(") and self.v[self.i - 2] == "default" or self.at("(") and self.v[self.i - 2] == "async" and self.v[self.i - 3] == "default"):
            self.name()
        elif self.is_word():
            self.name()
        self.callable(is_async, gen, bodiless=declared and self.types)

    def callable(self, is_async: bool = False, gen: bool = False, bodiless: bool = False) -> None:
        """Parameters, return type and body."""
        if self.types:
            self.type_params()
        old = self.is_async, self.is_gen
        self.is_async, self.is_gen = is_async, gen
        self.params()
        if self.types and self.eat(":"):
            self.return_type()
        self.is_async, self.is_gen = old
        if bodiless and not self.at("{"):
            return self.semi()
        return self.body(is_async, gen)

    def body(self, is_async: bool, gen: bool) -> None:
        old = self.fn, self.loop, self.switch, self.is_async, self.is_gen, self.no_in
        self.fn, self.loop, self.switch, self.is_async, self.is_gen, self.no_in = 1, 0, 0, is_async, gen, False
        self.block()
        self.fn, self.loop, self.switch, self.is_async, self.is_gen, self.no_in = old

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.i = self.t.pair[self.i] + 1
                continue
            self.any_name()
            while self.eat("."):
                self.any_name()
            if self.at("("):
                self.arguments()

    def klass(self, declared: bool = False) -> None:
        self.need("class")
        if self.is_word() and not self.at("implements"):
            self.name()
        elif declared and self.v[self.i - 2] != "default":
            self.fail("expected a name")
        if self.types:
            self.type_params()
        if self.eat("extends"):
            self.postfix()
            if self.types and self.at("<"):
                self.type_args()
        if self.types and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return None
        self.decorators()
        ends = ("(", "=", ";", "}", ",") + ((":", "<", "?", "!") if self.types else ())
        words = ("static",) + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.types else ())
        abstract = self.ambient
        while self.at(*words, "accessor") and self.peek() not in ends and not (self.nl[self.i + 1] and self.v[self.i] == "accessor"):
            if self.v[self.i] == "static" and self.peek() == "{":
                self.i += 1
                return self.body(False, False)
            abstract = abstract or self.v[self.i] in ("abstract", "declare")
            self.i += 1
        if self.types and self.at("[") and self.peek(2) == ":":
            self.i += 1
            self.name()
            self.need(":")
            self.type()
            self.need("]")
            if self.eat(":"):
                self.type()
            return self.semi()
        is_async = gen = False
        if self.at("async") and self.peek() not in ends and not self.nl[self.i + 1]:
            self.i += 1
            is_async = True
        if self.eat("*"):
            gen = True
        if self.at("get", "set") and self.peek() not in ends:
            self.i += 1
        self.key()
        if self.types:
            self.eat("?") or self.eat("!")
        if self.at("(", "<") and (self.v[self.i] == "(" or self.types):
            return self.callable(is_async, gen, bodiless=self.types)
        if self.types and self.eat(":"):
            self.type()
        if self.eat("="):
            old, self.fn = self.fn, 1
            self.assignment()
            self.fn = old
        return self.semi()

    def key(self) -> None:
        if self.k[self.i] in "nsd":
            self.i += 1
        elif self.eat("["):
            self.assignment()
            self.need("]")
        else:
            self.fail("expected a property name")

    def s_if(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        old, self.no_in = self.no_in, False
        self.expression()
        self.no_in = old
        self.need(")")

    def looped(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def s_while(self) -> None:
        self.i += 1
        self.paren()
        self.looped()

    def s_do(self) -> None:
        self.i += 1
        self.looped()
        self.need("while")
        self.paren()
        self.eat(";")

    def s_for(self) -> None:
        self.i += 1
        if self.at("await"):
            self.i += 1
        self.need("(")
        self.no_in = True
        if self.at("var", "const") or (self.at("let") and (self.k[self.i + 1] == "n" or self.peek() in ("[", "{"))):
            self.variables(in_for=True)
        elif not self.at(";"):
            self.expression()
        self.no_in = False
        if self.at("of", "in"):
            self.cover = None
            self.i += 1
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.looped()

    def s_return(self) -> None:
        if not self.fn:
            self.fail("return outside a function")
        self.i += 1
        if not (self.at(";", "}") or self.nl[self.i] or self.k[self.i] == "e"):
            self.expression()
        self.semi()

    def s_jump(self) -> None:
        what = self.v[self.i]
        self.i += 1
        if self.is_word() and not self.nl[self.i]:
            self.i += 1
        elif not self.loop and not (what == "break" and self.switch):
            self.fail(f"{what} outside a loop")
        self.semi()

    def s_throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            self.fail()
        self.expression()
        self.semi()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        some = False
        if self.eat("catch"):
            some = True
            if self.eat("("):
                self.binding()
                if self.types and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            self.fail("expected catch or finally")

    def s_switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        self.switch += 1
        while not self.eat("}"):
            if self.eat("default"):
                self.need(":")
            else:
                self.need("case")
                self.expression()
                self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()
        self.switch -= 1

    def s_debugger(self) -> None:
        self.i += 1
        self.semi()

    def s_with(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    def string(self) -> None:
        if self.k[self.i] != "s":
            self.fail("expected a string")
        self.i += 1

    def imports(self) -> None:
        self.i += 1
        if self.k[self.i] != "s":
            if self.types and self.at("type") and self.peek() not in ("from", ",", "=") or (self.types and self.at("type") and self.peek() == "from" and self.peek(2) == "from"):
                self.i += 1
            if self.is_word():
                self.name()
                if self.types and self.eat("="):
                    self.expression()
                    return self.semi()
                if not self.eat(","):
                    self.need("from")
                    self.string()
                    return self.import_end()
            if self.eat("*"):
                self.need("as")
                self.name()
            else:
                self.need("{")
                self.listed("}", self.specifier)
            self.need("from")
        self.string()
        return self.import_end()

    def import_end(self) -> None:
        if self.at("with", "assert") and self.peek() == "{":
            self.i += 1
            self.object()
        self.semi()

    def specifier(self) -> None:
        if self.types and self.at("type") and self.peek() not in (",", "}", "as"):
            self.i += 1
        if self.k[self.i] not in "ns":
            self.fail("expected a name")
        self.i += 1
        if self.eat("as"):
            if self.k[self.i] not in "ns":
                self.fail("expected a name")
            self.i += 1

    def s_export(self) -> None:
        self.i += 1
        if self.eat("default"):
            self.decorators()
            if self.at("function"):
                return self.function(declared=True)
            if self.at("async") and self.peek() == "function":
                self.i += 1
                return self.function(declared=True, is_async=True)
            if self.at("class"):
                return self.klass(declared=True)
            if self.types and self.at("abstract") and self.peek() == "class":
                self.i += 1
                return self.klass(declared=True)
            if self.types and self.at("interface"):
                return self.statement()
            self.assignment()
            return self.semi()
        if self.types:
            if self.eat("="):
                self.expression()
                return self.semi()
            if self.at("as") and self.peek() == "namespace":
                self.i += 2
                self.name()
                return self.semi()
            if self.at("type") and self.peek() in ("{", "*"):
                self.i += 1
        if self.eat("*"):
            if self.eat("as"):
                self.i += 1
            self.need("from")
            self.string()
            return self.import_end()
        if self.eat("{"):
            self.listed("}", self.specifier)
            if self.eat("from"):
                self.string()
                return self.import_end()
            return self.semi()
        words = ("var", "let", "const", "function", "class", "async", "@")
        if self.at(*words) or (self.types and self.at("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import")):
            if self.at("async") and self.peek() != "function":
                self.fail()
            return self.statement()
        return self.fail("bad export")

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        self.listed("}", self.enum_member)

    def enum_member(self) -> None:
        self.key()
        if self.eat("="):
            self.assignment()

    def s_enum(self) -> None:
        if not self.types:
            self.fail()
        self.enum()

    def s_function(self) -> None:
        self.function(declared=True)

    def s_class(self) -> None:
        self.klass(declared=True)

    # -- expressions; each returns "ref", "pat" or "val"

    def expression(self) -> str:
        out = self.assignment()
        while self.eat(","):
            out = self.assignment()
            out = "val"
        return out

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        i = self.i
        is_async = self.at("async") and not self.nl[i + 1] and (self.v[i + 1] == "(" or self.k[i + 1] == "n" and self.v[i + 1] not in RESERVED or self.types and self.v[i + 1] == "<")
        j = i + 1 if is_async else i
        if self.k[j] == "n" and self.v[j] not in RESERVED and j + 1 < len(self.v) and self.v[j + 1] == "=>":
            self.i = j + 2
            self.arrow_body(is_async)
            return True
        if self.v[j] == "(":
            after = self.t.pair[j] + 1
            if self.v[after] == "=>" or (self.types and self.v[after] == ":"):
                return self.tried(lambda: self.arrow_rest(j, is_async)) if self.v[after] == ":" else (self.arrow_rest(j, is_async) or True)
        elif self.types and self.v[j] == "<":
            return self.tried(lambda: self.arrow_rest(j, is_async))
        return False

    def arrow_rest(self, j: int, is_async: bool) -> None:
        self.i = j
        if self.types:
            self.type_params()
        self.params()
        if self.types and self.eat(":"):
            self.return_type()
        self.need("=>")
        self.arrow_body(is_async)

    def arrow_body(self, is_async: bool) -> None:
        if self.at("{"):
            self.body(is_async, False)
        else:
            old, self.is_async = (self.is_async, self.fn), is_async
            self.assignment()
            self.is_async = old[0]

    def assignment(self) -> str:
        if self.at("(", "async", "<") or (self.k[self.i] == "n" and self.peek() == "=>"):
            if self.arrow():
                return "val"
        if self.is_gen and self.at("yield"):
            self.i += 1
            if not (self.at(")", "]", "}", ",", ";", ":") or self.nl[self.i] or self.k[self.i] == "e"):
                self.eat("*")
                self.assignment()
            return "val"
        was, self.cover = self.cover, None
        kind = self.conditional()
        v = self.v[self.i]
        op = v if v in ASSIGN else (self.angle()[0] if v == ">" and self.angle()[0] in (">>=", ">>>=") else None)
        if op:
            if kind == "val" or (op != "=" and kind != "ref"):
                self.fail("bad assignment target")
            self.cover = None
            self.i += 1 if v in ASSIGN else len(op)
            self.assignment()
            kind = "val"
        if was is not None:
            self.cover = was
        return kind

    def angle(self) -> tuple[str, int]:
        """The operator that begins with > here, and its tokens."""
        op, n = ">", 1
        while n < 3 and self.t.val[self.i + n] == ">" and self.touching(n):
            op, n = op + ">", n + 1
        j = self.i + n
        if self.t.val[j] in ("=", "==", "=>") and self.touching(n) and self.t.val[j] == "=":
            op, n = op + "=", n + 1
        return op, n

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.at("?"):
            self.i += 1
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.need(":")
            self.assignment()
            return "val"
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary()
        while True:
            v = self.v[self.i]
            if v is None:
                return kind
            n = 1
            if v == ">":
                op, n = self.angle()
                if op in (">>=", ">>>="):
                    return kind
                p = 8 if op in (">", ">=") else 9
            elif v in ("in", "instanceof") and self.k[self.i] == "n":
                p = 8
                if v == "in" and self.no_in:
                    return kind
            elif self.types and v in ("as", "satisfies") and not self.nl[self.i]:
                if 8 <= least:
                    return kind
                self.i += 1
                if self.at("const"):
                    self.i += 1
                else:
                    self.type()
                continue
            else:
                p = BINARY.get(v, 0) if self.k[self.i] == "p" else 0
            if not p or p <= least:
                return kind
            self.i += n
            self.binary(p - 1 if v == "**" else p)
            kind = "val"

    def unary(self) -> str:
        v, kind = self.v[self.i], self.k[self.i]
        if kind == "p" and v in ("!", "~", "+", "-"):
            self.i += 1
            self.unary()
            return "val"
        if kind == "p" and v in ("++", "--"):
            self.i += 1
            if self.unary() != "ref":
                self.fail("bad operand")
            return "val"
        if kind == "n" and (v in ("typeof", "void", "delete") or (v == "await" and self.is_async and self.peek() not in (")", ",", ";", "=", ".", "]"))):
            self.i += 1
            self.unary()
            return "val"
        if self.types and v == "<":
            i = self.i
            self.i += 1
            if self.at("const"):
                self.i += 1
            else:
                self.type()
            if not self.eat(">"):
                self.i = i
                self.fail()
            self.unary()
            return "val"
        out = self.postfix()
        if self.at("++", "--") and not self.nl[self.i]:
            if out != "ref":
                self.fail("bad operand")
            self.i += 1
            return "val"
        return out

    def arguments(self) -> None:
        self.need("(")
        old, self.no_in = self.no_in, False
        self.listed(")", self.spread)
        self.no_in = old

    def spread(self) -> None:
        self.eat("...")
        self.assignment()

    def template(self) -> None:
        for sub in self.t.sub.get(self.i, []):
            p = Script(sub, self.types)
            p.fn, p.is_async, p.is_gen = self.fn, self.is_async, self.is_gen
            p.expression()
            if p.k[p.i] != "e":
                raise Bad(self.t.start[self.i], "bad template")
        self.i += 1

    def postfix(self) -> str:
        kind = self.primary()
        while True:
            v = self.v[self.i]
            if self.k[self.i] == "t":
                self.template()
                kind = "val"
            elif self.k[self.i] != "p":
                return kind
            elif v == ".":
                self.i += 1
                self.any_name()
                kind = "ref"
            elif v == "?.":
                self.i += 1
                if self.at("("):
                    self.arguments()
                elif self.at("["):
                    self.i += 1
                    self.expression()
                    self.need("]")
                elif self.types and self.at("<"):
                    self.type_args()
                    self.arguments()
                else:
                    self.any_name()
                kind = "val"
            elif v == "[":
                self.i += 1
                old, self.no_in = self.no_in, False
                self.expression()
                self.no_in = old
                self.need("]")
                kind = "ref"
            elif v == "(":
                self.arguments()
                kind = "val"
            elif self.types and v == "!" and not self.nl[self.i]:
                self.i += 1
            elif self.types and v == "<" and self.tried(self.generic_call):
                kind = "val"
            else:
                return kind

    def generic_call(self) -> None:
        self.type_args()
        if not (self.at("(") or self.k[self.i] == "t"):
            self.fail()

    def primary(self) -> str:
        v, kind = self.v[self.i], self.k[self.i]
        if kind in "dsr":
            self.i += 1
            return "val"
        if kind == "t":
            self.template()
            return "val"
        if kind == "n":
            if v == "function":
                self.function()
                return "val"
            if v == "async" and self.peek() == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function(is_async=True)
                return "val"
            if v == "class":
                self.klass()
                return "val"
            if v == "new":
                self.i += 1
                if self.eat("."):
                    self.any_name()
                    return "val"
                self.new_target()
                if self.at("("):
                    self.arguments()
                return "val"
            if v in ("this", "null", "true", "false"):
                self.i += 1
                return "val"
            if v == "super" and self.peek() in (".", "(", "["):
                self.i += 1
                return "val"
            if v == "import" and self.peek() in ("(", "."):
                self.i += 1
                if self.eat("."):
                    self.any_name()
                return "val"
            if v[0] == "#" and self.peek() == "in":
                self.i += 1
                return "val"
            self.name()
            return "ref"
        if v == "(":
            self.i += 1
            old, self.no_in = self.no_in, False
            out = self.expression()
            self.no_in = old
            self.need(")")
            return "ref" if out == "ref" else "val"
        if v == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.spread()
                if not self.at("]"):
                    self.need(",")
            return "pat"
        if v == "{":
            self.object()
            return "pat"
        if v == "@":
            self.decorators()
            self.klass()
            return "val"
        return self.fail()

    def new_target(self) -> None:
        if self.eat("new"):
            self.new_target()
            if self.at("("):
                self.arguments()
        else:
            if self.at("import"):
                self.fail()
            self.primary()
        while True:
            if self.eat("."):
                self.any_name()
            elif self.at("["):
                self.i += 1
                self.expression()
                self.need("]")
            elif self.k[self.i] == "t":
                self.template()
            elif self.types and self.at("<") and self.tried(self.type_args):
                pass
            else:
                return

    def object(self) -> None:
        self.need("{")
        old, self.no_in = self.no_in, False
        self.listed("}", self.property)
        self.no_in = old

    def property(self) -> None:
        if self.eat("..."):
            self.assignment()
            return None
        ends = ("(", ":", ",", "}", "=") + (("<",) if self.types else ())
        is_async = gen = False
        if self.at("async") and self.peek() not in ends and not self.nl[self.i + 1]:
            self.i += 1
            is_async = True
        if self.eat("*"):
            gen = True
        if self.at("get", "set") and self.peek() not in ends:
            self.i += 1
            self.key()
            return self.callable()
        shorthand = self.is_word()
        start = self.i
        self.key()
        if self.at("(") or (self.types and self.at("<")):
            return self.callable(is_async, gen)
        if is_async or gen:
            self.fail()
        if self.eat(":"):
            self.assignment()
            return None
        if not shorthand or self.k[start] != "n":
            self.fail("expected :")
        if self.at("="):
            at = self.i
            self.i += 1
            self.assignment()
            self.cover = at
        return None

    # -- types

    def type_params(self) -> None:
        if self.types and self.at("<"):
            self.i += 1
            if self.at(">"):
                self.fail()
            self.listed(">", self.type_param)

    def type_param(self) -> None:
        while self.at("const", "in", "out") and self.k[self.i + 1] == "n":
            self.i += 1
        self.name()
        if self.eat("extends"):
            self.type()
        if self.eat("="):
            self.type()

    def type_args(self) -> None:
        self.need("<")
        self.listed(">", self.type)

    def return_type(self) -> None:
        if self.at("asserts") and self.k[self.i + 1] == "n" and self.peek() != "is":
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if self.k[self.i] == "n" and self.peek() == "is" and not self.nl[self.i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        if self.at("abstract") and self.peek() == "new":
            self.i += 1
        if self.eat("new"):
            return self.function_type()
        if self.at("<") or (self.at("(") and self.v[self.t.pair[self.i] + 1] == "=>"):
            return self.function_type()
        self.union_type()
        if self.at("extends") and not self.nl[self.i]:
            self.i += 1
            self.union_type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()
        return None

    def function_type(self) -> None:
        self.type_params()
        self.params()
        self.need("=>")
        self.return_type()

    def union_type(self) -> None:
        self.eat("|") or self.eat("&")
        while True:
            self.array_type()
            if not (self.eat("|") or self.eat("&")):
                return

    def array_type(self) -> None:
        while self.at("keyof", "unique", "readonly", "infer") and (self.k[self.i + 1] in "nst" or self.peek() in ("(", "[", "{")):
            self.i += 1
        self.primary_type()
        while self.at("[") and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def primary_type(self) -> None:
        v, kind = self.v[self.i], self.k[self.i]
        if kind in "sd":
            self.i += 1
        elif kind == "t":
            self.i += 1
        elif v == "-" and self.k[self.i + 1] == "d":
            self.i += 2
        elif v == "(":
            if self.v[self.t.pair[self.i] + 1] == "=>":
                return self.function_type()
            self.i += 1
            self.type()
            self.need(")")
        elif v == "[":
            self.i += 1
            self.listed("]", self.tuple_item)
        elif v == "{":
            self.object_type()
        elif kind == "n":
            if v == "typeof":
                self.i += 1
            elif v == "import" and self.peek() == "(":
                self.i += 1
                self.i = self.t.pair[self.i] + 1
                while self.eat("."):
                    self.any_name()
                if self.at("<"):
                    self.type_args()
                return None
            elif v in RESERVED and v not in ("void", "null", "this", "true", "false"):
                self.fail("bad type")
            self.any_name()
            while self.eat("."):
                self.any_name()
            if self.at("<") and not self.nl[self.i]:
                self.type_args()
        else:
            self.fail("bad type")
        return None

    def tuple_item(self) -> None:
        self.eat("...")
        if self.k[self.i] == "n" and (self.peek() == ":" or (self.peek() == "?" and self.peek(2) == ":")):
            self.i += 1
            self.eat("?")
            self.need(":")
        self.type()
        self.eat("?")

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.at("-", "+") and self.peek() == "readonly":
                self.i += 1
            if self.at("readonly") and self.peek() not in (":", "?", "(", ";", ",", "}"):
                self.i += 1
            if self.at("get", "set") and self.peek() not in (":", "?", "(", "<", ";", ",", "}"):
                self.i += 1
            if self.at("(", "<"):
                self.signature()
            elif self.at("new") and self.peek() in ("(", "<"):
                self.i += 1
                self.signature()
            elif self.at("[") and self.k[self.i + 1] == "n" and self.peek(2) in ("in", ":"):
                self.i += 2
                self.i += 1
                self.type()
                if self.eat("as"):
                    self.type()
                self.need("]")
                if self.at("-", "+"):
                    self.i += 1
                self.eat("?")
                if self.eat(":"):
                    self.type()
            else:
                self.key()
                self.eat("?")
                if self.at("(", "<"):
                    self.signature()
                elif self.eat(":"):
                    self.type()
            if not (self.eat(";") or self.eat(",")) and not self.at("}") and not self.nl[self.i]:
                self.fail("expected ;")

    def signature(self) -> None:
        self.type_params()
        self.params()
        if self.eat(":"):
            self.return_type()


STATEMENTS = {
    "if": Script.s_if, "for": Script.s_for, "while": Script.s_while, "do": Script.s_do, "return": Script.s_return, "break": Script.s_jump, "continue": Script.s_jump, "throw": Script.s_throw, "try": Script.s_try, "switch": Script.s_switch, "debugger": Script.s_debugger,
    "with": Script.s_with, "export": Script.s_export, "enum": Script.s_enum, "function": Script.s_function, "class": Script.s_class, "var": Script.variables, "const": Script.variables,
}


def parse(text: str, types: bool) -> None:
    """Raises Bad if the text is no valid script."""
    Script(lex(text)[0], types).program()
