"""Grammar of Java 21."""

from __future__ import annotations

import re

from .base import Bad, Cursor, Tokens

SCAN = re.compile(
    r"(?P<space>(?:[ \t\r\n\f]+|//[^\n\r]*|/\*[\s\S]*?\*/)*)(?:(?P<n>[^\W\d]\w*|\$\w*)"
    r"|(?P<d>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?)"
    r"|(?P<s>\"\"\"[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\"|\"(?:[^\"\\\n\r]|\\.)*\")|(?P<c>'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)')"
    r"|(?P<p>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|[+\-*/%&|^]=|[+\-*/%&|^<>=!~?:()\[\]{},;.@]))?"
)
PRIMITIVE = {"int", "long", "short", "byte", "char", "boolean", "float", "double"}
KEYWORDS = PRIMITIVE | set(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
MODIFIERS = set("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, "<=": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="}


def lex(text: str) -> Tokens:
    t, at, n = Tokens(), 0, len(text.rstrip("\x1a"))
    scan, add = SCAN.match, t.rows.append
    while at < n:
        m = scan(text, at)
        kind, begin, end = m.lastgroup, m.end("space"), m.end()
        if begin >= n:
            break
        if end == begin or text.startswith("/*", begin):
            raise Bad(begin, "unknown character, or a literal never closed")
        if kind == "d" and re.match(r"[\w$]", text[end : end + 1]):
            raise Bad(begin, "bad number")
        add((kind, text[begin:end] if kind in "np" else None, begin, end, False))
        at = end
    return t.close(n)


class Unit(Cursor):
    def name(self) -> None:
        if self.k[self.i] != "n" or self.v[self.i] in KEYWORDS:
            self.fail("expected a name")
        self.i += 1

    def is_name(self, n: int = 0) -> bool:
        j = self.i + n
        return j < len(self.k) and self.k[j] == "n" and self.v[j] not in KEYWORDS

    def dotted(self) -> None:
        self.name()
        while self.at(".") and self.is_name(1):
            self.i += 2

    def program(self) -> None:
        start = self.i
        self.annotations()
        if self.eat("package"):
            self.dotted()
            self.need(";")
        else:
            self.i = start
        while self.at("import", ";"):
            if self.eat(";"):
                continue
            self.i += 1
            self.eat("static")
            self.dotted()
            if self.eat("."):
                self.need("*")
            self.need(";")
        while self.k[self.i] != "e":
            if self.eat(";"):
                continue
            if self.at("module", "open") and self.is_name(1):
                self.eat("open")
                self.need("module")
                self.dotted()
                self.i = self.t.pair[self.i] + 1 if self.at("{") else self.fail()
                continue
            self.modifiers()
            if not self.type_declaration():
                self.fail("expected a type")

    def annotations(self) -> None:
        while self.at("@") and self.peek() != "interface":
            self.i += 1
            self.dotted()
            if self.at("("):
                self.i += 1
                self.listed(")", self.annotation_value)

    def annotation_value(self) -> None:
        if self.is_name() and self.peek() == "=":
            self.i += 2
        self.element_value()

    def element_value(self) -> None:
        if self.at("{"):
            self.i += 1
            self.listed("}", self.element_value)
        elif self.at("@"):
            self.annotations()
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek() != "interface":
                self.annotations()
            elif self.at("non") and self.peek() == "-" and self.peek(2) == "sealed":
                self.i += 3
            elif self.v[self.i] in MODIFIERS and not (self.at("sealed") and self.peek() in ("(", "=", ".", ";")) and not (self.at("default") and self.peek() in (":", "->")) and not (self.at("synchronized") and self.peek() == "("):
                self.i += 1
            else:
                return

    def type_declaration(self) -> bool:
        v = self.v[self.i]
        if v == "class":
            self.i += 1
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.type()
            self.supers()
            self.body()
        elif v == "interface" or (v == "@" and self.peek() == "interface"):
            self.i += 1 if v == "interface" else 2
            self.name()
            self.type_params()
            if self.eat("extends"):
                self.types()
            self.supers()
            self.body()
        elif v == "enum":
            self.i += 1
            self.name()
            self.supers()
            self.enum_body()
        elif v == "record" and self.is_name(1) and self.peek(2) in ("(", "<"):
            self.i += 1
            self.name()
            self.type_params()
            self.params()
            self.supers()
            self.body()
        else:
            return False
        return True

    def supers(self) -> None:
        while self.at("implements", "permits"):
            self.i += 1
            self.types()

    def types(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    def enum_body(self) -> None:
        self.need("{")
        while not self.at(";", "}"):
            self.annotations()
            self.name()
            if self.at("("):
                self.arguments()
            if self.at("{"):
                self.body()
            if not self.eat(","):
                break
        if self.eat(";"):
            self.members()
        self.need("}")

    def body(self) -> None:
        self.need("{")
        self.members()
        self.need("}")

    def members(self) -> None:
        while not self.at("}"):
            if self.k[self.i] == "e":
                self.fail()
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return None
        if self.at("{") or (self.at("static") and self.peek() == "{"):
            self.eat("static")
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        self.type_params()
        self.annotations()
        if self.is_name() and self.peek() == "(":  # constructor
            self.i += 1
            return self.method()
        if self.is_name() and self.peek() == "{":  # compact constructor of a record
            self.i += 1
            return self.block()
        if not self.eat("void"):
            self.type()
        self.name()
        if self.at("("):
            return self.method()
        self.declarators()
        return self.need(";")

    def method(self) -> None:
        self.params()
        self.dims()
        if self.eat("throws"):
            self.types()
        if self.eat("default"):
            self.element_value()
        if not self.eat(";"):
            self.block()

    def params(self) -> None:
        self.need("(")
        if self.eat(")"):
            return
        while True:
            self.modifiers()
            self.type()
            self.annotations()
            self.eat("...")
            if self.at("this"):
                self.i += 1
            else:
                self.name()
                if self.eat("."):
                    self.need("this")
            self.dims()
            if not self.eat(","):
                break
        self.need(")")

    def dims(self) -> None:
        while self.at("[") and self.peek() == "]":
            self.i += 2

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.at("{"):
            self.i += 1
            self.listed("}", self.initializer)
        else:
            self.expression()

    def type_params(self) -> None:
        if self.at("<"):
            self.i += 1
            while True:
                self.annotations()
                self.name()
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def type_args(self) -> None:
        self.need("<")
        if self.eat(">"):
            return
        while True:
            self.annotations()
            if self.eat("?"):
                if self.eat("extends") or self.eat("super"):
                    self.type()
            else:
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def type(self) -> None:
        self.annotations()
        if self.v[self.i] in PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.name()
                if self.at("<"):
                    self.type_args()
                if not (self.at(".") and (self.is_name(1) or self.peek() == "@")):
                    break
                self.i += 1
                self.annotations()
        self.annotations()
        self.dims()

    # -- statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.block_statement()

    def block_statement(self) -> None:
        v = self.v[self.i]
        start = self.i
        if v == "yield" and self.peek() not in ("=", ".", "(", "++", "--", "["):
            return self.statement()
        if v in MODIFIERS or v in ("@", "class", "interface", "enum", "record", "non"):
            self.modifiers()
            if self.type_declaration():
                return None
            if self.i == start and v not in ("record", "sealed", "non"):
                return self.statement()
        if (self.v[self.i] in PRIMITIVE or self.is_name()) and self.tried(self.local):
            return None
        if self.i != start:
            self.fail("expected a declaration")
        return self.statement()

    def local(self) -> None:
        self.type()
        self.name()
        if not self.at("=", ";", ",", "["):
            self.fail()
        self.declarators()
        self.need(";")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        v = self.v[self.i]
        if v == "{":
            return self.block()
        if self.eat(";"):
            return None
        if self.k[self.i] == "n":
            if v == "if":
                self.i += 1
                self.paren()
                self.statement()
                if self.eat("else"):
                    self.statement()
                return None
            if v == "while":
                self.i += 1
                self.paren()
                return self.statement()
            if v == "do":
                self.i += 1
                self.statement()
                self.need("while")
                self.paren()
                return self.need(";")
            if v == "for":
                return self.s_for()
            if v == "try":
                return self.s_try()
            if v == "switch":
                self.i += 1
                self.paren()
                return self.switch_body()
            if v == "synchronized":
                self.i += 1
                self.paren()
                return self.block()
            if v == "return":
                self.i += 1
                if not self.at(";"):
                    self.expression()
                return self.need(";")
            if v in ("throw", "yield") and not (v == "yield" and self.peek() in ("=", ".", "(", "++", "--", "[")):
                self.i += 1
                self.expression()
                return self.need(";")
            if v in ("break", "continue"):
                self.i += 1
                if self.is_name():
                    self.i += 1
                return self.need(";")
            if v == "assert":
                self.i += 1
                self.expression()
                if self.eat(":"):
                    self.expression()
                return self.need(";")
            if self.is_name() and self.peek() == ":":
                self.i += 2
                return self.statement()
        if self.expression() != "do":
            self.fail("not a statement")
        return self.need(";")

    def s_for(self) -> None:
        self.i += 1
        self.need("(")
        if self.tried(self.each):
            pass
        else:
            if not self.at(";"):
                start = self.i
                self.modifiers()
                if not self.tried(self.local_head):
                    if self.i != start:
                        self.fail()
                    self.expressions()
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expressions()
            self.need(")")
        self.statement()

    def each(self) -> None:
        self.modifiers()
        self.type()
        self.name()
        self.need(":")
        self.expression()
        self.need(")")

    def local_head(self) -> None:
        self.type()
        self.name()
        self.declarators()
        if not self.at(";"):
            self.fail()

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def s_try(self) -> None:
        self.i += 1
        some = False
        if self.eat("("):
            some = True
            while not self.eat(")"):
                self.modifiers()
                if not self.tried(self.resource):
                    self.expression()
                if not self.eat(";"):
                    self.need(")")
                    break
        self.block()
        while self.eat("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            self.fail("expected catch or finally")

    def resource(self) -> None:
        self.type()
        self.name()
        self.need("=")
        self.expression()

    def switch_body(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if not self.eat("default"):
                self.need("case")
                while True:
                    if not self.eat("default") and not self.tried(self.pattern_label):
                        self.ternary()
                    if not self.eat(","):
                        break
                if self.at("when"):
                    self.i += 1
                    self.expression()
            if self.eat("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    self.block_statement()

    def pattern_label(self) -> None:
        self.pattern()
        if not self.at(":", "->", ",", "when"):
            self.fail()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.at("("):
            self.i += 1
            self.listed(")", self.pattern)
            if self.is_name() and not self.at("when"):
                self.i += 1
        else:
            self.name()

    # -- expressions; each returns "do" if it may be a statement, "ref" if it may be assigned, else "val"

    def expression(self) -> str:
        if self.lambda_here():
            return "val"
        kind = self.ternary()
        v = self.v[self.i]
        n = self.shift_assign() if v == ">" else 1
        if v in ASSIGN or (v == ">" and n):
            if kind != "ref":
                self.fail("bad assignment target")
            self.i += n
            if self.at("{"):
                self.fail()
            self.expression()
            return "do"
        return kind

    def shift_assign(self) -> int:
        if self.peek() == ">" and self.touching(2):
            if self.peek(2) == "=":
                return 3
            if self.peek(2) == ">" and self.peek(3) == "=" and self.touching(3):
                return 4
            if self.peek(2) == "==":
                return 0
        return 0

    def lambda_here(self) -> bool:
        if self.is_name() and self.peek() == "->":
            self.i += 2
        elif self.at("(") and self.v[self.t.pair[self.i] + 1] == "->":
            if not self.tried(self.name_list):
                self.params()
            self.need("->")
        else:
            return False
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return True

    def name_list(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.name()
            if not self.eat(","):
                self.need(")")
                break

    def ternary(self) -> str:
        kind = self.binary(0)
        if self.eat("?"):
            if not self.lambda_here():
                self.ternary_part()
            self.need(":")
            if not self.lambda_here():
                self.ternary()
            return "val"
        return kind

    def ternary_part(self) -> None:
        self.expression()

    def binary(self, least: int) -> str:
        kind = self.unary()
        while True:
            v, n = self.v[self.i], 1
            if v == "instanceof" and least < 7:
                self.i += 1
                if not self.tried(self.pattern):
                    self.modifiers()
                    self.type()
                kind = "val"
                continue
            if v == ">":
                if self.shift_assign():
                    return kind
                p = 7
                if self.peek() == "=" and self.touching(1):
                    n = 2
                elif self.peek() == ">" and self.touching(1):
                    p, n = 8, 2
                    if self.peek(2) == ">" and self.touching(2):
                        n = 3
            else:
                p = BINARY.get(v, 0) if self.k[self.i] == "p" else 0
            if not p or p <= least:
                return kind
            self.i += n
            self.binary(p)
            kind = "val"

    def unary(self) -> str:
        v = self.v[self.i]
        if self.k[self.i] == "p":
            if v in ("++", "--"):
                self.i += 1
                self.unary()
                return "do"
            if v in ("+", "-", "!", "~"):
                self.i += 1
                self.unary()
                return "val"
            if v == "(" and self.tried(self.cast):
                return "val"
        kind = self.postfix()
        while self.at("++", "--"):
            if kind != "ref":
                self.fail("bad operand")
            self.i += 1
            kind = "do"
        return kind

    def cast(self) -> None:
        self.need("(")
        primitive = self.v[self.i] in PRIMITIVE
        self.type()
        simple = primitive and self.v[self.i - 1] in PRIMITIVE
        while self.eat("&"):
            self.type()
        self.need(")")
        if not simple and (self.k[self.i] == "e" or (self.k[self.i] == "p" and not self.at("(", "!", "~")) or self.at("instanceof")):
            self.fail()
        if not self.lambda_here():
            self.unary()

    def arguments(self) -> None:
        self.need("(")
        if self.eat(")"):
            return
        self.expressions()
        self.need(")")

    def postfix(self) -> str:
        kind = self.primary()
        while self.k[self.i] == "p":
            if self.at("."):
                self.i += 1
                if self.at("<"):
                    self.type_args()
                if self.at("new"):
                    kind = self.creation()
                    continue
                if self.at("class", "this", "super"):
                    self.i += 1
                    kind = "val"
                    if self.at("("):
                        self.arguments()
                        kind = "do"
                    continue
                self.name()
                kind = "ref"
                if self.at("("):
                    self.arguments()
                    kind = "do"
            elif self.at("["):
                if self.peek() == "]":
                    self.dims()
                    if not self.at("::"):
                        self.need(".")
                        self.need("class")
                    kind = "val"
                    continue
                self.i += 1
                self.expression()
                self.need("]")
                kind = "ref"
            elif self.eat("::"):
                if self.at("<"):
                    self.type_args()
                if not self.eat("new"):
                    self.name()
                kind = "val"
            elif self.at("<") and kind == "ref" and self.tried(self.generic_reference):
                kind = "val"
            else:
                return kind
        return kind

    def generic_reference(self) -> None:
        self.type_args()
        self.dims()
        if not self.at("::"):
            self.fail()

    def creation(self) -> str:
        self.need("new")
        self.annotations()
        if self.v[self.i] in PRIMITIVE:
            self.i += 1
        else:
            if self.at("<"):
                self.type_args()
            while True:
                self.name()
                if self.at("<"):
                    self.type_args()
                if not self.eat("."):
                    break
        if self.at("["):
            if self.peek() == "]":
                self.dims()
                self.initializer() if self.at("{") else self.fail()
            else:
                while self.at("[") and self.peek() != "]":
                    self.i += 1
                    self.expression()
                    self.need("]")
                self.dims()
            return "val"
        self.arguments()
        if self.at("{"):
            self.body()
        return "do"

    def primary(self) -> str:
        v, kind = self.v[self.i], self.k[self.i]
        if kind in "dsc":
            self.i += 1
            return "val"
        if v == "(":
            self.i += 1
            out = self.expression()
            self.need(")")
            return "ref" if out == "ref" else "val"
        if kind == "n":
            if v in ("true", "false", "null"):
                self.i += 1
                return "val"
            if v in ("this", "super"):
                self.i += 1
                if self.at("("):
                    self.arguments()
                    return "do"
                if v == "super" and not self.at(".", "::"):
                    self.fail()
                return "val"
            if v == "new":
                return self.creation()
            if v == "switch":
                self.i += 1
                self.paren()
                self.switch_body()
                return "val"
            if v in PRIMITIVE or v == "void":
                self.i += 1
                self.dims()
                if not self.at("::"):
                    self.need(".")
                    self.need("class")
                return "val"
            self.name()
            if self.at("("):
                self.arguments()
                return "do"
            return "ref"
        return self.fail()


def parse(text: str) -> None:
    """Raises Bad if the text is no valid compilation unit."""
    Unit(lex(text)).program()
