"""Grammar of Rust (edition 2021)."""

from __future__ import annotations

import re

from .base import Bad, Cursor, Tokens

SCAN = re.compile(
    r"(?P<space>(?:[\s​‎‏]+|//[^\n]*)*)(?:(?P<open>/\*)|(?P<raw>(?:b|c)?r(?P<hash>#*)\"[\s\S]*?\"(?P=hash))|(?P<s>[bc]?\"(?:[^\"\\]|\\[\s\S])*\")"
    r"|(?P<c>b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')|(?P<l>'[^\W\d]\w*(?!'))|(?P<n>r#[^\W\d]\w*|[^\W\d]\w*)"
    r"|(?P<d>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu]\w+)?|0o[0-7_]+(?:[iu]\w+)?|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?)"
    r"|(?P<p>\.\.\.|\.\.=|\.\.|<<=|::|->|=>|==|!=|<=|&&|\|\||<<|[+\-*/%^&|]=|[+\-*/%^&|!<>=@.,;:#$?~()\[\]{}]))?"
)
KEYWORDS = set("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split())
PATH_WORDS = {"self", "Self", "super", "crate"}
BINARY = {"||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, "|": 5, "^": 6, "&": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<="}
EDGE = re.compile(r"/\*|\*/")


def lex(text: str) -> Tokens:
    t, at, n = Tokens(), 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else n
    scan, add = SCAN.match, t.rows.append
    while at < n:
        m = scan(text, at)
        kind, begin, end = m.lastgroup, m.end("space"), m.end()
        if begin >= n:
            break
        if end == begin:
            raise Bad(begin, "unknown character, or a literal never closed")
        if kind == "open":
            depth = 1
            while depth:
                e = EDGE.search(text, end)
                if not e:
                    raise Bad(begin, "comment never closed")
                depth += 1 if e.group() == "/*" else -1
                end = e.end()
        elif kind in "npl":
            add((kind, text[begin:end], begin, end, False))
        else:
            if kind == "d" and re.match(r"[^\W\d]", text[end : end + 1]):
                raise Bad(begin, "bad number")
            add(("s" if kind in ("raw", "hash") else kind, None, begin, end, False))
        at = end
    return t.close(n)


class Crate(Cursor):
    def __init__(self, t: Tokens):
        super().__init__(t)
        self.no_struct = False

    def name(self) -> None:
        if self.k[self.i] != "n" or self.v[self.i] in KEYWORDS:
            self.fail("expected a name")
        self.i += 1

    def is_name(self, n: int = 0) -> bool:
        j = self.i + n
        return j < len(self.k) and self.k[j] == "n" and self.v[j] not in KEYWORDS

    def tree(self) -> None:
        """Any bracketed tokens."""
        if not self.at("(", "[", "{"):
            self.fail("expected a bracket")
        self.i = self.t.pair[self.i] + 1

    def attributes(self, inner: bool = False) -> None:
        while self.at("#") and (self.peek() == "[" or (inner and self.peek() == "!" and self.peek(2) == "[")):
            self.i += 1
            self.eat("!")
            self.tree()

    def program(self) -> None:
        self.attributes(inner=True)
        while self.k[self.i] != "e":
            if not self.item():
                self.fail("expected an item")

    def visibility(self) -> None:
        if self.eat("pub") and self.at("(") and self.peek() in ("crate", "self", "super", "in"):
            self.tree()

    def item(self) -> bool:
        start = self.i
        self.attributes()
        self.visibility()
        v, nxt = self.v[self.i], self.peek()
        if self.k[self.i] != "n":
            self.i = start
            return False
        if v == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif v == "mod" or (v == "unsafe" and nxt == "mod"):
            self.eat("unsafe")
            self.i += 1
            self.name()
            if not self.eat(";"):
                self.need("{")
                self.attributes(inner=True)
                while not self.eat("}"):
                    if not self.item():
                        self.fail("expected an item")
        elif v == "struct" or (v == "union" and self.is_name(1)):
            self.i += 1
            self.name()
            self.generics()
            self.where()
            if self.at("("):
                self.i += 1
                self.listed(")", self.tuple_field)
                self.where()
                self.need(";")
            elif not self.eat(";"):
                self.need("{")
                self.listed("}", self.field)
        elif v == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            self.listed("}", self.variant)
        elif v == "type":
            self.alias()
        elif v in ("static",) or (v == "const" and nxt not in ("fn", "unsafe", "async", "extern", "{")):
            self.i += 1
            self.eat("mut")
            if not self.eat("_"):
                self.name()
            self.need(":")
            self.type()
            if self.eat("="):
                self.expression()
            self.need(";")
        elif v == "trait" or (v in ("unsafe", "auto") and nxt in ("trait", "auto")):
            while self.at("unsafe", "auto"):
                self.i += 1
            self.need("trait")
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.bounds()
                self.need(";")
            else:
                self.associated()
        elif v == "impl" or (v == "unsafe" and nxt == "impl") or (v == "default" and nxt in ("impl", "unsafe")):
            while self.at("unsafe", "default"):
                self.i += 1
            self.i += 1
            if self.at("<"):
                self.tried(self.generics)
            if self.at("const"):
                self.i += 1
            self.eat("!")
            self.type()
            if self.eat("for"):
                self.type()
            self.where()
            self.associated()
        elif v == "extern" and (nxt == "crate" or self.k[self.i + 1] == "s" and self.peek(2) == "{" or nxt == "{"):
            self.i += 1
            if self.eat("crate"):
                self.i += 1
                if self.eat("as"):
                    self.i += 1
                self.need(";")
            else:
                if self.k[self.i] == "s":
                    self.i += 1
                self.associated()
        elif v == "macro_rules" and nxt == "!":
            self.i += 2
            self.name()
            brace = self.at("{")
            self.tree()
            if not brace:
                self.need(";")
        elif self.is_function():
            self.function()
        elif self.is_name() and self.macro_ahead():
            self.path_simple()
            self.need("!")
            if self.is_name():
                self.i += 1
            brace = self.at("{")
            self.tree()
            if not brace:
                self.need(";")
        else:
            self.i = start
            return False
        return True

    def macro_ahead(self) -> bool:
        j = self.i
        while self.k[j] == "n" and self.v[j + 1] == "::":
            j += 2
        return self.k[j] == "n" and self.v[j + 1] == "!" and self.v[j + 2] in ("(", "[", "{")

    def path_simple(self) -> None:
        self.i += 1
        while self.eat("::"):
            self.i += 1

    def is_function(self) -> bool:
        j = self.i
        while self.v[j] in ("const", "async", "unsafe", "safe", "extern", "default") or (self.k[j] == "s" and self.v[j - 1] == "extern"):
            j += 1
        return self.v[j] == "fn"

    def function(self) -> None:
        while not self.eat("fn"):
            self.i += 1
        self.name()
        self.generics()
        self.need("(")
        self.listed(")", self.param)
        if self.eat("->"):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()

    def param(self) -> None:
        self.attributes()
        if self.eat("..."):
            return
        if self.at("&", "self", "mut") and self.tried(self.self_param):
            return
        self.pattern()
        self.need(":")
        if not self.eat("..."):
            self.type()

    def self_param(self) -> None:
        if self.eat("&"):
            if self.k[self.i] == "l":
                self.i += 1
        self.eat("mut")
        self.need("self")
        if self.eat(":"):
            self.type()
        if not self.at(",", ")"):
            self.fail()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        if self.at("("):
            self.i += 1
            self.listed(")", self.tuple_field)
        elif self.at("{"):
            self.i += 1
            self.listed("}", self.field)
        if self.eat("="):
            self.expression()

    def alias(self) -> None:
        self.need("type")
        self.name()
        self.generics()
        if self.eat(":"):
            self.bounds()
        self.where()
        if self.eat("="):
            self.type()
        self.where()
        self.need(";")

    def associated(self) -> None:
        self.need("{")
        self.attributes(inner=True)
        while not self.eat("}"):
            if not self.item():
                self.fail("expected an item")

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                self.listed("}", self.use_tree)
                return
            if self.v[self.i] in PATH_WORDS:
                self.i += 1
            else:
                self.name()
            if not self.eat("::"):
                break
        if self.eat("as") and not self.eat("_"):
            self.name()

    # -- types

    def generics(self) -> None:
        if self.at("<"):
            self.i += 1
            self.listed(">", self.generic)

    def generic(self) -> None:
        self.attributes()
        if self.k[self.i] == "l":
            self.i += 1
            if self.eat(":"):
                self.bounds()
        elif self.eat("const"):
            self.name()
            self.need(":")
            self.type()
            if self.eat("="):
                self.generic_value()
        else:
            self.name()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.type()

    def generic_value(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.eat("-")
            if self.k[self.i] in "dcs" or self.at("true", "false") or self.is_name():
                self.i += 1
            else:
                self.fail()

    def where(self) -> None:
        if self.eat("where"):
            while not self.at("{", ";", "=") and self.k[self.i] != "e":
                if self.k[self.i] == "l":
                    self.i += 1
                else:
                    self.type()
                self.need(":")
                self.bounds()
                if not self.eat(","):
                    break

    def bounds(self) -> None:
        while not self.at("{", ",", ">", "=", ";", ")", "where", "]"):
            if self.k[self.i] == "l":
                self.i += 1
            elif self.at("("):
                self.i += 1
                self.bounds()
                self.need(")")
            else:
                self.eat("?")
                self.eat("~")
                self.eat("const")
                self.for_lifetimes()
                if self.at("use") and self.peek() == "<":
                    self.i += 1
                    self.generics()
                else:
                    self.type_path()
            if not self.eat("+"):
                return

    def for_lifetimes(self) -> None:
        if self.at("for") and self.peek() == "<":
            self.i += 1
            self.generics()

    def type(self) -> None:
        self.type_one()
        while self.at("+") and (self.k[self.i + 1] in "nl" or self.peek() in ("?", "(")) and self.bound_allowed:
            self.i += 1
            if self.k[self.i] == "l":
                self.i += 1
            else:
                self.eat("?")
                self.type_path()

    bound_allowed = False

    def type_one(self) -> None:
        v = self.v[self.i]
        if v == "&" or v == "&&":
            self.i += 1
            if self.k[self.i] == "l":
                self.i += 1
            self.eat("mut")
            return self.type_one()
        if v == "*":
            self.i += 1
            if not (self.eat("const") or self.eat("mut")):
                self.fail()
            return self.type_one()
        if v == "(":
            self.i += 1
            return self.listed(")", self.paren_type)
        if v == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                old, self.no_struct = self.no_struct, False
                self.expression()
                self.no_struct = old
            return self.need("]")
        if v == "!" or v == "_":
            self.i += 1
            return None
        if v in ("impl", "dyn") and (self.k[self.i + 1] in "nl" or self.peek() in ("?", "(", "for")):
            self.i += 1
            return self.bounds()
        self.for_lifetimes()
        if self.at("unsafe", "extern", "fn"):
            while not self.at("fn"):
                if not (self.at("unsafe", "extern") or self.k[self.i] == "s"):
                    self.fail()
                self.i += 1
            self.i += 1
            self.need("(")
            self.listed(")", self.fn_type_param)
            if self.eat("->"):
                self.type_one()
            return None
        self.type_path()
        if self.at("!") and self.peek() in ("(", "[", "{"):
            self.i += 1
            self.tree()
        return None

    def paren_type(self) -> None:
        old, self.bound_allowed = self.bound_allowed, True
        self.type()
        self.bound_allowed = old

    def fn_type_param(self) -> None:
        self.attributes()
        if self.eat("..."):
            return
        if (self.is_name() or self.at("_")) and self.peek() == ":":
            self.i += 2
        self.type()

    def type_path(self) -> None:
        if self.at("<"):
            self.qualified()
        else:
            self.eat("::")
            self.segment()
        while self.at("::") and (self.k[self.i + 1] == "n" or self.peek() == "<"):
            self.i += 1
            if self.at("<"):
                self.type_args()
            else:
                self.segment()

    def qualified(self) -> None:
        self.need("<")
        self.type()
        if self.eat("as"):
            self.type_path()
        self.need(">")
        if not self.at("::"):
            self.fail()

    def segment(self) -> None:
        if self.v[self.i] in PATH_WORDS:
            self.i += 1
        else:
            self.name()
        if self.at("<"):
            self.type_args()
        elif self.at("::") and self.peek() == "<":
            self.i += 1
            self.type_args()
        elif self.at("(") and self.v[self.i - 1] in ("Fn", "FnMut", "FnOnce", "AsyncFn", "AsyncFnMut", "AsyncFnOnce"):
            self.i += 1
            self.listed(")", self.type)
            if self.eat("->"):
                self.type_one()

    def type_args(self) -> None:
        self.need("<")
        self.listed(">", self.type_arg)

    def type_arg(self) -> None:
        if self.k[self.i] == "l":
            self.i += 1
        elif self.k[self.i] in "dcs" or self.at("{", "-", "true", "false"):
            self.generic_value()
        elif self.is_name() and self.peek() in ("=", ":"):
            self.i += 2
            if self.v[self.i - 1] == "=":
                if self.k[self.i] in "dcs" or self.at("{", "-"):
                    self.generic_value()
                else:
                    self.type()
            else:
                self.bounds()
        else:
            self.type()
            if self.at("=", ":"):
                self.i += 1
                self.bounds()

    # -- patterns

    def pattern(self) -> None:
        self.eat("|")
        self.pattern_one()
        while self.eat("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        v, kind = self.v[self.i], self.k[self.i]
        if v in ("&", "&&"):
            self.i += 1
            self.eat("mut")
            return self.pattern_one()
        if v == "(":
            self.i += 1
            return self.listed(")", self.pattern)
        if v == "[":
            self.i += 1
            return self.listed("]", self.pattern)
        if v in ("..", "..="):
            self.i += 1
            if self.k[self.i] in "dcs" or self.at("-") or self.is_name():
                self.pattern_bound()
            return None
        if v == "_":
            self.i += 1
            return None
        if v in ("ref", "mut") or (self.is_name() and self.peek() not in ("::", "(", "{", "!", "..", "..=", "...")):
            self.eat("ref")
            self.eat("mut")
            self.name()
            if self.eat("@"):
                self.pattern_one()
            return None
        if kind in "dcs" or v == "-" or v in ("true", "false"):
            self.pattern_bound()
        elif v in ("box", "const") and self.peek() == "{":
            self.i += 1
            return self.block()
        elif kind == "n" or v in ("::", "<"):
            if self.is_name() and self.macro_ahead():
                self.path_simple()
                self.need("!")
                return self.tree()
            self.expr_path()
            if self.at("("):
                self.i += 1
                return self.listed(")", self.pattern)
            if self.at("{"):
                self.i += 1
                return self.listed("}", self.pattern_field)
        else:
            self.fail("expected a pattern")
        if self.at("..=", "...", ".."):
            self.i += 1
            if self.k[self.i] in "dcs" or self.at("-") or self.k[self.i] == "n" and not self.at("if"):
                self.pattern_bound()
        return None

    def pattern_bound(self) -> None:
        self.eat("-")
        if self.k[self.i] in "dcs" or self.at("true", "false"):
            self.i += 1
        else:
            self.expr_path()

    def pattern_field(self) -> None:
        self.attributes()
        if self.eat(".."):
            return
        if (self.is_name() or self.k[self.i] == "d") and self.peek() == ":":
            self.i += 2
            self.pattern()
        else:
            self.eat("ref")
            self.eat("mut")
            self.name()

    # -- statements and expressions; each expression returns True if it ends with a block

    def block(self) -> None:
        self.need("{")
        old, self.no_struct = self.no_struct, False
        self.attributes(inner=True)
        while not self.at("}"):
            self.statement()
        self.no_struct = old
        self.need("}")

    def statement(self) -> None:
        if self.eat(";"):
            return
        start = self.i
        self.attributes()
        if self.eat("let"):
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expression()
                if self.eat("else"):
                    self.block()
            self.need(";")
            return
        if not self.macro_ahead() and not (self.at("unsafe", "const", "async") and self.peek() in ("{", "move")) and not (self.at("union", "auto", "default") and not self.is_name(1)):
            self.i = start
            if self.item():
                return
            self.attributes()
        if self.at("macro_rules") and self.peek() == "!" and self.is_name(2):
            self.i = start
            self.item()
            return
        blocky = self.expression(statement=True)
        if self.eat(";") or self.at("}") or blocky:
            return
        self.fail("expected ;")

    def expression(self, least: int = 0, statement: bool = False) -> bool:
        return self.binary(least, statement)

    def starts(self) -> bool:
        """Whether an expression can begin here."""
        v, k = self.v[self.i], self.k[self.i]
        if k in "dcsl":
            return True
        if k == "n":
            return v not in KEYWORDS or v in PATH_WORDS or v in ("if", "match", "loop", "while", "for", "unsafe", "move", "return", "break", "continue", "true", "false", "async", "const")
        return v in ("(", "[", "-", "!", "*", "&", "&&", "|", "||", "<", "::", "..") or (v == "{" and not self.no_struct)

    def binary(self, least: int, statement: bool = False) -> bool:
        if self.at("..", "..="):
            self.i += 1
            if self.starts():
                self.binary(1)
            return False
        blocky = self.unary(statement)
        if blocky and statement:
            if self.at(".", "?"):
                self.postfix()
                blocky = False
            else:
                return True
        while True:
            v, n = self.v[self.i], 1
            if v == "as":
                self.i += 1
                self.type_one()
                blocky = False
                continue
            if v == ">":
                if self.peek() in (">", "=") and self.touching(1):
                    if self.peek() == "=":
                        p, n = 4, 2
                    elif self.peek(2) == "=" and self.touching(2):
                        p, n = 0.5, 3
                    else:
                        p, n = 8, 2
                else:
                    p = 4
            elif v in ASSIGN:
                p = 0.5
            elif v in ("..", "..="):
                p = 1
            else:
                p = BINARY.get(v, 0) if self.k[self.i] == "p" else 0
            if not p or p <= least and not (p == 0.5 and least <= 0.5):
                return blocky
            self.i += n
            blocky = False
            if p == 1:
                if self.starts():
                    self.binary(1)
            elif p == 0.5:
                self.binary(0)
            else:
                self.binary(p)

    def unary(self, statement: bool = False) -> bool:
        v = self.v[self.i]
        if self.k[self.i] == "p" and v in ("-", "!", "*"):
            self.i += 1
            self.unary()
            return False
        if v in ("&", "&&") and self.k[self.i] == "p":
            self.i += 1
            if self.at("raw") and self.peek() in ("const", "mut"):
                self.i += 2
            else:
                self.eat("mut")
            self.unary()
            return False
        blocky = self.primary()
        if blocky and statement:
            return True
        return self.postfix() and blocky

    def postfix(self) -> bool:
        """True if nothing followed."""
        none = True
        while True:
            if self.at("?"):
                self.i += 1
            elif self.at("("):
                self.call()
            elif self.at("["):
                self.i += 1
                old, self.no_struct = self.no_struct, False
                self.expression()
                self.no_struct = old
                self.need("]")
            elif self.at("."):
                self.i += 1
                if self.k[self.i] == "d":
                    self.i += 1
                elif self.eat("await"):
                    pass
                else:
                    self.name()
                    if self.at("::"):
                        self.i += 1
                        self.type_args()
            else:
                return none
            none = False

    def call(self) -> None:
        self.need("(")
        old, self.no_struct = self.no_struct, False
        self.listed(")", self.argument)
        self.no_struct = old

    def argument(self) -> None:
        self.attributes()
        self.expression()

    def expr_path(self) -> None:
        if self.at("<"):
            self.qualified()
        else:
            self.eat("::")
            self.path_word()
        while self.at("::"):
            self.i += 1
            if self.at("<"):
                self.type_args()
            else:
                self.path_word()

    def path_word(self) -> None:
        if self.v[self.i] in PATH_WORDS:
            self.i += 1
        else:
            self.name()

    def condition(self) -> None:
        old, self.no_struct = self.no_struct, True
        self.chain()
        self.no_struct = old

    def chain(self) -> None:
        while True:
            if self.eat("let"):
                self.pattern()
                self.need("=")
                self.binary(3)
            else:
                self.binary(3 if self.has_let() else 0)
            if not self.eat("&&"):
                return

    def has_let(self) -> bool:
        j = self.i
        while self.v[j] != "{" and self.k[j] != "e":
            if self.v[j] == "let" and self.v[j - 1] == "&&":
                return True
            j = self.t.pair[j] + 1 if self.v[j] in ("(", "[") else j + 1
        return False

    def primary(self) -> bool:
        v, kind = self.v[self.i], self.k[self.i]
        if kind in "dcs":
            self.i += 1
            return False
        if kind == "l":
            self.i += 1
            self.need(":")
            if not self.at("loop", "while", "for", "{"):
                self.fail()
            return self.primary()
        if kind == "p":
            if v == "(":
                self.i += 1
                old, self.no_struct = self.no_struct, False
                self.listed(")", self.argument)
                self.no_struct = old
                return False
            if v == "[":
                self.i += 1
                old, self.no_struct = self.no_struct, False
                if not self.eat("]"):
                    self.argument()
                    if self.eat(";"):
                        self.expression()
                        self.need("]")
                    elif self.eat(","):
                        self.listed("]", self.argument)
                    else:
                        self.need("]")
                self.no_struct = old
                return False
            if v == "{":
                self.block()
                return True
            if v in ("|", "||"):
                return self.closure()
            if v in ("<", "::"):
                self.expr_path()
                return self.after_path()
            return self.fail()
        if v == "if":
            self.i += 1
            self.condition()
            self.block()
            while self.eat("else"):
                if self.eat("if"):
                    self.condition()
                    self.block()
                else:
                    self.block()
                    break
            return True
        if v == "match":
            self.i += 1
            old, self.no_struct = self.no_struct, True
            self.expression()
            self.no_struct = False
            self.need("{")
            self.attributes(inner=True)
            while not self.eat("}"):
                self.attributes()
                self.pattern()
                if self.eat("if"):
                    self.chain()
                self.need("=>")
                blocky = self.expression(statement=True)
                if not self.eat(",") and not self.at("}") and not blocky:
                    self.fail("expected ,")
            self.no_struct = old
            return True
        if v == "loop":
            self.i += 1
            self.block()
            return True
        if v == "while":
            self.i += 1
            self.condition()
            self.block()
            return True
        if v == "for" and self.peek() != "<":
            self.i += 1
            self.pattern()
            self.need("in")
            old, self.no_struct = self.no_struct, True
            self.expression()
            self.no_struct = old
            self.block()
            return True
        if v in ("unsafe", "const") and self.peek() == "{":
            self.i += 1
            self.block()
            return True
        if v == "async" and self.peek() in ("{", "move") and not (self.peek() == "move" and self.peek(2) in ("|", "||")):
            self.i += 1
            self.eat("move")
            self.block()
            return True
        if v in ("move", "static", "async"):
            while self.at("move", "static", "async"):
                self.i += 1
            return self.closure()
        if v in ("return", "break", "continue", "yield"):
            self.i += 1
            if v in ("break", "continue") and self.k[self.i] == "l":
                self.i += 1
            if v != "continue" and self.starts():
                self.expression()
            return False
        if v in ("true", "false", "_"):
            self.i += 1
            return False
        if self.is_name() and self.macro_ahead():
            self.path_simple()
            self.need("!")
            brace = self.at("{")
            self.tree()
            return brace
        self.expr_path()
        return self.after_path()

    def after_path(self) -> bool:
        if self.at("{") and not self.no_struct:
            self.i += 1
            self.listed("}", self.struct_field)
        return False

    def struct_field(self) -> None:
        self.attributes()
        if self.eat(".."):
            if not self.at("}"):
                self.expression()
            return
        if self.k[self.i] == "d":
            self.i += 1
            self.need(":")
            self.expression()
            return
        self.name()
        if self.eat(":"):
            self.expression()

    def closure(self) -> bool:
        if not self.eat("||"):
            self.need("|")
            while not self.eat("|"):
                self.attributes()
                self.pattern_one()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    self.need("|")
                    break
        if self.eat("->"):
            self.type_one()
            self.block()
        else:
            self.expression()
        return False


def parse(text: str) -> None:
    """Raises Bad if the text is no valid source file."""
    Crate(lex(text)).program()
