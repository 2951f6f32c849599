"""Credentials written out in texts: where they are, and the text with them masked.

One deterministic automaton (Aho-Corasick) holds the fixed parts of all grammars: the heads of token formats, the armor
of private keys, the mark of connection strings, header schemes, calls that log in and the words that end a
credential's name. A text is scanned in overlapping chunks; a hit is completed by its grammar on the whole text from its
absolute place, so a chunk's end cuts nothing; spans are kept once by their absolute place and spliced out together.

A credential is a list of pieces (a literal may be split); its line is that of the first piece. Stand-ins, masks,
references to the environment, hashes, ids, public keys and certificates are left alone.

A value of lower-case letters that read as words is taken for a stand-in, except a passphrase of several words: nothing
in the text tells ``"summerbreeze"`` from a label.

Defined results: null and empty texts hold nothing; repeated reads are each reported; lines are split at ``\\n`` alone.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow

CHUNK, OVERLAP = 1 << 20, 1 << 10
MASK = "REDACTED"
CODE = ("py", "ts", "js", "rs", "go", "java", "tsx", "jsx", "mjs", "kt", "c", "cc", "h", "cpp", "cs", "rb", "php", "swift", "scala")

#: Token formats by head: what follows and includes the head.
TOKENS = {
    "ghp_": r"ghp_[A-Za-z0-9]{20,}", "gho_": r"gho_[A-Za-z0-9]{20,}", "ghu_": r"ghu_[A-Za-z0-9]{20,}", "ghs_": r"ghs_[A-Za-z0-9]{20,}", "ghr_": r"ghr_[A-Za-z0-9]{20,}", "github_pat_": r"github_pat_\w{22,}",
    "akia": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", "asia": r"ASIA[A-Z0-9]{16}(?![A-Za-z0-9])", "xox": r"xox[abeoprs]-[A-Za-z0-9-]{10,}", "hooks.slack.com/services/": r"hooks\.slack\.com/services/T\w{6,}/B\w{6,}/[A-Za-z0-9]{16,}", "/api/webhooks/": r"/api/webhooks/\d{6,}/[\w-]{30,}", "sk_live_": r"sk_live_[A-Za-z0-9]{16,}", "sk_test_": r"sk_test_[A-Za-z0-9]{16,}", "rk_live_": r"rk_live_[A-Za-z0-9]{16,}", "rk_test_": r"rk_test_[A-Za-z0-9]{16,}",
    "_live_": r"[a-z]{2,8}_live_[A-Za-z0-9]{16,}", "aiza": r"AIza[\w-]{35}", "glpat-": r"glpat-[\w-]{20,}", "npm_": r"npm_[A-Za-z0-9]{36}", "sg.": r"SG\.[\w-]{16,}\.[\w-]{16,}", "eyj": r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", "sk-": r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}", "hf_": r"hf_[A-Za-z0-9]{30,}", "pypi-": r"pypi-[\w-]{50,}",
}
ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Comment leaders and quote marks at the beginning of an armored line, after a line break or an escaped one.
LEADER = r"(?:\r?\n|\\n)[ \t]*(?:#+|//+|/?\*+(?!/)|--(?!-)|;+|%+|!+|>+)(?:[ \t]*[#*>]+)*"
LED_LINE = re.compile(LEADER + r"((?:(?!\\n)[^\n])*)")
ARMOR_BODY = re.compile(r"(?:" + LEADER + r"|[A-Za-z0-9+/=\s:,.\"'`;]|\\[nrt\\]|\\(?=\r?\n)|-(?!-{4}))*")
ARMOR_RUN = re.compile(r"[A-Za-z0-9+/]{16,}")
URL = re.compile(r"://[^\s/:@\"'`<>]*:([^\s/@\"'`]+)@[\w\[${<]")
BASIC = re.compile(r"basic[ \t]+([A-Za-z0-9+/_-]{8,}={0,2})", re.IGNORECASE)
BEARER = re.compile(r"bearer[ \t]+([A-Za-z0-9._~+/-]{8,}=*)", re.IGNORECASE)
SHELL_LOGIN = re.compile(r"(?:-u[ \t]*[\"']?[\w.@-]+[\"']?[ \t]+-p(?=\S)|sshpass[ \t]+-p[ \t]*)[\"']?([^\s\"']{4,})")
SETTER_CALL = re.compile(r"\(\s*(?=[\"'`])")
SETTER = re.compile(r"(?:\A|[.:>])(?:set|with|put)_?\w*\Z", re.IGNORECASE)
ELEMENT = re.compile(r"[^\S\n]*([^<>\s\"'&][^<>\s\"']*)[^\S\n]*</")
#: Words that prose has and a chosen phrase hasn't.
PROSE = re.compile(r"\b(?:the|an?|your?|is|are|of|must|for|to|enter|please|be|not|with|from|or|and|this|that|invalid|wrong|missing|required|phrase|passphrase|password)\b", re.IGNORECASE)
CURL_USER = re.compile(r"-u[ \t]+[\"']?[\w.@-]+:([^\s\"']{4,})")
_LIT = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)"
CALL = re.compile(rf"\w*\(\s*{_LIT}\s*,\s*{_LIT}\s*,\s*({_LIT})\s*[,)]")
CALLS = ("connect(", "login(", "authenticate(", "auth(", "client(", "signin(")

#: Last words of a credential's name: alone, or after one of the words listed.
LAST = {
    "password": None, "passwd": None, "passwort": None, "passphrase": None, "pass": None, "pwd": None, "pw": None, "secret": None, "secrets": None, "token": None, "contrasena": None, "contraseña": None, "senha": None, "credential": None, "credentials": None, "apikey": None, "auth": None, "kennwort": None, "heslo": None, "haslo": None,
    "passe": ("de",), "key": ("api", "signing", "service", "access", "secret", "private", "account", "encryption", "auth", "client", "master", "shared", "deploy", "admin", "storage"), "api": ("kluc",), "authtoken": None, "accesskey": None, "secretkey": None,
}
WORD = re.compile(r"[A-ZÑ]+(?![a-zñ])|[A-ZÑ]?[a-zñ]+")
NAME_ON = re.compile(r"[\w\-]*(?:\.[A-Za-z_][\w\-]*)*")
#: Between a name and its value: a closing quote, a type, then the sign.
LINK = re.compile(
    r"\\?[\"'`]?\]?[ \t]*(?:(?::[ \t]*(?:&[ \t]*)?(?:'\w+[ \t]+)?[A-Za-z][\w<>\[\]| .]*?[ \t]*|[ \t]+(?:string|\[\]byte)[ \t]*)=(?=\s*(?:[\"'`]|concat!|String::|[bru]#?[\"']))|(?<![=!<>:])(?:=>|:=|=|:)(?![=:]))"
)
SPACE_LINK = re.compile(r"[ \t]+(?=[^\s=:])")
#: Calls that give back what a literal stands for.
DECODED_BY = r"(?:[A-Za-z_][\w.:]*(?:\(\))?[.:]+)?(?:b64decode|atob|decode(?:String|_string)?|Buffer\.from|from_base64|unhexlify|fromhex)\(\s*"
BEFORE_LITERAL = re.compile(rf"(?:[ \t]*{DECODED_BY})?" r"(?:[ \t]|\\\r?\n|\r?\n|\(|concat!\(|String::from\(|&|b(?=[\"'])|r(?=[\"'])|u(?=[\"'])|r#(?=\"))*")
LITERAL = re.compile(r"\\\"([^\"\\\n]*)\\\"|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
BETWEEN = re.compile(r"[ \t]*(?:\\?\r?\n)?[ \t]*[+.]?[ \t]*(?:\r?\n)?[ \t]*")
BETWEEN_ARGS = re.compile(r"\s*,\s*")
PLAIN = re.compile(r"[^\s\"'`,;{}()\[\]<>|&]+|<[^>\n]*>|\[[^\]\n]*\]|\$\{[^}\n]*\}|\{\{[^\n]*?\}\}")

STAND_IN = re.compile(
    r"(?:[xX]{3,}|\*+|\.+|-+|_+|#+|0+|1+|(?:1234567890?|123456|abc123|password1?|passw0rd|hunter2|letmein|secret|token|test|testing|guest|default|unset|unused|string|value|todo|tbd|fixme|null|none|nil|undefined|true|false|redacted|masked|removed|hidden|omitted|empty|optional|required|basic|bearer)"
    r"|change[-_ ]?(?:me|this|it).*|set[-_ ]?me.*|fill[-_ ]?me.*|dummy.*|fake.*|mock.*|sample.*|(?:an?[-_ ])?example.*|.*[-_ ]example|.*EXAMPLE.*|your[-_ ].*|.*[-_ ]your[-_ ].*|my[-_ ](?:secret|password|token|key).*|replace.*|insert[-_ ].*|enter[-_ ].*|put[-_ ].*|place[-_ ]?holder.*|<.*>|\[.*\]|\{\{?.*\}\}?|\(.*\)"
    r"|%\w+%|%\(\w+\)s|%[sdv]|\$\(.*\)|\$(?-i:[A-Z][A-Z0-9_]*|[a-z_][a-z0-9_]*)|@(?-i:[A-Z_]+)@|#\{.*\}|__\w+__|env[:.(!].*|process\.env.*|os\.(?:environ|getenv).*|system\.getenv.*|(?:vault|ref|ssm|arn|file|secretsmanager|op|sops|kms|gcp|aws)[:+].*|.*(?:\$\{|\{\{).*|.*(?:x{6,}|X{6,}|\*{4,}).*|.*(?:redacted|masked|placeholder|changeme).*)",
    re.IGNORECASE | re.DOTALL,
)
WORDS = re.compile(r"[A-Za-z]*[a-z]+(?:[._\- /:][A-Za-z]*[a-z]+)*")
PLAIN_WORD = re.compile(r"[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*(?:[._\- /:][A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*)*|[A-Z]+(?:[_\- ][A-Z]+)*")
NAME_LIKE = re.compile(r"[A-Za-z]+(?:[_.\-][A-Za-z]+)*[_.\-]?v?\d{1,2}|[a-z]+(?:[_.\-][a-z]+)+\d{0,2}|[A-Z]+(?:_[A-Z0-9]+)+")
CHUNK_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
PATH = re.compile(r"\.{0,2}/[a-z0-9_.\-]+(?:/[a-z0-9_.\-]+)*/?|[a-z]+://[^:@]*|[\w./-]+\.(?:pem|key|json|ya?ml|txt|crt|env|py|js|ts|go|rs|java)")


def stand_in(value: str) -> bool:
    v = value.strip()
    return len(v) < 4 or len(set(v)) < 3 or bool(STAND_IN.fullmatch(v))


def decoded(value: str) -> str | None:
    """The printable text that a base64 value stands for."""
    if len(value) < 8 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", value):
        return None
    try:
        text = base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4)).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return text if text.isprintable() else None


def natural(value: str) -> bool:
    """Whether the letters of a value read as words: pieces between case changes are long, not endless, and no capital stands with one letter."""
    chunks = CHUNK_OF_NAME.findall(value)
    short = any(len(c) < 3 and not c.islower() for c in chunks)
    return bool(chunks) and not short and sum(map(len, chunks)) >= 4 * len(chunks) and max(map(len, chunks)) <= 15


def secret_like(value: str) -> bool:
    """Whether a literal under a credential's name can be the credential itself."""
    v = value.strip()
    if stand_in(v) or len(v) < 6 or " " in v or PATH.fullmatch(v):
        return False
    if (d := decoded(v)) and stand_in(d):
        return False
    if not any(c.isdigit() for c in v):
        return not (PLAIN_WORD.fullmatch(v) and natural(v)) and (any(c.isupper() for c in v) or bool(re.search(r"[^\w.\- /:]", v)))
    return not (NAME_LIKE.fullmatch(v) and natural(v)) and not re.fullmatch(r"v?\d+(?:[.:,]\d+)+", v) and not re.fullmatch(r"\d{1,5}(?:ms|s|m|h|d|kb|mb|gb)?", v, re.IGNORECASE)


def chosen_phrase(value: str) -> bool:
    """Whether a literal of several words reads as a passphrase, not as prose about one."""
    parts = value.split()
    return len(parts) >= 4 and len(set(parts)) >= 4 and all(re.fullmatch(r"[\w-]{3,}", w) for w in parts) and not PROSE.search(value)


def armored(body: str) -> int:
    """Base64 characters of an armored body; of commented lines only those in long runs, since the rest can be prose."""
    led = sum(len(run) for line in LED_LINE.findall(body) for run in ARMOR_RUN.findall(line))
    return led + len(re.findall(r"[A-Za-z0-9+/]", re.sub(r"\\[nrt]", "", LED_LINE.sub("", body))))


def name_words(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


@lru_cache(maxsize=50_000)
def credential_name(name: str) -> bool:
    """Whether a name's last words name a credential; numbers at its end don't count."""
    words = name_words(name)
    if not words or words[-1] not in LAST:
        return False
    before = LAST[words[-1]]
    if words[-1] == "auth" and len(words) < 2:
        return False
    return before is None or (len(words) > 1 and words[-2] in before)


@lru_cache(maxsize=1)
def automaton():
    """The automaton and, by hit, the grammar."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for head in TOKENS:
        a.add_word(head, (head, "token"))
    a.add_word("private key", ("private key", "armor"))
    a.add_word("://", ("://", "url"))
    a.add_word("basic", ("basic", "basic"))
    a.add_word("bearer", ("bearer", "bearer"))
    a.add_word(" -u", (" -u", "curl"))
    a.add_word("sshpass", ("sshpass", "shell"))
    for call in CALLS:
        a.add_word(call, (call, "call"))
    for word in LAST:
        a.add_word(word, (word, "name"))
    a.make_automaton()
    return a


_TOKENS = {k: re.compile(v) for k, v in TOKENS.items()}


def folded(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def hits(low: str) -> Iterator[tuple[int, str, str]]:
    """Start, fixed part and grammar of each automaton hit, chunk by overlapping chunk."""
    a, seen = automaton(), 0
    for at in range(0, max(1, len(low)), CHUNK):
        for end, (word, kind) in a.iter(low, at, min(len(low), at + CHUNK + OVERLAP)):
            start = end - len(word) + 1
            if start < at + CHUNK and start >= seen:
                yield start, word, kind
        seen = at + CHUNK


def _pieces(text: str, at: int, joined: bool) -> list[tuple[int, int]]:
    """Inner spans of the literal at a place and of those joined to it."""
    out: list[tuple[int, int]] = []
    while m := LITERAL.match(text, at):
        g = m.lastindex or 0
        out.append(m.span(g))
        at = m.end()
        between = (BETWEEN_ARGS if joined else BETWEEN).match(text, at)
        if not between or not LITERAL.match(text, between.end()):
            break
        if not joined and "+" not in between.group() and "." not in between.group() and "\n" not in between.group() and " " not in between.group():
            break
        at = between.end()
    return out


def _named(text: str, start: int, word: str, code: bool) -> tuple[int, list[tuple[int, int]]] | None:
    """The value of the credential's name around a hit: the name's start, and the pieces."""
    back = start
    while back and (text[back - 1].isalnum() or text[back - 1] in "_.$-"):
        back -= 1
    on = NAME_ON.match(text, start + len(word)).end()
    name = text[back:on]
    if not credential_name(name.rstrip("0123456789_")):
        return None
    if text[back - 1 : back] == "<" and text[on : on + 1] == ">":
        m = ELEMENT.match(text, on + 1)
        return (back, [m.span(1)]) if m else None
    if SETTER.search(name) and (m := SETTER_CALL.match(text, on)) and (pieces := _pieces(text, m.end(), False)):
        return back, pieces
    link = LINK.match(text, on)
    option = name.startswith("--")
    if link:
        at = link.end()
    elif option or text[max(0, back - 4) : back].upper() == "ENV " or text[max(0, back - 1) : back] in ("", " ") and re.search(r"\b(?:login|user)\s+\S+\s+\Z", text[max(0, back - 60) : back]):
        if not (s := SPACE_LINK.match(text, on)):
            return None
        at = s.end()
    else:
        return None
    before = BEFORE_LITERAL.match(text, at)
    joined = "concat!(" in before.group()
    pieces = _pieces(text, before.end(), joined)
    if pieces:
        return back, pieces
    line = text.rfind("\n", 0, back) + 1
    if code and not re.match(r"\s*(?:#|//|\*|/\*|--|;)", text[line:back] or " ") and text[back - 1 : back] not in ("?", "&") and not option:
        return None
    while at < len(text) and text[at] in " \t":
        at += 1
    m = PLAIN.match(text, at)
    if not m:
        return None
    tail = text[m.end() : m.end() + 1]
    if tail in ("(", "{", "["):
        return None
    return back, [m.span()]


def found(text: str | None, code: bool = False) -> list[tuple[str, list[tuple[int, int]]]]:
    """Credentials of a text in order: kind and pieces (absolute spans)."""
    if not text:
        return []
    out: dict[int, tuple[str, list[tuple[int, int]]]] = {}

    def add(kind: str, pieces: list[tuple[int, int]]) -> None:
        at = pieces[0][0]
        if at not in out or sum(e - s for s, e in pieces) > sum(e - s for s, e in out[at][1]):
            out[at] = (kind, pieces)

    names: set[int] = set()
    for start, word, kind in hits(folded(text)):
        if kind == "token":
            at = start
            if word == "_live_":
                at = re.search(r"[a-z]{0,8}\Z", text[max(0, start - 8) : start]).start() + max(0, start - 8)
            if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
                continue
            m = _TOKENS[word].match(text, at)
            if m and not stand_in(m.group()[len(word) :]) and len(set(m.group()[len(word) :])) > 4:
                add("token", [m.span()])
        elif kind == "armor":
            m = next((x for x in [ARMOR.search(text, max(0, start - 40), start + 30)] if x and x.start() <= start), None)
            if m:
                body = ARMOR_BODY.match(text, m.end())
                if armored(body.group()) >= 40:
                    end = ARMOR_END.match(text, body.end())
                    last = body.end()
                    if not end and LED_LINE.search(body.group()):
                        # comments that follow a block without an end are none of it
                        last = max((x.end() for x in ARMOR_RUN.finditer(text, m.end(), body.end())), default=last)
                    add("private_key", [(m.start(), end.end() if end else last)])
        elif kind == "url":
            m = URL.match(text, start)
            if m and not stand_in(m.group(1)):
                add("login", [m.span(1)])
        elif kind == "basic":
            m = BASIC.match(text, start)
            if m and (d := decoded(m.group(1))) and ":" in d and not stand_in(d.split(":", 1)[1]):
                add("basic", [m.span(1)])
        elif kind == "bearer":
            m = BEARER.match(text, start)
            if m and len(m.group(1)) >= 12 and secret_like(m.group(1)):
                add("bearer", [m.span(1)])
        elif kind in ("curl", "shell"):
            m = SHELL_LOGIN.match(text, start + (kind == "curl"))
            if m and secret_like(m.group(1)):
                add("login", [m.span(1)])
            m = CURL_USER.match(text, start + 1)
            if m and not stand_in(m.group(1)):
                add("login", [m.span(1)])
        elif kind == "call":
            m = CALL.match(text, start + len(word) - 1) if word.endswith("(") else None
            if m and secret_like(m.group(1)[1:-1]):
                add("argument", [(m.start(1) + 1, m.end(1) - 1)])
        else:
            got = _named(text, start, word, code)
            if got and got[0] not in names:
                names.add(got[0])
                value = "".join(text[s:e] for s, e in got[1])
                if ARMOR.search(value) or value.startswith("-----BEGIN") or re.match(r"(?:Basic|Bearer) ", value) or "://" in value:
                    continue
                if secret_like(value) or (chosen_phrase(value) and "passphrase" in name_words(text[got[0] : NAME_ON.match(text, start + len(word)).end()])[-1:]):
                    add("named", got[1])
    kept: list[tuple[str, list[tuple[int, int]]]] = []
    last = -1
    for at in sorted(out):
        kind, pieces = out[at]
        if at >= last:
            kept.append((kind, pieces))
            last = pieces[-1][1]
    return kept


def lines_of(text: str, places: list[int]) -> list[int]:
    """Line numbers from 1 of ascending places."""
    out, at, n = [], 0, 1
    for p in places:
        n += text.count("\n", at, p)
        at = p
        out.append(n)
    return out


def masked(text: str, found_: list[tuple[str, list[tuple[int, int]]]]) -> str:
    """The text with every piece spliced out for a placeholder: the first piece for its name, later ones for nothing."""
    out, at = [], 0
    for kind, pieces in found_:
        for i, (s, e) in enumerate(pieces):
            out += [text[at:s], f"[{MASK}:{kind}]" if i == 0 else ""]
            at = e
    return "".join([*out, text[at:]])


def is_code(path: str | None) -> bool:
    name = (path or "").rsplit("/", 1)[-1]
    return "." in name and name.rsplit(".", 1)[1].lower() in CODE


def credential_lines(reads: DataFrame, read_id: str = "read_id", path: str = "path", text: str = "text") -> DataFrame:
    """One row per read and line on which a credential starts: ``read_id``, ``line_no``, ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, kinds = [], [], []
            for i, p, t in zip(*(c.to_pylist() for c in b.columns)):
                got = found(t, is_code(p))
                by: dict[int, list[str]] = {}
                for n, (k, _) in zip(lines_of(t or "", [x[1][0][0] for x in got]), got):
                    by.setdefault(n, []).append(k)
                for n, k in by.items():
                    ids.append(i)
                    nos.append(n)
                    kinds.append(",".join(sorted(set(k))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(kinds, pa.string())], names=["read_id", "line_no", "kinds"])

    rows = reads.select(F.col(read_id).cast("bigint").alias("read_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows.filter(F.length("text") > 0), run, "read_id bigint, line_no bigint, kinds string")


def redacted(reads: DataFrame, read_id: str = "read_id", path: str = "path", text: str = "text") -> DataFrame:
    """``read_id``, ``text`` with credentials masked and all else unchanged, ``masks``; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = found(t, is_code(p))
                rows.append((masked(t, got) if got else t, len(got)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["read_id", "text", "masks"])

    rows = reads.select(F.col(read_id).cast("bigint").alias("read_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, run, "read_id bigint, text string, masks int")
