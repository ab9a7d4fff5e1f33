"""COBOL front end: source text to a typed tree, and to tables of facts.

Statements are dicts with a ``kind``; expressions are tuples: ``("num", Decimal)``, ``("str", text)``, ``("fig", name)``,
``("var", name, subscripts, (start, length) or None)``, ``("neg", e)``, ``("bin", op, a, b)``, ``("fn", name, args)``.
Conditions: ``("rel", op, a, b)``, ``("and"|"or", a, b)``, ``("not", c)``, ``("cond", name, subscripts)``, ``("class", e, kind)``, ``("sign", e, kind)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal

from tallyframe.conf import CobolConf, detect
from tallyframe.functions.pic import PictureError, parse
from tallyframe.sources.layout import Item, LayoutError, place


class SourceError(ValueError):
    pass


# Text ---------------------------------------------------------------------------------------------------


CARD, COMMENT, FIXED, FREE = (re.compile(p) for p in (r"(?i)^\s{0,7}(CBL|PROCESS)\s", r"^[\d ]{6}[*/]", r"^(\d{6}|\s{6})[ D-]", r"^\s*\*\s*\d"))


def cleaned(source: str) -> str:
    """Without sequence numbers, comment lines and the identification area; free-form text passes through."""
    out = []
    for line in source.replace("\t", "    ").splitlines():
        if CARD.match(line):
            continue
        if COMMENT.match(line):
            continue
        if FIXED.match(line):
            if line[6] == "D":
                continue
            text = line[7:72]
            if line[6] == "-" and out:
                out[-1] = out[-1].rstrip() + text.lstrip().lstrip("'\"")
                continue
            out.append(text)
        elif line.lstrip().startswith(("*>", "*")) and not FREE.match(line):
            continue
        else:
            out.append(line)
    return "\n".join(re.sub(r"\*>.*$", "", x) if "*>" in x else x for x in out)


#: A COPY statement: member, library, REPLACING clause.
COPY = re.compile(r"(?is)\bCOPY\s+([\w-]+|'[^']+'|\"[^\"]+\")(?:\s+(?:OF|IN)\s+([\w-]+))?(?:\s+REPLACING\s+(.*?))?\s*\.(?=\s|$)")


def member_name(written: str) -> str:
    return written.strip("'\"").upper()


def replaced(text: str, clause: str | None) -> str:
    """``text`` after the replacements of a REPLACING clause, in turn: whole words, pseudo-text, LEADING and TRAILING parts."""
    for r in re.finditer(r"(?is)(LEADING\s+|TRAILING\s+)?(?:==(.*?)==|([\w:()-]+|'[^']*'|\"[^\"]*\"))\s+BY\s+(?:==(.*?)==|([\w:()-]+|'[^']*'|\"[^\"]*\"))", clause or ""):
        side, old, new = (r[1] or "").strip().upper(), (r[2] if r[2] is not None else r[3]).strip(), (r[4] if r[4] is not None else r[5] or "").strip()
        before = r"(?<![\w-])" if re.match(r"[\w-]", old) and side != "TRAILING" else ""
        after = r"(?![\w-])" if re.search(r"[\w-]$", old) and side != "LEADING" else ""
        text = re.sub(before + re.escape(old) + after, lambda _, new=new: new, text, flags=re.I)
    return text


def expand_copies(source: str, library: Mapping[str, str], depth: int = 10, seen: tuple[str, ...] = ()) -> tuple[str, list[tuple[str, str]]]:
    """COPY members put in, with REPLACING; issues are ``(member, reason)``. A library that is a table is for ``copies.expand``."""
    issues: list[tuple[str, str]] = []

    def member(m: re.Match) -> str:
        name = member_name(m[1])
        if name in seen:
            issues.append((name, "cycle"))
            return ""
        if not depth:
            issues.append((name, "too deep"))
            return ""
        text = library.get(name)
        if text is None:
            issues.append((name, "not found"))
            return ""
        text, more = expand_copies(replaced(cleaned(text), m[3]), library, depth - 1, (*seen, name))
        issues.extend(more)
        return text

    return COPY.sub(member, source), issues


TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|[XxZzNn]'[^']*'|\d+[A-Za-z-][\w-]*|[+-]?\d*\.\d+|\d+|[A-Za-z][\w-]*|\*\*|<=|>=|<>|[().,:=<>+\-*/;&]|\S""")


def tokens(text: str, comma: bool = False) -> list[tuple[str, int]]:
    """``(token, line)``; words are upper case; a period that ends a sentence is ``.``; separators are dropped."""
    out: list[tuple[str, int]] = []
    line, last = 1, 0
    if comma:
        text = re.sub(r"(?<=\d),(?=\d)", ".", text)
    for m in TOKEN.finditer(text):
        t = m[0]
        line += text.count("\n", last, m.start())
        last = m.start()
        if t[0] in "+-" and len(t) > 1 and out and not (out[-1][0] in ("(", "=", ",", "TO", "VALUE", "IS", "BY", "+", "-", "*", "/", "**", "<", ">", "<=", ">=", "MOVE", "ADD", "THRU", "WHEN") or text[m.start() - 1 : m.start()] in ("",)):
            out += [(t[0], line), (t[1:], line)]
            continue
        if t in ",;" and re.match(r"\s|$", text[m.end() : m.end() + 1]):
            continue
        out.append((t.upper() if t[0].isalpha() or (t[0].isdigit() and not t.replace(".", "").isdigit()) else t, line))
    return out


# Tree ---------------------------------------------------------------------------------------------------


@dataclass
class Paragraph:
    name: str | None
    line: int
    body: list[dict] = field(default_factory=list)
    section: bool = False


@dataclass
class Program:
    name: str
    conf: CobolConf
    items: list[Item]
    paragraphs: list[Paragraph]
    files: dict[str, dict] = field(default_factory=dict)
    linkage: list[Item] = field(default_factory=list)
    using: list[str] = field(default_factory=list)
    blocks: list[tuple[str, str]] = field(default_factory=list)
    copy_issues: list[tuple[str, str]] = field(default_factory=list)
    issues: list[tuple[str, str, str]] = field(default_factory=list)
    lines: int = 0

    def every(self):
        """All statements, nested ones too, with their paragraph."""
        for p in self.paragraphs:
            yield from ((p, s) for s in walk(p.body))


NESTED = ("then", "else", "body", "other", "at_end", "not_at_end", "size_error", "not_size_error", "overflow", "not_overflow", "invalid", "not_invalid")


def walk(body: list[dict]):
    for s in body:
        yield s
        for key in NESTED:
            if inner := s.get(key):
                yield from walk(inner)
        for _, branch in s.get("whens", []):
            yield from walk(branch)


FIGURATIVE = {"SPACE": "SPACE", "SPACES": "SPACE", "ZERO": "ZERO", "ZEROS": "ZERO", "ZEROES": "ZERO", "HIGH-VALUE": "HIGH", "HIGH-VALUES": "HIGH", "LOW-VALUE": "LOW", "LOW-VALUES": "LOW", "QUOTE": "QUOTE", "QUOTES": "QUOTE", "NULL": "LOW", "NULLS": "LOW"}
VERBS = frozenset("""ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE DELETE DISPLAY DIVIDE EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY
NEXT OPEN PERFORM READ RELEASE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WRITE""".split())
ENDS = frozenset("""ELSE WHEN END-IF END-EVALUATE END-PERFORM END-READ END-ADD END-SUBTRACT END-MULTIPLY END-DIVIDE END-COMPUTE END-STRING END-UNSTRING END-SEARCH END-CALL END-WRITE
END-REWRITE END-DELETE END-START END-RETURN AT NOT ON INVALID END OVERFLOW SIZE""".split())


class _Cursor:
    def __init__(self, toks: list[tuple[str, int]]):
        self.toks, self.at = toks, 0

    def peek(self, k: int = 0) -> str:
        return self.toks[self.at + k][0] if self.at + k < len(self.toks) else ""

    @property
    def line(self) -> int:
        return self.toks[min(self.at, len(self.toks) - 1)][1] if self.toks else 0

    def next(self) -> str:
        t = self.peek()
        if not t:
            raise SourceError("unexpected end of source")
        self.at += 1
        return t

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def skip(self, *words: str) -> None:
        while self.peek() in words and self.peek():
            self.at += 1

    def expect(self, word: str) -> None:
        if not self.take(word):
            raise SourceError(f"line {self.line}: expected {word}, found {self.peek() or 'end'}")


def literal(t: str):
    if t[:1] in "'\"" and t:
        return ("str", t[1:-1].replace(t[0] * 2, t[0]))
    if re.fullmatch(r"[XN]'.*'|[XNZ]\".*\"", t, re.I):
        return ("str", bytes.fromhex(t[2:-1]).decode("latin-1") if t[0] in "Xx" else t[2:-1])
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", t):
        return ("num", Decimal(t))
    if t in FIGURATIVE:
        return ("fig", FIGURATIVE[t])
    return None


# Data division ------------------------------------------------------------------------------------------


def parse_data(text: str, comma: bool = False) -> list[Item]:
    """Items of data description entries (a copybook, a section)."""
    return _data(_Cursor(tokens(_guarded(cleaned(text)), comma)))


def _guarded(text: str) -> str:
    """Pictures as one quoted token each: their periods and commas are their own."""
    return re.sub(r"(?i)\b(PIC(?:TURE)?)(\s+IS)?\s+(?!\s)([^\s'\"]+?)(\.?)(?=\s|$)", lambda m: f"PIC \"{m[3].rstrip('.').rstrip(',')}\"{m[4] or ('.' if m[3].endswith('.') else '')}", text)


def _data(c: _Cursor) -> list[Item]:
    top: list[Item] = []
    stack: list[Item] = []
    inherited: dict[int, str] = {}
    while c.peek().isdigit() and len(c.peek()) <= 2:
        level = int(c.next())
        name = "FILLER"
        if c.peek() not in (".", "PIC", "REDEFINES", "VALUE", "OCCURS", "COMP", "COMP-3", "USAGE") and c.peek():
            name = c.next()
        item = Item(level, name)
        picture, usage, sign, flags = None, None, "", set()
        while c.peek() and not c.take("."):
            t = c.next()
            if t == "PIC":
                picture = c.next()[1:-1]
            elif t == "REDEFINES":
                item.redefines = c.next()
            elif t == "RENAMES":
                first = c.next()
                item.renames = (first, c.next() if c.take("THRU") or c.take("THROUGH") else first)
            elif t == "OCCURS":
                n = int(c.next())
                if c.take("TO"):
                    n = int(c.next())
                c.skip("TIMES")
                item.occurs = n
                if c.take("DEPENDING"):
                    c.skip("ON")
                    item.depending = c.next()
            elif t == "INDEXED":
                c.skip("BY")
                names = [c.next()]
                while re.match(r"[A-Z]", c.peek()) and c.peek() not in ("PIC", "VALUE", "ASCENDING", "DESCENDING", "USAGE", "COMP", "COMP-3"):
                    names.append(c.next())
                item.indexed = tuple(names)
            elif t in ("ASCENDING", "DESCENDING"):
                c.skip("KEY", "IS")
                c.next()
            elif t in ("VALUE", "VALUES"):
                c.skip("IS", "ARE")
                while c.peek() not in (".", "") and (literal(c.peek()) or c.peek() == "ALL"):
                    if c.take("ALL"):
                        item.values.append(("all", c.next()))
                        continue
                    v = literal(c.next())
                    if c.take("THRU") or c.take("THROUGH"):
                        v = ("range", v, literal(c.next()))
                    item.values.append(v)
            elif t == "SIGN":
                c.skip("IS")
                sign = c.next() + (" SEPARATE" if c.take("SEPARATE") else "")
                c.skip("CHARACTER")
            elif t in ("LEADING", "TRAILING"):
                sign = t + (" SEPARATE" if c.take("SEPARATE") else "")
                c.skip("CHARACTER")
            elif t == "BLANK":
                c.skip("WHEN", "ZERO", "ZEROS", "ZEROES")
                flags.add("blank")
            elif t in ("JUSTIFIED", "JUST"):
                c.skip("RIGHT")
                flags.add("just")
            elif t in ("USAGE", "IS", "GLOBAL", "EXTERNAL", "SYNC", "SYNCHRONIZED"):
                continue
            elif re.match(r"(COMP|BINARY|PACKED|DISPLAY|INDEX$|POINTER)", t):
                usage = t
        while stack and stack[-1].level >= level and level not in (66, 88):
            stack.pop()
        own_usage = usage or next((inherited[id(x)] for x in reversed(stack) if id(x) in inherited), "DISPLAY")
        if usage and picture is None:
            inherited[id(item)] = usage
        if level == 88:
            if stack:
                stack[-1].conditions[name] = item.values
            continue
        if picture is not None or (own_usage in ("COMP-1", "COMP-2", "COMPUTATIONAL-1", "COMPUTATIONAL-2", "INDEX") and level != 66):
            item.pic = parse(picture or "9(9)", own_usage, sign, "blank" in flags, "just" in flags)
        if level in (66, 78):
            top.append(item)
            continue
        if stack:
            item.parent = stack[-1]
            stack[-1].children.append(item)
        else:
            top.append(item)
        stack.append(item)
    return top


# Procedure division -------------------------------------------------------------------------------------


class _Procedure:
    def __init__(self, c: _Cursor, names: set[str], conditions: set[str]):
        self.c, self.names, self.conditions = c, names, conditions

    # expressions

    def variable(self):
        c = self.c
        name = c.next()
        if not re.match(r"[A-Z0-9]", name):
            raise SourceError(f"line {c.line}: a name was expected, found {name}")
        first = True
        while c.peek() in ("OF", "IN") and c.peek(1) in self.names:
            c.next()
            group = c.next()
            name, first = (f"{group}.{name}" if first else name), False
        subs, ref = [], None
        while c.peek() == "(":
            mark = c.at
            c.next()
            first = self.expression()
            if c.take(":"):
                ref = (first, None if c.peek() == ")" else self.expression())
                c.expect(")")
                break
            if subs:
                c.at = mark
                break
            subs.append(first)
            while c.peek() != ")":
                c.skip(",")
                subs.append(self.expression())
            c.expect(")")
        return ("var", name, tuple(subs), ref)

    def primary(self):
        c = self.c
        t = c.peek()
        if t == "(":
            c.next()
            e = self.expression()
            c.expect(")")
            return e
        if t in ("-", "+"):
            c.next()
            e = self.primary()
            return ("neg", e) if t == "-" else e
        if t == "FUNCTION":
            c.next()
            name, args = c.next(), []
            if c.take("("):
                while c.peek() != ")":
                    args.append(self.expression())
                    c.skip(",")
                c.expect(")")
            ref = None
            if c.peek() == "(" and name in ("CURRENT-DATE", "TRIM", "UPPER-CASE", "LOWER-CASE", "REVERSE"):
                c.next()
                first = self.expression()
                c.expect(":")
                ref = (first, None if c.peek() == ")" else self.expression())
                c.expect(")")
            return ("fn", name, tuple(args)) if ref is None else ("ref", ("fn", name, tuple(args)), ref)
        if t == "LENGTH" and c.peek(1) == "OF":
            c.next()
            c.next()
            return ("fn", "LENGTH", (self.variable(),))
        if t == "ALL" and (literal(c.peek(1)) or ("",))[0] in ("str", "fig"):
            c.next()
            v = literal(c.next())
            return ("all", v[1]) if v[0] == "str" else v
        if (v := literal(t)) is not None:
            c.next()
            return v
        return self.variable()

    def power(self):
        e = self.primary()
        if self.c.take("**"):
            return ("bin", "**", e, self.power())
        return e

    def term(self):
        e = self.power()
        while self.c.peek() in ("*", "/"):
            e = ("bin", self.c.next(), e, self.power())
        return e

    def expression(self):
        e = self.term()
        while self.c.peek() in ("+", "-") or re.fullmatch(r"[+-]\d.*", self.c.peek()):
            if len(self.c.peek()) > 1:
                t = self.c.next()
                e = ("bin", t[0], e, ("num", Decimal(t[1:])))
            else:
                e = ("bin", self.c.next(), e, self.term())
        return e

    # conditions

    RELATIONS = {"=": "=", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "<>": "<>", "EQUAL": "=", "EQUALS": "=", "GREATER": ">", "LESS": "<"}
    NEGATED = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}

    def relation(self) -> str | None:
        c, mark, negated = self.c, self.c.at, False
        c.skip("IS", "ARE")
        if c.take("NOT"):
            negated = True
        op = self.RELATIONS.get(c.peek())
        if op is None:
            c.at = mark
            return None
        c.next()
        c.skip("THAN", "TO")
        if c.peek() == "OR" and c.peek(1) in ("EQUAL", "="):
            c.next()
            c.next()
            c.skip("TO")
            op += "="
        return self.NEGATED[op] if negated else op

    def condition(self):
        e = self.conjunction()
        while self.c.take("OR"):
            e = ("or", e, self.conjunction(e))
        return e

    def conjunction(self, last=None):
        e = self.negation(last)
        while self.c.take("AND"):
            e = ("and", e, self.negation(e))
        return e

    def _last_relation(self, e):
        while e and e[0] in ("and", "or"):
            e = e[2]
        return e if e and e[0] == "rel" else None

    def negation(self, last=None):
        c = self.c
        if c.peek() == "NOT" and c.peek(1) not in self.RELATIONS:
            c.next()
            return ("not", self.negation(last))
        if c.peek() == "(":
            mark = c.at
            try:  # a parenthesised condition, or an expression
                c.next()
                e = self.condition()
                c.expect(")")
                if e[0] != "expr" and c.peek() not in ("+", "-", "*", "/", "**"):
                    return e
            except SourceError:
                pass
            c.at = mark
        if last is not None and (r := self._last_relation(last)):
            op = self.relation()
            if op:  # A > 1 AND < 5
                return ("rel", op, r[2], self.expression())
        if c.peek() in self.conditions:
            v = self.variable()
            return ("cond", v[1], v[2])
        left = self.expression()
        op = self.relation()
        if op:
            right = self.expression()
            return ("rel", op, left, right)
        mark, negated = c.at, False
        c.skip("IS")
        negated = c.take("NOT")
        t = c.peek()
        if t in ("NUMERIC", "ALPHABETIC", "ALPHABETIC-LOWER", "ALPHABETIC-UPPER"):
            c.next()
            e = ("class", left, t)
        elif t in ("POSITIVE", "NEGATIVE") or t in FIGURATIVE and FIGURATIVE[t] == "ZERO":
            c.next()
            e = ("sign", left, "ZERO" if t in FIGURATIVE else t)
        else:
            c.at = mark
            if last is not None and (r := self._last_relation(last)):  # A = 1 OR 2
                return ("rel", r[1], r[2], left)
            return ("expr", left)
        return ("not", e) if negated else e

    # statements

    def statements(self) -> list[dict]:
        out = []
        while self.c.peek() in VERBS:
            if self.c.peek() == "NEXT" and self.c.peek(1) != "SENTENCE":
                break
            out.append(self.statement())
        return out

    def statement(self) -> dict:
        c = self.c
        line, verb = c.line, c.next()
        s = getattr(self, "s_" + verb.lower())()
        return {"kind": s.pop("kind", verb), "line": line, **s}

    def handlers(self, *pairs: tuple[str, tuple[str, ...]], end: str = "") -> dict:
        """Clauses like ON SIZE ERROR and NOT ON SIZE ERROR."""
        c, out = self.c, {}
        again = True
        while again:
            again = False
            for key, words in pairs:
                for name, lead in ((f"not_{key}", ("NOT",)), (key, ())):
                    mark = c.at
                    if (not lead or c.take(*lead)) and (c.take("ON", *words) or c.take("AT", *words) or c.take(*words)):
                        out[name] = self.statements()
                        again = True
                        break
                    c.at = mark
                if again:
                    break
        if end:
            c.take(end)
        return out

    def targets(self) -> list[tuple]:
        out = []
        while re.match(r"[A-Z0-9]", self.c.peek()) and self.c.peek() in self.names:
            v = self.variable()
            out.append((v, self.c.take("ROUNDED")))
        if not out:
            raise SourceError(f"line {self.c.line}: no target")
        return out

    def operands(self, *stops: str) -> list:
        out = [self.expression()]
        while self.c.peek() not in (*stops, ".", "") and self.c.peek() not in VERBS | ENDS:
            out.append(self.expression())
        return out

    def _arithmetic(self, op: str, end: str, values, targets, giving) -> dict:
        return {"kind": "ARITHMETIC", "op": op, "values": values, "targets": targets, "giving": giving} | self.handlers(("size_error", ("SIZE", "ERROR")), end=end)

    def s_add(self):
        c = self.c
        if c.take("CORRESPONDING") or c.take("CORR"):
            a = self.variable()
            c.expect("TO")
            return {"kind": "CORRESPONDING", "op": "+", "from": a[1], "to": self.variable()[1], "rounded": c.take("ROUNDED")} | self.handlers(("size_error", ("SIZE", "ERROR")), end="END-ADD")
        values = self.operands("TO", "GIVING")
        if c.take("TO"):
            if c.peek() in self.names and self._giving_ahead():
                values += self.operands("GIVING")
                c.expect("GIVING")
                return self._arithmetic("+", "END-ADD", values, self.targets(), True)
            if literal(c.peek()):
                values += self.operands("GIVING")
                c.expect("GIVING")
                return self._arithmetic("+", "END-ADD", values, self.targets(), True)
            return self._arithmetic("+", "END-ADD", values, self.targets(), False)
        c.expect("GIVING")
        return self._arithmetic("+", "END-ADD", values, self.targets(), True)

    def _giving_ahead(self) -> bool:
        mark = self.c.at
        while self.c.peek() in self.names or self.c.peek() in ("ROUNDED", "(", ")", "OF", "IN", ",") or (literal(self.c.peek()) and self.c.peek()):
            self.c.at += 1
        found = self.c.peek() == "GIVING"
        self.c.at = mark
        return found

    def s_subtract(self):
        c = self.c
        if c.take("CORRESPONDING") or c.take("CORR"):
            a = self.variable()
            c.expect("FROM")
            return {"kind": "CORRESPONDING", "op": "-", "from": a[1], "to": self.variable()[1], "rounded": c.take("ROUNDED")} | self.handlers(("size_error", ("SIZE", "ERROR")), end="END-SUBTRACT")
        values = self.operands("FROM")
        c.expect("FROM")
        if literal(c.peek()) or self._giving_ahead():
            base = self.expression()
            c.expect("GIVING")
            return self._arithmetic("-", "END-SUBTRACT", [base, *values], self.targets(), True)
        return self._arithmetic("-", "END-SUBTRACT", values, self.targets(), False)

    def s_multiply(self):
        c = self.c
        a = self.expression()
        c.expect("BY")
        if literal(c.peek()) or self._giving_ahead():
            b = self.expression()
            if c.take("GIVING"):
                return self._arithmetic("*", "END-MULTIPLY", [a, b], self.targets(), True)
            return self._arithmetic("*", "END-MULTIPLY", [b], [(a, c.take("ROUNDED"))], False)  # a literal target: the other operand
        return self._arithmetic("*", "END-MULTIPLY", [a], self.targets(), False)

    def s_divide(self):
        c = self.c
        a = self.expression()
        word = c.next()
        if word == "INTO" and not literal(c.peek()) and not self._giving_ahead():
            return self._arithmetic("/", "END-DIVIDE", [a], self.targets(), False)
        b = self.expression()
        top, bottom = (b, a) if word == "INTO" else (a, b)
        c.expect("GIVING")
        targets = self.targets()
        rest = self.variable() if c.take("REMAINDER") else None
        return {"remainder": rest} | self._arithmetic("/", "END-DIVIDE", [top, bottom], targets, True)

    def s_compute(self):
        targets = self.targets()
        if not (self.c.take("=") or self.c.take("EQUAL")):
            raise SourceError(f"line {self.c.line}: COMPUTE without =")
        e = self.expression()
        return {"targets": targets, "value": e} | self.handlers(("size_error", ("SIZE", "ERROR")), end="END-COMPUTE")

    def s_move(self):
        c = self.c
        if c.take("CORRESPONDING") or c.take("CORR"):
            a = self.variable()
            c.expect("TO")
            return {"kind": "CORRESPONDING", "op": "MOVE", "from": a[1], "to": self.variable()[1], "rounded": False}
        value = self.primary()
        c.expect("TO")
        return {"value": value, "targets": [v for v, _ in self.targets()]}

    def s_if(self):
        c = self.c
        test = self.condition()
        c.take("THEN")
        then = self.statements()
        other = self.statements() if c.take("ELSE") else []
        c.take("END-IF")
        return {"test": test, "then": then, "else": other}

    def s_evaluate(self):
        c = self.c
        subjects = [self._subject()]
        while c.take("ALSO"):
            subjects.append(self._subject())
        whens, other = [], []
        while c.take("WHEN"):
            tests = []
            is_other = False
            while True:
                if c.take("OTHER"):
                    is_other = True
                else:
                    parts = [self._when(subjects[0])]
                    while c.take("ALSO"):
                        parts.append(self._when(subjects[len(parts)]))
                    tests.append(parts)
                if c.peek() == "WHEN":
                    c.next()
                    continue
                break
            body = self.statements()
            if is_other:
                other = body
            else:
                whens.append((tests, body))
        c.take("END-EVALUATE")
        return {"subjects": subjects, "whens": whens, "other": other}

    def _subject(self):
        if self.c.peek() in ("TRUE", "FALSE"):
            return ("bool", self.c.next() == "TRUE")
        e = self.condition()
        return e[1] if e[0] == "expr" else e

    def _when(self, subject):
        """A condition, or None for ANY."""
        c = self.c
        if c.take("ANY"):
            return None
        if subject[0] == "bool":
            e = self.condition()
            return e if subject[1] else ("not", e)
        negated = c.take("NOT")
        if subject[0] in ("rel", "cond", "and", "or", "not", "class", "sign"):
            want = c.next() == "TRUE"
            return subject if want != negated else ("not", subject)
        if op := self.relation():
            e = ("rel", op, subject, self.expression())
        else:
            low = self.expression()
            if c.take("THRU") or c.take("THROUGH"):
                e = ("and", ("rel", ">=", subject, low), ("rel", "<=", subject, self.expression()))
            else:
                e = ("rel", "=", subject, low)
        return ("not", e) if negated else e

    def s_perform(self):
        c = self.c
        s: dict = {"first": None, "last": None, "times": None, "until": None, "varying": [], "after": False, "body": []}
        if c.peek() not in VERBS | {"UNTIL", "VARYING", "WITH", "TEST"} and not (c.peek(1) == "TIMES" and (c.peek().isdigit() or c.peek() in self.names)):
            s["first"] = s["last"] = c.next()
            if c.take("THRU") or c.take("THROUGH"):
                s["last"] = c.next()
        if c.peek(1) == "TIMES" or (c.peek() in self.names and c.peek(1) in ("TIMES", "(")):
            s["times"] = self.primary()
            c.expect("TIMES")
        c.skip("WITH")
        if c.take("TEST"):
            s["after"] = c.next() == "AFTER"
        if c.take("VARYING"):
            while True:
                v = self.variable()
                c.expect("FROM")
                a = self.expression()
                c.expect("BY")
                b = self.expression()
                c.expect("UNTIL")
                s["varying"].append((v, a, b, self.condition()))
                if not c.take("AFTER"):
                    break
        elif c.take("UNTIL"):
            s["until"] = self.condition()
        if s["first"] is None:
            s["body"] = self.statements()
            c.take("END-PERFORM")
        return s

    def s_go(self):
        c = self.c
        c.skip("TO")
        names = [c.next()]
        while c.peek() not in (".", "DEPENDING", "") and c.peek() not in VERBS | ENDS:
            names.append(c.next())
        on = None
        if c.take("DEPENDING"):
            c.skip("ON")
            on = self.variable()
        return {"kind": "GO TO", "names": names, "on": on}

    def s_stop(self):
        self.c.skip("RUN")
        if literal(self.c.peek()):
            self.c.next()
        return {"kind": "STOP"}

    def s_goback(self):
        return {"kind": "STOP"}

    def s_exit(self):
        what = self.c.next() if self.c.peek() in ("PROGRAM", "PARAGRAPH", "SECTION", "PERFORM") else ""
        if what == "PERFORM" and self.c.take("CYCLE"):
            what = "CYCLE"
        return {"kind": "STOP"} if what == "PROGRAM" else {"what": what}

    def s_continue(self):
        return {}

    def s_next(self):
        self.c.take("SENTENCE")
        return {"kind": "NEXT SENTENCE"}

    def s_initialize(self):
        names = [v for v, _ in self.targets()]
        while self.c.peek() in ("REPLACING", "NUMERIC", "ALPHANUMERIC", "DATA", "BY", "WITH", "FILLER", "VALUE", "ALL", "TO", "DEFAULT"):
            word = self.c.next()
            if word == "BY":
                self.primary()
        return {"targets": names}

    def s_set(self):
        c = self.c
        names = []
        while c.peek() not in ("TO", "UP", "DOWN", ""):
            names.append(self.variable())
        if c.take("TO"):
            if c.peek() in ("TRUE", "FALSE"):
                return {"targets": names, "to": ("bool", c.next() == "TRUE")}
            return {"targets": names, "to": self.expression()}
        sign = 1 if c.next() == "UP" else -1
        c.skip("BY")
        return {"targets": names, "by": self.expression() if sign == 1 else ("neg", self.expression())}

    def s_display(self):
        values = []
        while self.c.peek() not in (".", "") and self.c.peek() not in VERBS | ENDS | {"UPON", "WITH"}:
            values.append(self.primary())
        if self.c.take("UPON"):
            self.c.next()
        if self.c.take("WITH"):
            self.c.skip("NO", "ADVANCING")
        return {"values": values}

    def s_accept(self):
        v = self.variable()
        what = ""
        if self.c.take("FROM"):
            what = self.c.next()
            if self.c.peek() in ("YYYYMMDD", "YYYYDDD"):
                what += " " + self.c.next()
        return {"target": v, "from": what}

    def s_string(self):
        c = self.c
        parts, waiting = [], []
        while c.peek() != "INTO":
            waiting.append(self.primary())
            if c.take("DELIMITED"):
                c.skip("BY")
                by = None if c.take("SIZE") else self.primary()
                parts += [(w, by) for w in waiting]
                waiting = []
        parts += [(w, None) for w in waiting]
        c.expect("INTO")
        target = self.variable()
        pointer = None
        c.skip("WITH")
        if c.take("POINTER"):
            pointer = self.variable()
        return {"parts": parts, "target": target, "pointer": pointer} | self.handlers(("overflow", ("OVERFLOW",)), end="END-STRING")

    def s_unstring(self):
        c = self.c
        source, by = self.variable(), []
        if c.take("DELIMITED"):
            c.skip("BY")
            while True:
                every = c.take("ALL")
                by.append((self.primary(), every))
                if not c.take("OR"):
                    break
        c.expect("INTO")
        into = []
        while c.peek() in self.names:
            f = {"to": self.variable(), "delimiter": None, "count": None}
            if c.take("DELIMITER"):
                c.skip("IN")
                f["delimiter"] = self.variable()
            if c.take("COUNT"):
                c.skip("IN")
                f["count"] = self.variable()
            into.append(f)
        c.skip("WITH")
        pointer = self.variable() if c.take("POINTER") else None
        tally = None
        if c.take("TALLYING"):
            c.skip("IN")
            tally = self.variable()
        return {"source": source, "by": by, "into": into, "pointer": pointer, "tally": tally} | self.handlers(("overflow", ("OVERFLOW",)), end="END-UNSTRING")

    def _where(self) -> dict:
        out: dict = {"before": None, "after": None}
        while self.c.peek() in ("BEFORE", "AFTER"):
            side = self.c.next().lower()
            self.c.skip("INITIAL")
            out[side] = self.primary()
        return out

    def s_inspect(self):
        c = self.c
        v, actions = self.variable(), []
        while c.peek() in ("TALLYING", "REPLACING", "CONVERTING"):
            mode = c.next()
            if mode == "CONVERTING":
                a = self.primary()
                c.expect("TO")
                actions.append({"do": mode, "find": a, "by": self.primary()} | self._where())
            elif mode == "TALLYING":
                while c.peek() in self.names and c.peek(1) in ("FOR", "(", "OF"):
                    counter = self.variable()
                    c.expect("FOR")
                    while c.peek() in ("CHARACTERS", "ALL", "LEADING"):
                        what = c.next()
                        finds = [None] if what == "CHARACTERS" else [self.primary()]
                        where = self._where()
                        actions += [{"do": mode, "counter": counter, "what": what, "find": f} | where for f in finds]
            else:
                what = None
                while c.peek() in ("CHARACTERS", "ALL", "LEADING", "FIRST") or (what and (literal(c.peek()) or c.peek() in self.names)):
                    if c.peek() in ("CHARACTERS", "ALL", "LEADING", "FIRST"):
                        what = c.next()
                    f = None if what == "CHARACTERS" else self.primary()
                    c.expect("BY")
                    actions.append({"do": mode, "what": what, "find": f, "by": self.primary()} | self._where())
        return {"target": v, "actions": actions}

    def s_search(self):
        c = self.c
        every = c.take("ALL")
        v = self.variable()
        varying = self.variable() if c.take("VARYING") else None
        at_end = []
        if c.take("AT", "END") or c.take("END"):
            at_end = self.statements()
        whens = []
        while c.take("WHEN"):
            test = self.condition()
            whens.append(([[test]], self.statements()))
        c.take("END-SEARCH")
        return {"all": every, "table": v, "varying": varying, "at_end": at_end, "whens": whens}

    def s_call(self):
        c = self.c
        target, args = c.next(), []
        if c.take("USING"):
            while c.peek() not in (".", "") and c.peek() not in VERBS | ENDS | {"RETURNING"}:
                c.skip("BY", "REFERENCE", "CONTENT", "VALUE", ",")
                args.append(self.primary())
        if c.take("RETURNING"):
            self.variable()
        return {"target": target.strip("'\""), "static": target[:1] in "'\"", "args": args} | self.handlers(("overflow", ("OVERFLOW",)), ("invalid", ("EXCEPTION",)), end="END-CALL")

    def s_cancel(self):
        return {"target": self.c.next().strip("'\"")}

    def s_alter(self):
        names = []
        while self.c.peek() not in (".", ""):
            names.append(self.c.next())
        return {"names": [n for n in names if n not in ("TO", "PROCEED")]}

    def s_exec(self):
        kind, words = self.c.next(), []
        while self.c.peek() and not self.c.take("END-EXEC"):
            words.append(self.c.next())
        return {"kind": "EXEC", "what": f"EXEC {kind}", "text": " ".join(words)}

    def s_open(self):
        opened, mode = [], ""
        while self.c.peek() not in (".", "") and self.c.peek() not in VERBS | ENDS:
            t = self.c.next()
            if t in ("INPUT", "OUTPUT", "I-O", "EXTEND"):
                mode = t
            else:
                opened.append((t, mode))
        return {"files": opened}

    def s_close(self):
        names = []
        while self.c.peek() not in (".", "") and self.c.peek() not in VERBS | ENDS:
            names.append(self.c.next())
        return {"files": [(n, "") for n in names]}

    def s_read(self):
        c = self.c
        name = c.next()
        following = c.take("NEXT")
        c.skip("RECORD")
        into = self.variable() if c.take("INTO") else None
        key = None
        if c.take("KEY"):
            c.skip("IS")
            key = self.variable()
        return {"file": name, "next": following, "into": into, "key": key} | self.handlers(("at_end", ("END",)), ("invalid", ("INVALID", "KEY")), end="END-READ")

    def s_write(self):
        c = self.c
        name = c.next()
        source = self.primary() if c.take("FROM") else None
        advancing = None
        if c.peek() in ("BEFORE", "AFTER"):
            side = c.next()
            c.skip("ADVANCING")
            advancing = (side, c.next())
            c.skip("LINE", "LINES")
        return {"record": name, "from": source, "advancing": advancing} | self.handlers(("invalid", ("INVALID", "KEY")), ("at_end", ("END-OF-PAGE",)), end="END-WRITE")

    def s_rewrite(self):
        name = self.c.next()
        source = self.primary() if self.c.take("FROM") else None
        return {"record": name, "from": source} | self.handlers(("invalid", ("INVALID", "KEY")), end="END-REWRITE")

    def s_delete(self):
        name = self.c.next()
        self.c.skip("RECORD")
        return {"file": name} | self.handlers(("invalid", ("INVALID", "KEY")), end="END-DELETE")

    def s_start(self):
        c = self.c
        name, op, key = c.next(), "=", None
        if c.take("KEY"):
            op = self.relation() or "="
            key = self.variable()
        return {"file": name, "op": op, "key": key} | self.handlers(("invalid", ("INVALID", "KEY")), end="END-START")

    def _sort(self):
        c = self.c
        s: dict = {"file": c.next(), "keys": [], "using": [], "giving": [], "input": None, "output": None, "duplicates": False}
        while c.peek() not in (".", "") and (c.peek() not in VERBS):
            t = c.next()
            if t in ("ASCENDING", "DESCENDING"):
                c.skip("KEY", "IS")
                while c.peek() in self.names:
                    s["keys"].append((self.variable()[1], t == "ASCENDING"))
            elif t in ("USING", "GIVING"):
                while c.peek() not in (".", "", "GIVING", "OUTPUT", "INPUT") and c.peek() not in VERBS | ENDS:
                    s[t.lower()].append(c.next())
            elif t in ("INPUT", "OUTPUT"):
                c.skip("PROCEDURE", "IS")
                a = c.next()
                s[t.lower()] = (a, c.next() if c.take("THRU") or c.take("THROUGH") else a)
            elif t == "DUPLICATES":
                s["duplicates"] = True
        return s

    def s_sort(self):
        return self._sort()

    def s_merge(self):
        return self._sort()

    def s_release(self):
        name = self.c.next()
        return {"record": name, "from": self.primary() if self.c.take("FROM") else None}

    def s_return(self):
        name = self.c.next()
        self.c.skip("RECORD")
        into = self.variable() if self.c.take("INTO") else None
        return {"file": name, "into": into} | self.handlers(("at_end", ("END",)), end="END-RETURN")


def _names(items: list[Item]) -> tuple[set[str], set[str]]:
    names, conditions = set(), set()
    for i in items:
        names |= {i.name, *i.indexed}
        conditions |= set(i.conditions)
        a, b = _names(i.children)
        names |= a
        conditions |= b
    return names, conditions


def parse_program(source: str, library: Mapping[str, str] | None = None, conf: CobolConf | None = None) -> Program:
    """The tree of one program; raises SourceError where it can't be read (nothing is guessed)."""
    lines = source.count("\n") + 1
    given = conf or CobolConf()
    found = detect(source)
    conf = given if given != CobolConf() else found
    if found.decimal_point == ",":
        conf = replace(conf, decimal_point=",")
    text, copy_issues = expand_copies(cleaned(source), library or {})
    for name, value in re.findall(r"(?im)^\s*78\s+([\w-]+)\s+VALUE\s+(?:IS\s+)?('[^']*'|\"[^\"]*\"|[+-]?[\d.]*\d)\s*\.", text):
        text = re.sub(rf"(?im)^\s*78\s+{re.escape(name)}\s.*$", "", text)
        text = re.sub(rf"(?i)(?<![\w-]){re.escape(name)}(?![\w-])", lambda _, v=value: v, text)
    c = _Cursor(tokens(_guarded(text), conf.decimal_point == ","))
    name, items, linkage, files, using = "UNNAMED", [], [], {}, []
    blocks = [(f"EXEC {k.upper()}", b.strip()) for k, b in re.findall(r"(?is)\bEXEC\s+(SQL|CICS)\s+(.*?)\s*END-EXEC", text)]
    while c.peek() and not (c.peek() == "PROCEDURE" and c.peek(1) == "DIVISION"):
        t = c.next()
        if t == "PROGRAM-ID":
            c.skip(".")
            name = c.next().strip("'\"")
        elif t == "SELECT":
            c.skip("OPTIONAL")
            f = files.setdefault(c.next(), {"organization": "SEQUENTIAL", "key": None, "status": None, "records": []})
            while c.peek() and not c.take("."):
                w = c.next()
                if w in ("INDEXED", "RELATIVE", "SEQUENTIAL"):
                    f["organization"] = w
                    if w == "RELATIVE" and c.take("KEY"):
                        c.skip("IS")
                        f["key"] = c.next()
                elif w == "RECORD" and c.take("KEY"):
                    c.skip("IS")
                    f["key"] = c.next()
                elif w == "STATUS":
                    c.skip("IS")
                    f["status"] = c.next()
        elif t in ("FD", "SD"):
            file = c.next()
            while c.peek() and not c.take("."):
                c.next()
            own = _data(c)
            files.setdefault(file, {"organization": "SEQUENTIAL", "key": None, "status": None, "records": []})["records"] = own
            files[file]["sort"] = t == "SD"
            items += own
        elif t in ("WORKING-STORAGE", "LOCAL-STORAGE") and c.take("SECTION"):
            c.skip(".")
            items += _data(c)
        elif t == "LINKAGE" and c.take("SECTION"):
            c.skip(".")
            linkage = _data(c)
    program = Program(name, conf, items, [], files, linkage, using, blocks, copy_issues, lines=lines)
    if not c.peek():
        return program
    c.next()
    c.next()
    if c.take("USING"):
        while c.peek() and c.peek() != ".":
            if (w := c.next()) not in ("BY", "REFERENCE", "VALUE"):
                using.append(w)
    c.skip(".")
    names, conditions = _names(items + linkage)
    names |= {f for f in files} | {"RETURN-CODE", "SQLCODE", "SQLSTATE", "EIBRESP"}
    p = _Procedure(c, names, conditions)
    current = Paragraph(None, c.line)
    program.paragraphs.append(current)
    while c.peek():
        if c.take("END", "PROGRAM"):
            break
        if c.peek() == "IDENTIFICATION" and c.peek(1) == "DIVISION":
            program.issues.append(("nested program", "split it off", "HIGH"))
            break
        if c.peek(1) == "SECTION" and c.peek(2) == ".":
            current = Paragraph(c.next(), c.line, section=True)
            c.at += 2
            program.paragraphs.append(current)
            continue
        if c.peek(1) == "." and c.peek() not in VERBS and re.match(r"[A-Z0-9]", c.peek()):
            current = Paragraph(c.next(), c.line)
            c.next()
            program.paragraphs.append(current)
            continue
        if c.take("."):
            current.body.append({"kind": "SENTENCE", "line": c.line})
            continue
        if c.peek() not in VERBS:
            raise SourceError(f"line {c.line}: not a statement: {c.peek()}")
        current.body.append(p.statement())
        if c.peek() in ENDS and c.peek() not in ("END",):
            c.next()
    program.paragraphs = [x for x in program.paragraphs if x.name or any(s["kind"] != "SENTENCE" for s in x.body)]
    program.issues += review(program)
    return program


REVIEW = {
    "ALTER": ("ALTER changes control flow at run time", "rewrite with PERFORM or EVALUATE", "CRITICAL"), "CALL": ("CALL of another program", "verify the program called", "MEDIUM"), "CANCEL": ("CANCEL of another program", "check the state it resets", "LOW"),
    "MERGE": ("MERGE", "use the sort operators", "MEDIUM"), "EXEC": ("embedded SQL or CICS", "supply its effects as inputs", "HIGH"),
}


#: Functions that programs may use.
FUNCTIONS = frozenset("INTEGER INTEGER-PART MAX MIN ABS MOD REM SUM SQRT EXP NUMVAL LENGTH UPPER-CASE LOWER-CASE TRIM REVERSE ORD CURRENT-DATE".split())


def _functions(x):
    """Names of the functions in a statement's expressions."""
    if isinstance(x, dict):
        x = [v for k, v in x.items() if k not in ("then", "else", "body", "whens", "other", "size_error", "not_size_error")]
    if isinstance(x, tuple) and len(x) > 1 and x[0] == "fn":
        yield x[1]
    if isinstance(x, (tuple, list)):
        for y in x:
            yield from _functions(y)


def review(program: Program) -> list[tuple[str, str, str]]:
    """``(reason, recommendation, severity)`` of what isn't run, or not as it stands."""
    groups = {x.name for top in program.items + program.linkage for x in _every(top) if x.children}
    places, out = {x.name for x in program.paragraphs}, []
    for _, s in program.every():
        kind = s["kind"]
        if kind in REVIEW:
            out.append(REVIEW[kind])
        if kind == "SORT" and not s["duplicates"] and s["using"]:
            out.append(("SORT without DUPLICATES", "order of equal keys is by input", "LOW"))
        if kind == "PERFORM" and s["first"] and not {s["first"], s["last"]} <= places:
            out.append((f"PERFORM of {s['first']}, which isn't there", "check the paragraph's name and copybooks", "HIGH"))
        if kind == "GO TO" and not set(s["names"]) <= places:
            out.append(("GO TO a paragraph that isn't there", "check the paragraph's name and copybooks", "HIGH"))
        if kind == "CORRESPONDING" and not {s["from"], s["to"]} <= groups:
            out.append(("CORRESPONDING of what is no group", "check that a copybook defines the group", "MEDIUM"))
        if kind == "INSPECT":
            for a in s["actions"]:
                ends = [a.get("find"), a.get("by")]
                if a["do"] == "CONVERTING" and all(e and e[0] == "str" for e in ends) and len(ends[0][1]) != len(ends[1][1]):
                    out.append(("INSPECT CONVERTING of unequal lengths", "give both texts one length", "MEDIUM"))
        out += [(f"FUNCTION {f} isn't known", "compute it in another way", "MEDIUM") for f in sorted(set(_functions(s)) - FUNCTIONS)]
    for top in program.items:
        out += [(f"OCCURS DEPENDING of {x.name}", "tables have their greatest size", "LOW") for x in _every(top) if x.depending]
    return out + [(f"copybook {m}: {why}", "supply it", "HIGH") for m, why in program.copy_issues]


def facts(name: str, source: str, library: Mapping[str, str] | None = None) -> dict[str, list[tuple]]:
    """Rows for the portfolio tables; a source that can't be read gives one row in ``errors`` and no others."""
    out: dict[str, list[tuple]] = {k: [] for k in ("programs", "statements", "variables", "edges", "paragraphs", "blocks", "linkage", "copies", "computes", "issues", "errors", "storage", "moves")}
    try:
        p = parse_program(source, library)
    except (SourceError, PictureError, ValueError, RecursionError, IndexError, KeyError, AttributeError) as e:
        out["errors"].append((name, str(e)[:300]))
        return out
    found = {m[1].lower(): m[2].upper() for m in re.finditer(r"(?i)\b(TRUNC|ARITH|NUMPROC)\s*\(\s*(\w+)", "\n".join(x for x in source.splitlines() if CARD.match(x)))}
    out["programs"].append((p.name, p.lines, source, found.get("trunc"), found.get("arith"), found.get("numproc"), "COMMA" if p.conf.decimal_point == "," else None))
    ends = {"GO TO", "STOP"}
    for i, x in enumerate(q for q in p.paragraphs if q.name):
        out["paragraphs"].append((p.name, i, x.name, x.line, any(s["kind"] in ends for s in walk(x.body))))
    for k, (q, s) in enumerate(p.every()):
        kind = s["kind"]
        if kind == "SENTENCE":
            continue
        detail = {"+": "ADD", "-": "SUBTRACT", "*": "MULTIPLY", "/": "DIVIDE"}[s["op"]] if kind == "ARITHMETIC" else kind
        out["statements"].append((p.name, k, q.name, kind, detail + (" SIZE ERROR" if "size_error" in s else ""), s["line"]))
        if kind == "PERFORM" and s["first"]:
            out["edges"].append((p.name, q.name, s["first"], "PERFORM", None))
            if s["last"] != s["first"]:
                out["edges"].append((p.name, q.name, s["last"], "THRU", s["first"]))
        elif kind == "GO TO":
            out["edges"] += [(p.name, q.name, n, "GO TO", None) for n in s["names"]]
        elif kind == "ALTER":
            out["edges"] += [(p.name, q.name, n, "ALTER", None) for n in s["names"]]
        elif kind == "COMPUTE":
            e = s["value"]
            simple = lambda x: x[1] if x[0] == "var" else str(x[1]) if x[0] == "num" else None
            op, a, b = (e[1], simple(e[2]), simple(e[3])) if e[0] == "bin" else ("=", simple(e), None)
            out["computes"].append((p.name, k, s["targets"][0][0][1], op if a and (b or op == "=") and op != "**" else "?", a, b))
        elif kind == "MOVE" and s["value"][0] == "var":
            plain = lambda v: not v[2] and v[3] is None
            out["moves"] += [(p.name, k, s["line"], s["value"][1], v[1], plain(s["value"]) and plain(v)) for v in s["targets"]]
    for item in p.items + p.linkage:
        for x in _every(item):
            if x.pic:
                out["variables"].append((p.name, x.name, x.pic.picture, x.pic.usage, x.pic.signed, x.pic.int_digits, x.pic.dec_digits, x.occurs, bool(x.depending), x.redefines))
    out["blocks"] = [(p.name, k, kind, re.match(r"\w*", body)[0].upper(), body) for k, (kind, body) in enumerate(p.blocks)]
    out["linkage"] = [(p.name, k, n) for k, n in enumerate(p.using)]
    out["copies"] = [(p.name, m, why) for m, why in p.copy_issues]
    out["issues"] = [(p.name, *i) for i in p.issues]
    try:
        out["storage"] = [(p.name, k, *x) for k, x in enumerate([*_storage("WORKING", p.items), *_storage("LINKAGE", p.linkage)])]
    except LayoutError as e:
        out["issues"].append((p.name, str(e), "Define the redefined item before, on the same level.", "HIGH"))
    return out


def _storage(section: str, items: list[Item]) -> list[tuple]:
    """``(region, name, offset, length, kind, leaf, redefines)`` of all items. A table of groups is one range of its region, and a region of its own (its first occurrence) for what is inside."""
    out: list[tuple] = []

    def add(item: Item, region: str, base: int) -> None:
        table = bool(item.children) and item.occurs > 1
        kind = ("number" if item.pic.is_number or item.pic.kind == "float" else "text") if item.pic else "group"
        out.append((region, item.name, item.offset - base, item.length, kind, table or not item.children, item.redefines))
        for c in item.children:
            add(c, *((f"{region}/{item.name}@{item.offset - base}", item.offset) if table else (region, base)))

    place(items)
    for item in items:
        add(item, section, 0)
    return out


def _every(item: Item):
    yield item
    for c in item.children:
        yield from _every(c)


#: Schemas of the fact tables.
TABLES = {
    "programs": "program string, lines int, source string, trunc string, arith string, numproc string, decimal_point string",
    "statements": "program string, seq int, paragraph string, kind string, detail string, line int",
    "variables": "program string, name string, picture string, storage string, signed boolean, int_digits int, dec_digits int, occurs int, odo boolean, redefines string",
    "edges": "program string, src string, dst string, kind string, first string",
    "paragraphs": "program string, idx int, name string, line int, ends boolean",
    "blocks": "program string, seq int, kind string, verb string, body string",
    "linkage": "program string, position int, name string",
    "copies": "program string, copybook string, reason string",
    "computes": "program string, seq int, target string, op string, left string, right string",
    "issues": "program string, reason string, recommendation string, severity string",
    "errors": "program string, error string",
    "storage": "program string, seq int, region string, name string, offset int, length int, kind string, leaf boolean, redefines string",
    "moves": "program string, seq int, line int, source string, target string, whole boolean",
}


def portfolio(spark, sources, library: Mapping[str, str] | None = None, name_col: str = "name", source_col: str = "source") -> Callable:
    """A function from table name to DataFrame over a DataFrame of sources. Each program is parsed once, in a Python map, into a row with a list of
    facts for each table; the rows are cached, as analytics read several tables. Sources are counted and dealt to tasks of equal numbers of them first."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, StructField, StructType, _parse_datatype_string

    from tallyframe.plans.scratch import spread

    library = dict(library or {})
    schema = StructType([StructField(name, ArrayType(_parse_datatype_string(columns))) for name, columns in TABLES.items()])
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for b in batches:
            found = [facts(n, s or "", library) for n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in found], f.type) for f in arrow], schema=arrow)

    parsed = spread(sources.select(name_col, source_col)).mapInArrow(rows, schema).cache()
    return lambda which: parsed.select(F.inline(which))
