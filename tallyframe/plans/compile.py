"""Row programs as columns: straight-line code, conditions and bounded loops become a chain of projections.

Every assignment makes a new version of a variable's column; a branch's assignments keep the old
version where its test fails. What has no exact column form (unbounded loops, GO TO, tables, overlays,
intermediates above 38 digits) raises ``NotNative``, and the caller runs the tree in Arrow batches: over whole columns (``plans.columns``)
where that has a form for all statements, else record by record.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import codecs, edited, exact, predicates, strings
from tallyframe.functions.pic import Pic
from tallyframe.functions.store import dec, decimal_of, divided, kept_whole, rounded, size_error, store
from tallyframe.plans import interp
from tallyframe.plans.columns import Columns, NotColumns
from tallyframe.plans.lang import Program
from tallyframe.plans.scratch import spread
from tallyframe.sources.layout import Item

UNROLL = 50
#: Limbs of wide numbers that one generated method works out: the JVM compiles none above 8,000 bytes.
TOGETHER = 10
#: Records of a task that runs them one by one (tenths of a millisecond each).
RECORDS = 10_000


class NotNative(Exception):
    pass


class Number:
    """A decimal column and the digits that it can have."""

    def __init__(self, col: Column, ints: int, decs: int):
        if ints + decs > 38:
            raise NotNative("an intermediate result above 38 digits")
        self.col, self.ints, self.decs = col, max(ints, 1), decs

    @property
    def kind(self) -> str:
        return f"decimal({min(38, self.ints + self.decs)},{self.decs})"


def _literal(d: Decimal) -> Number:
    t = d.as_tuple()
    decs = max(0, -t.exponent)
    ints = max(1, len(t.digits) + t.exponent)
    return Number(dec(d, ints + decs, decs), ints, decs)


class Compiler:
    def __init__(self, program: Program):
        self.p, self.conf = program, program.conf
        self.items: dict[str, Item] = {}
        self.conditions: dict[str, tuple[Item, list]] = {}
        for top in program.items:
            self._add(top, False)
        self.at = {x.name: i for i, x in enumerate(program.paragraphs)}

    def _add(self, item: Item, inside: bool) -> None:
        if item.redefines or item.renames or item.occurs > 1 or item.name in self.items and item.name != "FILLER":
            inside = True
        self.items[item.name] = item
        item_native = not inside
        item.__dict__["native"] = item_native
        for name, values in item.conditions.items():
            self.conditions[name] = (item, values)
        for c in item.children:
            self._add(c, inside)

    def pic(self, name: str) -> Pic:
        item = self.items.get(name)
        if item is None or not item.__dict__["native"] or item.children or item.pic is None:
            raise NotNative(f"{name} is no plain field")
        if item.pic.kind == "float" or item.pic.scale_p:
            raise NotNative(f"{name} is no decimal")
        return item.pic

    # Expressions ----------------------------------------------------------------------------------------

    def field(self, v) -> tuple[Column, Pic]:
        if v[2] or v[3] is not None:
            raise NotNative("subscript or reference modification")
        pic = self.pic(v[1])
        return self.current(v[1], pic), pic

    def current(self, name: str, pic: Pic) -> Column:
        if name not in self.versions:
            self._assign(name, self._initial(self.items[name], pic))
        return F.col(self.versions[name])

    def _initial(self, item: Item, pic: Pic) -> Column:
        v = interp.Machine._initial(self.machine, item)
        return F.lit(v).cast(pic.spark_type) if isinstance(v, Decimal) else F.lit(v)

    def number(self, e) -> Number:
        k = e[0]
        if k == "num":
            return _literal(e[1])
        if k == "fig" and e[1] == "ZERO":
            return _literal(Decimal(0))
        if k == "var":
            col, pic = self.field(e)
            if not pic.is_number:
                raise NotNative("a number was expected")
            t = pic.spark_type
            return Number(col, t.precision - t.scale, t.scale)
        if k == "neg":
            n = self.number(e[1])
            return Number(-n.col, n.ints, n.decs)
        if k == "fn":
            args = [self.number(a) for a in e[2]] if e[1] in ("INTEGER", "INTEGER-PART", "ABS", "MAX", "MIN", "MOD", "REM") else []
            if e[1] in ("INTEGER", "INTEGER-PART"):
                return Number(strings.integer(args[0].col).cast(f"decimal({args[0].ints},0)"), args[0].ints, 0)
            if e[1] == "ABS":
                return Number(F.abs(args[0].col), args[0].ints, args[0].decs)
            if e[1] in ("MAX", "MIN"):
                ints, decs = max(a.ints for a in args), max(a.decs for a in args)
                cols = [a.col.cast(f"decimal({ints + decs},{decs})") for a in args]
                return Number((strings.maximum if e[1] == "MAX" else strings.minimum)(*cols), ints, decs)
            if e[1] in ("MOD", "REM"):
                return Number(strings.mod(args[0].col, args[1].col), args[1].ints, max(a.decs for a in args))
            raise NotNative(f"FUNCTION {e[1]}")
        if k == "bin" and e[1] in "+-*":
            a, b = self.number(e[2]), self.number(e[3])
            if e[1] == "*":
                return Number(a.col.cast(a.kind) * b.col.cast(b.kind), a.ints + b.ints, a.decs + b.decs)
            ints, decs = max(a.ints, b.ints) + 1, max(a.decs, b.decs)
            return Number(a.col.cast(a.kind) + b.col.cast(b.kind) if e[1] == "+" else a.col.cast(a.kind) - b.col.cast(b.kind), ints, decs)
        if k == "bin" and e[1] == "**" and e[3][0] == "num" and e[3][1] == int(e[3][1]) and 1 <= e[3][1] <= 4:
            n = out = self.number(e[2])
            for _ in range(int(e[3][1]) - 1):
                out = Number(out.col.cast(out.kind) * n.col.cast(n.kind), out.ints + n.ints, out.decs + n.decs)
            return out
        raise NotNative(f"expression {k} {e[1] if len(e) > 1 else ''}")

    def stored_value(self, e, scale: int, pic: Pic) -> Column:
        """An expression for the field ``pic``, with ``scale`` decimals: a quotient on top is truncated there; null for a division by zero. What needs more than 38 digits is
        worked out in limbs and narrowed to what the field can show of it; binary fields that keep the whole value can't have that."""
        try:
            if e[0] == "bin" and e[1] == "/":
                a, b = self.number(e[2]), self.number(e[3])
                if a.ints + a.decs + max(0, scale + b.decs - a.decs) > 32 or b.ints + b.decs + max(0, a.decs - scale - b.decs) > 36:
                    raise NotNative("a quotient above 38 digits")
                return divided(a.col.cast(a.kind), a.decs, b.col.cast(b.kind), b.decs, scale)
            return self.number(e).col
        except NotNative as reason:
            if "above 38 digits" not in str(reason) or kept_whole(pic, self.conf) or pic.kind == "float" or pic.int_digits + 1 + scale > 38:
                raise
        ints = pic.int_digits
        if e[0] != "bin" or e[1] != "/":
            return exact.digits_narrowed(exact.wide_digits(self.wide(e), self._keep), ints, scale)
        a = self.wide(e[2])
        b, digits = self.wide_number(e[3], exact.DIVISOR)
        quotient = exact.wide_quotient(a, b, digits, scale, self._keep)
        if quotient:
            return exact.digits_narrowed(quotient, ints, scale)
        a, b = self._keep(*(exact.wide_digits(x, self._keep).number for x in (a, b)))
        return exact.narrowed(*self._keep(exact.quotient(a, b, scale)), ints, scale)

    def _keep(self, *values: Column) -> list[Column]:
        """Columns of these values, named in one projection."""
        names = []
        for _ in values:
            self.count += 1
            names.append(f"__{self.count}_wide")
        self.df = self.df.select("*", *(v.alias(n) for v, n in zip(values, names, strict=True)))
        self.limbs += len(names)
        if self.limbs >= TOGETHER:  # to more partitions than there are: moves no row, but ends the stage's generated method
            self.df, self.limbs = self.df.coalesce(2**30), 0
        return [F.col(n) for n in names]

    def wide(self, e) -> exact.Wide:
        """A sum or product of any number of digits."""
        if e[0] == "bin" and e[1] in "+-*":
            a, b = self.wide(e[2]), self.wide(e[3])
            return exact.wide_product(a, b, self._keep) if e[1] == "*" else exact.wide_sum(a, b if e[1] == "+" else exact.wide_negated(b), self._keep)
        if e[0] == "neg":
            return exact.wide_negated(self.wide(e[1]))
        return self.wide_number(e)[0]

    def wide_number(self, e, most: int = 0) -> tuple[exact.Wide, int]:
        """What fits a decimal, and how many digits it can have; ``most``: it must have no more."""
        n = self.number(e)
        digits = min(38, n.ints + n.decs)
        if most and digits > most:
            raise NotNative("a divisor of too many digits")
        return exact.fixed(n.col, digits, n.decs, self._keep), digits

    def text(self, e) -> Column:
        k = e[0]
        if k in ("str", "all"):
            return F.lit(e[1])
        if k == "num":
            return F.lit(str(e[1]))
        if k == "fig":
            return F.lit(interp.Machine._fig(e[1], 1))
        if k == "var":
            if e[3] is not None and not e[2] and e[3][0][0] == "num" and (e[3][1] is None or e[3][1][0] == "num"):
                pic = self.pic(e[1])
                if pic.is_number:
                    raise NotNative("reference modification of a number")
                return strings.refmod(self.current(e[1], pic), int(e[3][0][1]), int(e[3][1][1]) if e[3][1] else None)
            col, pic = self.field(e)
            return codecs._digits(col, pic) if pic.is_number else col
        if k == "fn" and e[1] in ("UPPER-CASE", "LOWER-CASE", "TRIM", "REVERSE"):
            return {"UPPER-CASE": F.upper, "LOWER-CASE": F.lower, "TRIM": F.trim, "REVERSE": F.reverse}[e[1]](self.text(e[2][0]))
        raise NotNative("a text was expected")

    def is_number(self, e) -> bool:
        if e[0] == "var":
            return e[3] is None and self.pic(e[1]).is_number
        return e[0] in ("num", "neg", "bin") or (e[0] == "fn" and e[1] in ("INTEGER", "INTEGER-PART", "ABS", "MAX", "MIN", "MOD", "REM"))

    def test(self, c) -> Column:
        k = c[0]
        if k == "and":
            return self.test(c[1]) & self.test(c[2])
        if k == "or":
            return self.test(c[1]) | self.test(c[2])
        if k == "not":
            return ~self.test(c[1])
        if k == "rel":
            return self.relation(c[1], c[2], c[3])
        if k == "cond":
            if c[2]:
                raise NotNative("subscript")
            item, values = self.conditions[c[1]]
            v, out = ("var", item.name, (), None), None
            for x in values:
                one = self.relation(">=", v, x[1]) & self.relation("<=", v, x[2]) if x[0] == "range" else self.relation("=", v, x)
                out = one if out is None else out | one
            return out
        if k == "class":
            return F.lit(True) if c[2] == "NUMERIC" and self.is_number(c[1]) else predicates.is_class(self.text(c[1]), c[2])
        if k == "sign":
            n = self.number(c[1]).col
            return {"POSITIVE": n > 0, "NEGATIVE": n < 0, "ZERO": n == 0}[c[2]]
        raise NotNative("condition")

    def relation(self, op: str, a, b) -> Column:
        zero = lambda e: e[0] == "fig" and e[1] == "ZERO"
        if (self.is_number(a) or zero(a)) and (self.is_number(b) or zero(b)):
            return predicates.relation(self.number(a).col, op, self.number(b).col)
        if self.is_number(a) != self.is_number(b) and "fig" not in (a[0], b[0]):
            raise NotNative("number against text")
        x, y = self.text(a), self.text(b)
        if a[0] == "fig":
            x = F.repeat(x, F.length(y))
        if b[0] == "fig":
            y = F.repeat(y, F.length(x))
        return predicates.relation(x, op, y, True, self.conf.codepage)

    # Statements -----------------------------------------------------------------------------------------

    def _new(self, label: str, value: Column) -> str:
        self.count += 1
        name = f"__{self.count}_{strings.identifier(label)}"
        self.df = self.df.withColumn(name, value)
        return name

    def _assign(self, name: str, value: Column) -> None:
        pic = self.pic(name)
        value = value.cast(pic.spark_type)
        if self.guard is not None and name in self.versions:
            value = F.when(self.guard, value).otherwise(F.col(self.versions[name]))
        elif self.guard is not None:
            value = F.when(self.guard, value).otherwise(self._initial(self.items[name], pic))
        self.versions[name] = self._new(name, value)

    def _under(self, test: Column, body: list[dict]) -> None:
        if not body:
            return
        outer = self.guard
        self.guard = test if outer is None else outer & test
        self.body(body)
        self.guard = outer

    def body(self, body: list[dict]) -> None:
        for s in body:
            if self.stopped:
                return
            getattr(self, "c_" + s["kind"].replace(" ", "_").lower(), self.c_unknown)(s)
            if self.count > 400:
                raise NotNative("too many steps for one plan")

    def c_unknown(self, s):
        raise NotNative(s["kind"])

    def c_sentence(self, s):
        pass

    c_continue = c_sentence

    def c_exit(self, s):
        if s["what"]:
            raise NotNative("EXIT")

    def c_stop(self, s):
        if self.guard is not None:
            raise NotNative("conditional STOP")
        self.stopped = True

    def c_move(self, s):
        e = s["value"]
        for t in s["targets"]:
            if t[2] or t[3] is not None:
                raise NotNative("subscript or reference modification")
            pic = self.pic(t[1])
            if pic.is_number or pic.kind == "edited":
                n = self.number(e) if self.is_number(e) or e[0] == "fig" else None
                if n is None:
                    raise NotNative("text to number")
                self._assign(t[1], store(n.col, pic, self.conf) if pic.is_number else edited.edited(n.col, pic, self.conf.currency))
            elif e[0] == "fig":
                self._assign(t[1], F.lit(interp.Machine._fig(e[1], pic.length)))
            elif e[0] == "all":
                self._assign(t[1], F.lit((e[1] * pic.length)[: pic.length]))
            else:
                self._assign(t[1], strings.move_text(self.text(e), pic))

    def _finish(self, s, v, value: Column, is_rounded: bool) -> Column | None:
        """Store; the size error flag if the statement asks for one."""
        if v[2] or v[3] is not None:
            raise NotNative("subscript")
        pic = self.pic(v[1])
        if pic.kind == "edited":
            raise NotNative("arithmetic into an edited field")
        value = F.col(self._new(v[1], rounded(value, pic.dec_digits) if is_rounded else value))
        if "size_error" in s or "not_size_error" in s:
            bad = F.col(self._new("size", F.coalesce(size_error(value, pic, self.conf), F.lit(True))))
            old = self.current(v[1], pic)
            self._assign(v[1], F.when(bad, old).otherwise(store(value, pic, self.conf)))
            return bad
        self._assign(v[1], F.coalesce(store(value, pic, self.conf), self.current(v[1], pic)))
        return None

    def _handlers(self, s, flags: list[Column]) -> None:
        if flags:
            bad = flags[0]
            for f in flags[1:]:
                bad = bad | f
            bad = F.col(self._new("bad", bad))
            self._under(bad, s.get("size_error", []))
            self._under(~bad, s.get("not_size_error", []))

    def c_compute(self, s):
        values = [(v, self.stored_value(s["value"], self.pic(v[1]).dec_digits + r, self.pic(v[1])), r) for v, r in s["targets"]]
        self._handlers(s, [f for f in (self._finish(s, *x) for x in values) if f is not None])

    def c_arithmetic(self, s):
        op, values, flags = s["op"], s["values"], []
        total = values[0]
        for x in values[1:]:
            total = ("bin", "+", total, x)
        for v, r in s["targets"]:
            if s["giving"]:
                e = values[0]
                for x in values[1:]:
                    e = ("bin", op, e, x)
            else:
                e = ("bin", op, v, total if op in "+-" else values[0])
            flags.append(self._finish(s, v, self.stored_value(e, self.pic(v[1]).dec_digits + r, self.pic(v[1])), r))
        if s.get("remainder"):
            pic = self.pic(s["targets"][0][0][1])
            a, b = self.number(values[0]), self.number(values[1])
            q = self.stored_value(("bin", "/", *values), pic.dec_digits, pic)
            target = self.pic(s["remainder"][1])
            if not self.guard_free(s):
                raise NotNative("remainder")
            rest = a.col.cast("decimal(30,8)") - (q.cast(f"decimal(19,{min(8, pic.dec_digits)})") * b.col.cast("decimal(14,4)")).cast("decimal(30,8)")
            self._assign(s["remainder"][1], F.coalesce(store(rest, target, self.conf), self.current(s["remainder"][1], target)))
        self._handlers(s, [f for f in flags if f is not None])

    @staticmethod
    def guard_free(s) -> bool:
        """A remainder of the original operands: they must not be the quotient's target."""
        return not any(v[1] == e[1] for v, _ in s["targets"] for e in s["values"] if e[0] == "var")

    def c_if(self, s):
        t = F.col(self._new("if", F.coalesce(self.test(s["test"]), F.lit(False))))
        self._under(t, s["then"])
        self._under(~t, s["else"])

    def c_evaluate(self, s):
        before = F.lit(False)
        for tests, body in s["whens"]:
            one = None
            for parts in tests:
                every = F.lit(True)
                for c in parts:
                    if c is not None:
                        every = every & self.test(c)
                one = every if one is None else one | every
            t = F.col(self._new("when", ~before & F.coalesce(one, F.lit(False))))
            self._under(t, body)
            before = before | t
        self._under(~before, s["other"])

    def c_perform(self, s):
        if s["until"] is not None or s["varying"]:
            raise NotNative("a loop on data")
        times = 1
        if s["times"] is not None:
            if s["times"][0] != "num" or s["times"][1] > UNROLL:
                raise NotNative("a loop on data")
            times = int(s["times"][1])
        for _ in range(times):
            if s["first"]:
                if s["first"] not in self.at or s["last"] not in self.at or self.p.paragraphs[self.at[s["first"]]].section:
                    raise NotNative("PERFORM of a section")
                self.depth += 1
                if self.depth > 20:
                    raise NotNative("recursion")
                for x in self.p.paragraphs[self.at[s["first"]] : self.at[s["last"]] + 1]:
                    self.body(x.body)
                self.depth -= 1
            else:
                self.body(s["body"])

    def c_initialize(self, s):
        for v in s["targets"]:
            for x in self.items[v[1]].leaves():
                if x.name == "FILLER":
                    continue
                pic = self.pic(x.name)
                self._assign(x.name, edited.edited(dec(0, 2, 1), pic) if pic.kind == "edited" else dec(0) if pic.is_number else F.lit(" " * pic.length))

    def c_set(self, s):
        for v in s["targets"]:
            if "by" in s or s["to"][0] != "bool" or not s["to"][1]:
                raise NotNative("SET")
            item, values = self.conditions[v[1]]
            x = values[0][1] if values[0][0] == "range" else values[0]
            self.c_move({"value": x, "targets": [("var", item.name, (), None)]})

    def c_display(self, s):
        line = F.concat(*(self.text(v) for v in s["values"]))
        self.shown.append(F.col(self._new("display", line if self.guard is None else F.when(self.guard, line))))

    def c_accept(self, s):
        self.c_move({"value": ("str", self.value_of(s["from"])), "targets": [s["target"]]})

    def value_of(self, what: str) -> str:
        raise NotNative("ACCEPT")

    def c_string(self, s):
        if s["pointer"] or "overflow" in s or "not_overflow" in s:
            raise NotNative("STRING with a pointer")
        col, pic = self.field(s["target"])
        parts = [(self.text(e), None if by is None else self.text(by)) for e, by in s["parts"]]
        self._assign(s["target"][1], strings.string(parts, col, pic.length)[0])

    def c_unstring(self, s):
        if s["pointer"] or "overflow" in s or "not_overflow" in s or any(d[0] not in ("str", "fig") for d, _ in s["by"]) or not s["by"]:
            raise NotNative("UNSTRING")
        source = F.col(self._new("source", self.text(s["source"])))
        found = strings.unstring(source, [(interp.Machine._fig(d[1], 1) if d[0] == "fig" else d[1], every) for d, every in s["by"]], len(s["into"]))
        filled = []
        for f, x in zip(s["into"], found, strict=True):
            name = f["to"][1]
            old, pic = self.field(f["to"])
            if pic.is_number or pic.kind == "edited":
                raise NotNative("UNSTRING into a number")
            have = F.col(self._new("have", x["text"].isNotNull() & (F.lit(True) if not filled else (F.length(source) > 0))))
            filled.append(have)
            self._assign(name, F.when(have, strings.move_text(x["text"], pic)).otherwise(old))
            if f["delimiter"] or f["count"]:
                raise NotNative("UNSTRING with counts")
        if s["tally"]:
            raise NotNative("UNSTRING TALLYING")

    def c_inspect(self, s):
        plain = lambda e: e is None or e[0] in ("str", "fig")
        as_text = lambda e, n=1: None if e is None else interp.Machine._fig(e[1], n) if e[0] == "fig" else e[1]
        for a in s["actions"]:
            col, pic = self.field(s["target"])
            if pic.is_number or not all(plain(a.get(k)) for k in ("find", "by", "before", "after")):
                raise NotNative("INSPECT")
            where = (as_text(a["before"]), as_text(a["after"]))
            find = as_text(a.get("find")) or ""
            if a["do"] == "TALLYING":
                n = strings.tally(col, a["what"], find, *where).cast("decimal(9,0)")
                target = self.pic(a["counter"][1])
                if self.conf.tally_adds:
                    n = n + self.current(a["counter"][1], target)
                self._assign(a["counter"][1], store(n, target, self.conf))
            elif a["do"] == "CONVERTING":
                self._assign(s["target"][1], strings.converting(col, find, as_text(a["by"], len(find)), *where))
            else:
                self._assign(s["target"][1], strings.replacing(col, a["what"], find, as_text(a["by"], max(1, len(find))), *where))

    # The whole ------------------------------------------------------------------------------------------

    def over(self, df: DataFrame, inputs: Mapping[str, str], outputs: Mapping[str, str]) -> DataFrame:
        """``_rec``, the outputs as text, ``_error`` (of inputs that are no numbers) and ``_display``."""
        self.machine = interp.Machine(self.p)
        self.df, self.versions, self.guard, self.count, self.limbs, self.depth, self.stopped, self.shown = df, {}, None, 0, 0, 0, False, []
        wrong: list[Column] = []
        for col, var in inputs.items():
            pic = self.pic(var)
            given = df[col]
            if not pic.is_number:
                value = strings.move_text(given.cast("string"), pic)
            elif isinstance(df.schema[col].dataType, T.DecimalType):
                value = store(given, pic, self.conf)
            else:  # cut as the picture says, not rounded by a cast
                text = F.trim(given.cast("string"))
                number = F.col(self._new("given", exact.canonical(F.when(text == "", "0").otherwise(text))))
                wrong.append(F.when(given.isNotNull() & number.isNull(), F.concat(F.lit(f"ValueError: {col} is no number: "), F.left(text, F.lit(100)))))
                value = store(exact.cut(number, 37 - pic.dec_digits, pic.dec_digits), pic, self.conf)
            self._assign(var, F.coalesce(value, self._initial(self.items[var], pic)))
        error = F.col(self._new("error", F.coalesce(*wrong))) if wrong else F.lit(None).cast("string")
        for x in self.p.paragraphs:
            self.body(x.body)
            if self.stopped:
                break
        out = []
        for col, var in outputs.items():
            pic = self.pic(var)
            value = self.current(var, pic)
            text = value.cast("string") if pic.is_number else value if pic.kind == "edited" else F.rtrim(value)
            out.append((F.when(error.isNull(), text) if wrong else text).alias(col))
        shown = F.array_compact(F.array(*self.shown)) if self.shown else F.array().cast("array<string>")
        return self.df.select("_rec", *out, error.alias("_error"), shown.alias("_display"))


def execute(program: Program, df: DataFrame, inputs: Mapping[str, str], outputs: Mapping[str, str], route: str = "auto") -> tuple[DataFrame, str]:
    """Run a row program over ``df`` (``_rec`` and input columns; ``inputs`` and ``outputs`` map columns to variables). Returns the results and the
    route taken: ``native``, ``arrow columns: reason`` or ``arrow: reason``; ``route`` may ask for ``native``, ``columns`` or ``arrow``."""
    if program.issues and any(sev in ("CRITICAL",) for *_, sev in program.issues):
        raise ValueError("; ".join(reason for reason, *_ in program.issues))
    why = "asked for"
    if route in ("auto", "native"):
        try:
            return Compiler(program).over(df, inputs, outputs), "native"
        except NotNative as e:
            if route == "native":
                raise
            why = str(e)
    if route in ("auto", "columns"):
        try:
            return over_columns(program, df, inputs, outputs), f"arrow columns: {why}"
        except NotColumns as e:
            if route == "columns":
                raise
            why = f"{why}; {e}"
    return over_arrow(program, df, inputs, outputs), f"arrow: {why}"


def over_columns(program: Program, df: DataFrame, inputs: Mapping[str, str], outputs: Mapping[str, str]) -> DataFrame:
    """The tree over whole Arrow columns; numbers come back as scaled integers and become texts in the JVM."""
    import pyarrow as pa

    scales = Columns(program).check(inputs, outputs)
    kind = lambda c: T.StringType() if scales[c] is None else T.LongType()
    schema = T.StructType([T.StructField("_rec", T.LongType()), *(T.StructField(c, kind(c)) for c in outputs), T.StructField("_error", T.StringType())])

    def run(batches):
        machine = Columns(program)
        step = machine.rows_at_once()
        for b in batches:
            for a in range(0, b.num_rows, step):
                yield pa.RecordBatch.from_arrays(machine.run(b.slice(a, step), inputs, outputs, scales), names=[f.name for f in schema])

    out = df.select(F.col("_rec").cast("long").alias("_rec"), *inputs).mapInArrow(run, schema)
    texts = [F.col(c) if scales[c] is None else decimal_of(F.col(c), scales[c], 19).cast("string").alias(c) for c in outputs]
    return out.select("_rec", *texts, "_error", F.array().cast("array<string>").alias("_display"))


def over_arrow(program: Program, df: DataFrame, inputs: Mapping[str, str], outputs: Mapping[str, str]) -> DataFrame:
    """The tree, record by record, in Arrow batches; records are dealt to tasks by their number."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("_rec", T.LongType()), *(T.StructField(c, T.StringType()) for c in outputs), T.StructField("_error", T.StringType()), T.StructField("_display", T.ArrayType(T.StringType()))])

    def run(batches):
        for b in batches:
            rows = list(interp.over_rows(program, inputs, outputs, b.to_pylist()))
            kinds = {"_rec": pa.int64(), "_display": pa.list_(pa.string())}
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return spread(df.select(F.col("_rec").cast("long").alias("_rec"), *inputs), RECORDS).mapInArrow(run, schema)


class Records(Sequence):
    """A file's records in Arrow batches: some bytes each instead of a dict's hundreds. Changed and added ones lie beside them; a batch at a time is read."""

    def __init__(self) -> None:
        self.batches: list = []
        self.ends: list[int] = []
        self.changed: dict[int, dict | None] = {}
        self.more: list = []
        self.at: tuple[int, int, list] = (0, 0, [])

    def load(self, batch) -> None:
        if batch.num_rows:
            self.batches.append(batch)
            self.ends.append((self.ends[-1] if self.ends else 0) + batch.num_rows)

    def __len__(self) -> int:
        return (self.ends[-1] if self.ends else 0) + len(self.more)

    def __getitem__(self, k):
        if not 0 <= k < len(self):
            raise IndexError(k)
        if k in self.changed:
            return self.changed[k]
        given = self.ends[-1] if self.ends else 0
        if k >= given:
            return self.more[k - given]
        start, end, rows = self.at
        if not start <= k < end:
            i = bisect_right(self.ends, k)
            start, end, rows = self.at = self.ends[i] - self.batches[i].num_rows, self.ends[i], self.batches[i].to_pylist()
        return rows[k - start]

    def __setitem__(self, k: int, row: dict | None) -> None:
        self.changed[k] = row

    def extend(self, rows) -> None:
        self.more.extend(rows)


class Texts:
    """Written records as Arrow batches of their fields' texts."""

    def __init__(self, names: Sequence[str], text: Callable):
        self.names, self.text, self.batches, self.rows = names, text, [], []

    def append(self, row: Mapping) -> None:
        self.rows.append([self.text(row, n) for n in self.names])
        if len(self.rows) == RECORDS:
            self.pack()

    def extend(self, rows) -> None:
        for r in rows:
            self.append(r)

    def pack(self) -> None:
        import pyarrow as pa

        self.batches.append(pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], pa.string()) for k in range(len(self.names))], names=list(self.names)))
        self.rows = []


def execute_io(program: Program, files: Mapping[str, DataFrame], output: str, schema: T.StructType | str) -> DataFrame:
    """A program that reads and writes files itself: its storage lives across records, so one ordered task runs it over the
    inputs, sorted by file and ``_rec`` on the way there; nothing passes the driver. The task holds its files, in Arrow batches. ``schema`` has the output record's fields as strings."""
    spark = next(iter(files.values())).sparkSession
    names, opened = spark.createDataFrame([], schema).columns, list(files)
    fields = sorted({c for df in files.values() for c in df.columns if c != "_rec"})
    given = None
    for f, df in files.items():
        one = df.select(F.lit(f).alias("_file"), "_rec", *(F.col(f"`{c}`").cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))
        given = one if given is None else given.unionByName(one)

    def run(batches):
        import pyarrow.compute as pc

        m = interp.Machine(program)
        m.files = {f: Records() for f in opened}
        m.keep = lambda f: Texts(names, m.written_text) if f == output else []
        for b in batches:
            for f in opened:
                m.files[f].load(b.filter(pc.equal(b.column("_file"), f)).select(fields))
        m.run()
        made = m.written.get(output)
        if made is not None:
            made.pack()
            yield from made.batches

    return given.repartition(1).sortWithinPartitions("_file", "_rec").mapInArrow(run, schema)


def traced(program: Program, df: DataFrame, inputs: Mapping[str, str]) -> DataFrame:
    """The state changes of every record's run: ``_rec``, ``idx``, ``line``, ``verb``, ``variable``, ``old_value``, ``new_value`` and, in a last row where it failed, ``error``."""
    import pyarrow as pa

    names = ("line", "verb", "variable", "old_value", "new_value")

    def run(batches):
        machine = interp.Machine(program, trace=True)
        for b in batches:
            out: dict = {k: [] for k in ("_rec", "idx", *names, "error")}
            for row in b.to_pylist():
                error = None
                try:
                    interp.run_record(machine, {var: row[col] for col, var in inputs.items()})
                except interp.ERRORS as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                events = [*machine.events, *([{"error": error}] if error else [])]
                for k, e in enumerate(events):
                    out["_rec"].append(row["_rec"])
                    out["idx"].append(k)
                    for n in (*names, "error"):
                        out[n].append(e.get(n))
            kinds = {"_rec": pa.int64(), "idx": pa.int32(), "line": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], names=list(out))

    schema = "_rec bigint, idx int, line int, verb string, variable string, old_value string, new_value string, error string"
    return spread(df.select(F.col("_rec").cast("long").alias("_rec"), *inputs), RECORDS).mapInArrow(run, schema)
