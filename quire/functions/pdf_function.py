"""PDF functions of one input as Column expressions.

Sampled, exponential and stitched functions are built from their parameters; calculator
programs are compiled: a stack of Columns is kept while the program is read, so what runs is
one expression inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STITCH_DEPTH, MAX_BLOCK_DEPTH, MAX_STEPS, MAX_STACK = 10, 64, 100_000, 100_000


class CalculatorError(ValueError):
    """A program that can't be compiled: underflow, wrong operand kinds, unknown words."""


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def exponential(t: Column, c0: Sequence[float], c1: Sequence[float], n: float, domain: tuple[float, float] = (0.0, 1.0)) -> list[Column]:
    power = F.pow(clip(t, *domain), F.lit(float(n)))
    return [F.lit(float(a)) + power * (float(b) - float(a)) for a, b in zip(c0, c1)]


def sampled(t: Column, samples: Sequence[Sequence[int]], bits: int, domain: tuple[float, float] = (0.0, 1.0), decode: Sequence[tuple[float, float]] | None = None) -> list[Column]:
    """Linear between samples; each sample is a sequence of outputs of ``bits`` bits."""
    most, last = float((1 << bits) - 1), len(samples) - 1
    width = domain[1] - domain[0]
    at = (clip(t, *domain) - domain[0]) / (width if width else 1.0) * last
    low = F.least(F.floor(at), F.lit(max(last - 1, 0))).cast("int")
    part = at - low
    out = []
    for k in range(len(samples[0])):
        values = F.array(*[F.lit(s[k] / most) for s in samples])
        a, b = F.get(values, low), F.get(values, F.least(low + 1, F.lit(last)))
        d0, d1 = (decode or [(0.0, 1.0)] * len(samples[0]))[k]
        out.append(d0 + (a + (b - a) * part) * (d1 - d0))
    return out


Function = Callable[[Column], list[Column]]


def stitched(t: Column, parts: Sequence[Function], bounds: Sequence[float], encode: Sequence[tuple[float, float]], domain: tuple[float, float] = (0.0, 1.0), depth: int = 0) -> list[Column]:
    """The part whose stretch holds t, with t mapped to the part's own input."""
    if depth > MAX_STITCH_DEPTH:
        raise ValueError("stitched too deeply")
    x, edges = clip(t, *domain), [domain[0], *bounds, domain[1]]
    chosen: list[Column] | None = None
    for k in reversed(range(len(parts))):
        a, b, (e0, e1) = edges[k], edges[k + 1], encode[k]
        own = parts[k](F.lit(float(e0)) if a == b else e0 + (x - a) * ((e1 - e0) / (b - a)))
        chosen = own if chosen is None else [F.when(x < F.lit(float(b)), v).otherwise(w) for v, w in zip(own, chosen)]
    return chosen or []


# Calculator programs. An entry of the stack is (kind, Column or constant): kind n or b.

Entry = tuple[str, object]


def column(e: Entry) -> Column:
    return e[1] if isinstance(e[1], Column) else F.lit(e[1] if e[0] == "b" else float(e[1]))


def toward_zero(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def whole(c: Column) -> Column:
    return toward_zero(c).cast("long")


UNARY = {
    "abs": F.abs,
    "neg": lambda a: -a,
    "ceiling": lambda a: F.ceil(a).cast("double"),
    "floor": lambda a: F.floor(a).cast("double"),
    "round": lambda a: F.round(a),
    "truncate": toward_zero,
    "cvi": toward_zero,
    "cvr": lambda a: a,
    "sqrt": F.sqrt,
    "sin": lambda a: F.sin(F.radians(a)),
    "cos": lambda a: F.cos(F.radians(a)),
    "ln": F.ln,
    "log": F.log10,
}
BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "idiv": lambda a, b: F.call_function("div", whole(a), F.nullif(whole(b), F.lit(0))).cast("double"),
    "mod": lambda a, b: (whole(a) % F.nullif(whole(b), F.lit(0))).cast("double"),
    "exp": lambda a, b: F.pow(a, b),
    "atan": lambda a, b: F.when(F.atan2(a, b) < 0, F.degrees(F.atan2(a, b)) + 360).otherwise(F.degrees(F.atan2(a, b))),
    "bitshift": lambda a, b: F.when(b >= 0, F.call_function("shiftleft", whole(a), F.greatest(whole(b), F.lit(0)).cast("int"))).otherwise(F.call_function("shiftright", whole(a), F.greatest(-whole(b), F.lit(0)).cast("int"))).cast("double"),
}
COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
LOGIC = {
    "and": (lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)),
    "or": (lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)),
    "xor": (lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b)),
}


def parse(program: str) -> list:
    """Nested lists of words."""
    stack: list[list] = [[]]
    for word in re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\r\n]*", " ", program)):
        if word == "{":
            if len(stack) > MAX_BLOCK_DEPTH:
                raise CalculatorError("nested too deeply")
            stack.append([])
        elif word == "}":
            if len(stack) < 2:
                raise CalculatorError("unbalanced braces")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(word)
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise CalculatorError("not one block")
    return stack[0][0]


class Compiler:
    def __init__(self, inputs: Sequence[Column]):
        self.stack: list[Entry] = [("n", c) for c in inputs]
        self.steps = 0

    def pop(self, kind: str | None = None) -> Entry:
        if not self.stack:
            raise CalculatorError("stack underflow")
        e = self.stack.pop()
        if kind and e[0] != kind:
            raise CalculatorError(f"operand of kind {e[0]}")
        return e

    def constant(self) -> int:
        e = self.pop("n")
        if isinstance(e[1], Column):
            raise CalculatorError("a count must be a constant")
        return int(e[1])

    def run(self, block: list) -> None:
        i = 0
        while i < len(block):
            self.steps += 1
            if self.steps > MAX_STEPS or len(self.stack) > MAX_STACK:
                raise CalculatorError("too long")
            word = block[i]
            i += 1
            if not isinstance(word, list):
                self.word(word)
                continue
            other = block[i] if i < len(block) and isinstance(block[i], list) else None
            i += other is not None
            if i >= len(block) or block[i] != ("if" if other is None else "ifelse"):
                raise CalculatorError("a block without if")
            i += 1
            self.branch(word, other or [])

    def branch(self, yes: list, no: list) -> None:
        condition, before = column(self.pop("b")), list(self.stack)
        self.run(yes)
        first, self.stack = self.stack, list(before)
        self.run(no)
        if [e[0] for e in first] != [e[0] for e in self.stack]:
            raise CalculatorError("branches leave different stacks")
        self.stack = [a if a is b else (a[0], F.when(condition, column(a)).otherwise(column(b))) for a, b in zip(first, self.stack)]

    def word(self, w: str) -> None:
        s = self.stack
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", w):
            s.append(("n", float(w)))
        elif w in ("true", "false"):
            s.append(("b", w == "true"))
        elif w in UNARY:
            s.append(("n", UNARY[w](column(self.pop("n")))))
        elif w in BINARY or w in COMPARE:
            b, a = self.pop("n" if w in BINARY else None), self.pop("n" if w in BINARY else None)
            if a[0] != b[0]:
                raise CalculatorError("operands of two kinds")
            s.append(("n", BINARY[w](column(a), column(b))) if w in BINARY else ("b", COMPARE[w](column(a), column(b))))
        elif w in LOGIC:
            b, a = self.pop(), self.pop()
            if a[0] != b[0]:
                raise CalculatorError("operands of two kinds")
            s.append(("b", LOGIC[w][0](column(a), column(b))) if a[0] == "b" else ("n", LOGIC[w][1](whole(column(a)), whole(column(b))).cast("double")))
        elif w == "not":
            a = self.pop()
            s.append(("b", ~column(a)) if a[0] == "b" else ("n", F.bitwise_not(whole(column(a))).cast("double")))
        elif w == "pop":
            self.pop()
        elif w == "dup":
            s.append(self.pop())
            s.append(s[-1])
        elif w == "exch":
            b, a = self.pop(), self.pop()
            s += [b, a]
        elif w == "copy":
            n = self.constant()
            if not 0 <= n <= len(s):
                raise CalculatorError("copy of too many")
            s += s[len(s) - n :]
        elif w == "index":
            n = self.constant()
            if not 0 <= n < len(s):
                raise CalculatorError("index beyond the stack")
            s.append(s[-1 - n])
        elif w == "roll":
            j, n = self.constant(), self.constant()
            if not 0 <= n <= len(s):
                raise CalculatorError("roll of too many")
            if n:
                top = s[len(s) - n :]
                s[len(s) - n :] = [top[(k - j) % n] for k in range(n)]
        else:
            raise CalculatorError(f"unknown word {w}")


def calculator(program: str, inputs: Sequence[Column], ranges: Sequence[tuple[float, float]] = ()) -> list[Column]:
    """Outputs of a program, the last ``len(ranges)`` of its stack, within their ranges."""
    c = Compiler(inputs)
    c.run(parse(program))
    if len(c.stack) < len(ranges):
        raise CalculatorError("too few outputs")
    out = [column(e) for e in c.stack[len(c.stack) - len(ranges) :]] if ranges else [column(e) for e in c.stack]
    return [clip(v, *r) for v, r in zip(out, ranges)] if ranges else out
