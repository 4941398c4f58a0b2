"""PDF functions on NumPy arrays: sampled, exponential, stitched and calculator programs.

The Column versions, which run inside the JVM, are in :mod:`quire.functions.pdf_function`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from quire.functions.pdf_function import CalculatorError, parse
from quire.sources.filters import FilterError
from quire.sources.pdf import Document, Stream

#: (inputs, rows) -> (outputs, rows)
Function = Callable[[np.ndarray], np.ndarray]
MAX_DEPTH, MAX_STEPS = 10, 100_000


def pairs(values) -> list[tuple[float, float]]:
    return [(float(a), float(b)) for a, b in zip(values[::2], values[1::2])]


def limited(x: np.ndarray, bounds: list[tuple[float, float]]) -> np.ndarray:
    return np.stack([np.clip(v, a, b) for v, (a, b) in zip(x, bounds)]) if bounds else x


def function(doc: Document, found, depth: int = 0) -> Function | None:
    """From a function object, or an array of functions of one output each; None if it can't be used."""
    found = doc.get(found)
    if isinstance(found, list):
        parts = [function(doc, f, depth + 1) for f in found]
        return (lambda x: np.concatenate([p(x) for p in parts])) if parts and all(parts) else None
    info = found.info if isinstance(found, Stream) else found
    if not isinstance(info, dict) or depth > MAX_DEPTH:
        return None
    info = {k: doc.get(v) for k, v in info.items()}
    kind = info.get("FunctionType")
    try:
        domain = pairs([doc.get(v) for v in info["Domain"]])
        bounds = pairs([doc.get(v) for v in info.get("Range") or []])
        if kind == 2:
            body = exponential(info)
        elif kind == 3:
            body = stitched([function(doc, f, depth + 1) for f in info["Functions"]], domain[0], [float(doc.get(b)) for b in info["Bounds"]], pairs([doc.get(v) for v in info["Encode"]]))
        elif kind == 0 and isinstance(found, Stream):
            body = sampled(doc.decoded(found), info, domain, bounds)
        elif kind == 4 and isinstance(found, Stream):
            program = parse(doc.decoded(found).decode("latin-1"))
            body = lambda x: run_program(program, x, len(bounds))
        else:
            return None
    except (KeyError, TypeError, ValueError, IndexError, FilterError):
        return None
    return lambda x: limited(body(limited(np.asarray(x, "f8"), domain)), bounds)


def exponential(info: dict) -> Function:
    c0, c1, n = np.array(info.get("C0") or [0.0], "f8"), np.array(info.get("C1") or [1.0], "f8"), float(info["N"])
    return lambda x: c0[:, None] + np.power(x[0], n)[None, :] * (c1 - c0)[:, None]


def stitched(parts: list[Function | None], domain: tuple[float, float], bounds: list[float], encode: list[tuple[float, float]]) -> Function:
    if not parts or not all(parts):
        raise ValueError("parts")
    edges = [domain[0], *bounds, domain[1]]

    def run(x: np.ndarray) -> np.ndarray:
        which, out = np.searchsorted(bounds, x[0], side="right"), None
        for k, part in enumerate(parts):
            rows = np.flatnonzero(which == k)
            a, b, (e0, e1) = edges[k], edges[k + 1], encode[k]
            own = part((e0 + (x[0][rows] - a) * ((e1 - e0) / (b - a) if b > a else 0.0))[None, :])
            out = np.zeros((len(own), x.shape[1])) if out is None else out
            out[:, rows] = own
        return out

    return run


def sampled(data: bytes, info: dict, domain: list, bounds: list) -> Function:
    """Multilinear between samples of 1 to 32 bits."""
    sizes, bits = [int(s) for s in info["Size"]], int(info["BitsPerSample"])
    m, n = len(sizes), len(bounds)
    encode = pairs(info["Encode"]) if info.get("Encode") else [(0.0, s - 1.0) for s in sizes]
    decode = pairs(info["Decode"]) if info.get("Decode") else bounds
    count = n * math.prod(sizes)
    if not 0 < count <= 1 << 24 or m > 6:
        raise ValueError("size")
    raw = np.unpackbits(np.frombuffer(data, np.uint8))[: count * bits]
    if len(raw) < count * bits:
        raise ValueError("samples")
    values = raw.reshape(count, bits) @ (2.0 ** np.arange(bits - 1, -1, -1)) / (2.0**bits - 1)
    table = values.reshape(*sizes[::-1], n)

    def run(x: np.ndarray) -> np.ndarray:
        low, part = [], []
        for v, (d0, d1), (e0, e1), s in zip(x, domain, encode, sizes):
            at = np.clip(e0 + (v - d0) * ((e1 - e0) / (d1 - d0) if d1 > d0 else 0.0), 0, s - 1)
            i = np.minimum(at.astype("i8"), max(s - 2, 0))
            low.append(i)
            part.append(at - i)
        out = np.zeros((x.shape[1], n))
        for corner in range(1 << m):
            weight, index = np.ones(x.shape[1]), []
            for k in range(m):
                up = corner >> k & 1
                weight = weight * (part[k] if up else 1 - part[k])
                index.append(np.minimum(low[k] + up, sizes[k] - 1))
            out += weight[:, None] * table[tuple(index[::-1])]
        return np.stack([d0 + out[:, k] * (d1 - d0) for k, (d0, d1) in enumerate(decode)])

    return run


WORDS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0,
    "idiv": lambda a, b: float(int(int(a) / int(b))) if int(b) else 0.0, "mod": lambda a, b: math.fmod(int(a), int(b)) if int(b) else 0.0,
    "exp": lambda a, b: a**b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360,
    "bitshift": lambda a, b: float(int(a) << min(int(b), 31) if b >= 0 else int(a) >> min(int(-b), 31)),
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "and": lambda a, b: a and b if isinstance(a, bool) else float(int(a) & int(b)), "or": lambda a, b: a or b if isinstance(a, bool) else float(int(a) | int(b)),
    "xor": lambda a, b: a != b if isinstance(a, bool) else float(int(a) ^ int(b)),
}
SINGLE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": lambda a: float(math.ceil(a)), "floor": lambda a: float(math.floor(a)), "round": lambda a: float(math.floor(a + 0.5)),
    "truncate": lambda a: float(math.trunc(a)), "cvi": lambda a: float(math.trunc(a)), "cvr": float, "sqrt": lambda a: math.sqrt(max(a, 0.0)),
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0,
    "not": lambda a: not a if isinstance(a, bool) else float(~int(a)),
}


def run_program(program: list, x: np.ndarray, outputs: int) -> np.ndarray:
    """A row at a time: programs branch on values."""
    rows = []
    for row in x.T.tolist():
        stack, steps = list(row), [0]
        try:
            execute(program, stack, steps)
            rows.append([float(v) for v in stack[len(stack) - outputs :]] if len(stack) >= outputs else [0.0] * outputs)
        except (IndexError, ValueError, OverflowError, TypeError):
            rows.append([0.0] * outputs)
    return np.array(rows, "f8").reshape(-1, outputs).T


def execute(block: list, stack: list, steps: list[int]) -> None:
    i = 0
    while i < len(block):
        word = block[i]
        steps[0] += 1
        if steps[0] > MAX_STEPS or len(stack) > MAX_STEPS:
            raise CalculatorError("too long")
        i += 1
        if isinstance(word, list):
            other = block[i] if i < len(block) and isinstance(block[i], list) else None
            i += 1 + (other is not None)
            if stack.pop():
                execute(word, stack, steps)
            elif other:
                execute(other, stack, steps)
        elif word in WORDS:
            b, a = stack.pop(), stack.pop()
            stack.append(WORDS[word](a, b))
        elif word in SINGLE:
            stack.append(SINGLE[word](stack.pop()))
        elif word in ("true", "false"):
            stack.append(word == "true")
        elif word == "pop":
            stack.pop()
        elif word == "dup":
            stack.append(stack[-1])
        elif word == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif word == "copy":
            n = int(stack.pop())
            stack += stack[len(stack) - n :] if n else []
        elif word == "index":
            stack.append(stack[-1 - int(stack.pop())])
        elif word == "roll":
            j, n = int(stack.pop()), int(stack.pop())
            if n:
                top = stack[len(stack) - n :]
                stack[len(stack) - n :] = [top[(k - j) % n] for k in range(n)]
        else:
            stack.append(float(word))
