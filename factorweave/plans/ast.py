"""Alpha expressions as immutable trees: parse, print, check, draw, prune, cross and mutate."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

from factorweave.operators.registry import OPERATORS, Operator

#: Leaf columns of a panel and their value types (fixed values).
COLUMNS = {
    "open": "price", "high": "price", "low": "price", "close": "price", "vwap": "price", "TurnoverVolume": "ticker_float", "TurnoverValue": "ticker_float",
    "raw_close_close": "pct_change", "raw_close_open": "pct_change", "raw_close_high": "pct_change", "raw_close_low": "pct_change", "raw_close_vwap": "pct_change",
}
#: Window lengths that are drawn: 1 to 19, 20 to 45 by 5, 50 to 100 by 10.
INTEGERS = (*range(1, 20), *range(20, 50, 5), *range(50, 101, 10))
_TOKEN = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*)|(\d+)|([(),]))")


class ExpressionError(ValueError):
    """An expression that can't be read, or that an operator doesn't accept."""


@dataclass(frozen=True)
class Node:
    """A column (no op), or an operator over children, with a window length if it takes one."""

    op: str | None
    name: str = ""
    children: tuple[Node, ...] = ()
    n: int | None = None

    def __str__(self) -> str:
        if self.op is None:
            return self.name
        return f"{self.op}({','.join([*map(str, self.children), *([str(self.n)] if self.n is not None else [])])})"

    @property
    def spec(self) -> Operator:
        return OPERATORS[self.op]

    @property
    def depth(self) -> int:
        return 0 if self.op is None else 1 + max(c.depth for c in self.children)

    def walk(self) -> Iterator[Node]:
        """All nodes, children before parents."""
        for c in self.children:
            yield from c.walk()
        yield self

    def columns(self) -> set[str]:
        return {x.name for x in self.walk() if x.op is None}

    def at(self, path: tuple[int, ...]) -> Node:
        return self.children[path[0]].at(path[1:]) if path else self

    def replaced(self, path: tuple[int, ...], new: Node) -> Node:
        """A copy with the node at path replaced; nothing is changed in place."""
        if not path:
            return new
        own = list(self.children)
        own[path[0]] = own[path[0]].replaced(path[1:], new)
        return Node(self.op, self.name, tuple(own), self.n)

    def paths(self, path: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
        yield path
        for i, c in enumerate(self.children):
            yield from c.paths((*path, i))


def column(name: str) -> Node:
    return Node(None, name)


def apply(op: str, *children: Node, n: int | None = None) -> Node:
    """An operator node; n is brought to what the operator computes with."""
    if op not in OPERATORS:
        raise ExpressionError(f"no operator {op}")
    spec = OPERATORS[op]
    if len(children) != spec.arity:
        raise ExpressionError(f"{op} takes {spec.arity} column(s), not {len(children)}")
    if (n is not None) != spec.takes_n:
        raise ExpressionError(f"{op} takes {'a' if spec.takes_n else 'no'} window length")
    if n is not None and n < 1:
        raise ExpressionError(f"{op}: the window length must be 1 or more")
    return Node(op, "", tuple(children), spec.rewrite(n) if n is not None else None)


def combine(op: str, a: Node, b: Node, comparable: bool = True) -> Node:
    """a pair operator over a and b, or over their ranks by day if they aren't comparable."""
    return apply(op, a, b) if comparable else apply(op, apply("cs_rank", a), apply("cs_rank", b))


def parse(text: str) -> Node:
    """Reads op(a,b,...,n); spaces are allowed.  parse(str(tree)) gives an equal tree."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:1]!r} at {at} in {text!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def take(wanted: str | None = None) -> re.Match:
        nonlocal place
        if place >= len(tokens) or wanted and tokens[place][3] != wanted:
            raise ExpressionError(f"expected {wanted or 'more'} after {text[: tokens[place - 1].end()] if place else ''!r}")
        place += 1
        return tokens[place - 1]

    def term() -> Node | int:
        m = take()
        if m[2]:
            return int(m[2])
        if not m[1]:
            raise ExpressionError(f"unexpected {m[3]!r} at {m.start(3)} in {text!r}")
        if place >= len(tokens) or tokens[place][3] != "(":
            return column(m[1])
        take("(")
        args = [term()]
        while place < len(tokens) and tokens[place][3] == ",":
            take(",")
            args.append(term())
        take(")")
        n = args.pop() if isinstance(args[-1], int) else None
        if any(isinstance(a, int) for a in args):
            raise ExpressionError(f"{m[1]}: only the last argument may be a number")
        return apply(m[1], *args, n=n)

    out = term()
    if place < len(tokens):
        raise ExpressionError(f"unexpected {tokens[place][0].strip()!r} at {tokens[place].start()} in {text!r}")
    if isinstance(out, int):
        raise ExpressionError("a number alone is no expression")
    return out


def infer_type(node: Node, columns: dict[str, str] | None = None) -> str:
    """Value type of an expression: price, ticker_float, pct_change, uniform, norm or float."""
    columns = COLUMNS if columns is None else columns
    if node.op is None:
        if node.name not in columns:
            raise ExpressionError(f"no column {node.name}")
        return columns[node.name]
    own = [infer_type(c, columns) for c in node.children]
    kind = node.spec.value
    if kind == "same":
        return own[0]
    if kind != "sum":
        return kind
    if "ticker_float" in own:
        return "ticker_float"
    if own[0] == own[1]:
        return own[0]
    return "norm" if set(own) == {"norm", "uniform"} else "ticker_float"


def draw(rng: random.Random, depth: int, columns: list[str] | None = None, stop: float = 0.0) -> Node:
    """A random tree: operators by their weights down to `depth`, then columns.

    stop: the chance that a branch ends in a column before; the root is always an operator.
    """
    columns = list(COLUMNS) if columns is None else columns

    def grow(left: int, root: bool) -> Node:
        if left <= 0 or not root and rng.random() < stop:
            return column(rng.choice(columns))
        op = rng.choices(list(OPERATORS), [o.weight for o in OPERATORS.values()])[0]
        spec = OPERATORS[op]
        return apply(op, *[grow(left - 1, False) for _ in range(spec.arity)], n=rng.choice(INTEGERS) if spec.takes_n else None)

    return grow(depth, True)


def prune(node: Node, depth: int, rng: random.Random, columns: list[str] | None = None) -> Node:
    """The tree with every operator below `depth` replaced by a random column."""
    columns = list(COLUMNS) if columns is None else columns
    if node.op is None:
        return node
    if depth <= 0:
        return column(rng.choice(columns))
    return Node(node.op, "", tuple(prune(c, depth - 1, rng, columns) for c in node.children), node.n)


def crossover(a: Node, b: Node, rng: random.Random, tries: int = 5) -> tuple[Node, Node]:
    """Both trees with two subtrees swapped: operators for operators, columns for columns."""
    for _ in range(tries):
        pa, pb = rng.choice(list(a.paths())), rng.choice(list(b.paths()))
        if (a.at(pa).op is None) == (b.at(pb).op is None) and pa and pb:
            return a.replaced(pa, b.at(pb)), b.replaced(pb, a.at(pa))
    return a, b


def mutate(node: Node, rng: random.Random, columns: list[str] | None = None) -> Node:
    """The tree with one node redrawn: an operator of the same shape, its window, or a column."""
    columns = list(COLUMNS) if columns is None else columns
    path = rng.choice(list(node.paths()))
    old = node.at(path)
    if old.op is None:
        return node.replaced(path, column(rng.choice(columns)))
    if old.n is not None and rng.random() < 0.5:
        return node.replaced(path, apply(old.op, *old.children, n=rng.choice(INTEGERS)))
    alike = [k for k, o in OPERATORS.items() if (o.arity, o.takes_n) == (old.spec.arity, old.spec.takes_n)]
    op = rng.choices(alike, [OPERATORS[k].weight for k in alike])[0]
    return node.replaced(path, apply(op, *old.children, n=old.n))
