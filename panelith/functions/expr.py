"""Expression nodes over a dense entity x date panel.

A node is a scalar of one row, a trailing window along an entity's history (axis TS), or a
rank within a date (axis XS). Equal nodes are one object, so common parts are computed once.
``panelith.plans`` turns sets of nodes into stages of Spark windows.
"""

from __future__ import annotations

import math

TS, XS, ROW = "TS", "XS", "ROW"
TS_OPS = {"lag", "mean", "sum", "std", "max", "min", "rank", "age_max", "age_min", "skew", "kurt", "cov", "corr", "ewm", "streak"}


def observations(w: int) -> int:
    """Non-null values that a window of w rows needs: four fifths of it, rounded up."""
    return min(w, max(1, math.ceil(0.8 * w)))


class Node:
    """An operation with its operands and parameters; make nodes with the functions below."""

    _made: dict[tuple, Node] = {}
    op: str
    args: tuple[Node, ...]
    params: tuple
    number: int

    def __new__(cls, op: str, args: tuple = (), params: tuple = ()) -> Node:
        key = (op, tuple(id(a) for a in args), params)
        if key not in cls._made:
            self = super().__new__(cls)
            self.op, self.args, self.params, self.number = op, args, params, len(cls._made)
            cls._made[key] = self
        return cls._made[key]

    @property
    def axis(self) -> str:
        return TS if self.op in TS_OPS else XS if self.op == "xs_rank" else ROW

    @property
    def column(self) -> str:
        return f"n{self.number}"

    def __add__(self, other):
        return Node("add", (self, as_node(other)))

    def __radd__(self, other):
        return Node("add", (as_node(other), self))

    def __sub__(self, other):
        return Node("sub", (self, as_node(other)))

    def __rsub__(self, other):
        return Node("sub", (as_node(other), self))

    def __mul__(self, other):
        return Node("mul", (self, as_node(other)))

    def __rmul__(self, other):
        return Node("mul", (as_node(other), self))

    def __truediv__(self, other):
        return Node("div", (self, as_node(other)))

    def __rtruediv__(self, other):
        return Node("div", (as_node(other), self))

    def __neg__(self):
        return Node("neg", (self,))


def as_node(x) -> Node:
    return x if isinstance(x, Node) else Node("const", (), (float(x),))


def field(name: str) -> Node:
    """A column of the panel."""
    return Node("field", (), (name,))


def ln(x):
    """Natural logarithm; NULL unless x > 0."""
    return Node("ln", (x,))


def sqrt(x):
    """Square root; NULL for x < 0."""
    return Node("sqrt", (x,))


def absolute(x):
    return Node("abs", (x,))


def sign(x):
    return Node("sign", (x,))


def power(x, k: int):
    return Node("pow", (x,), (k,))


def at_least(x, low: float):
    """The greater of x and a bound; NULL stays NULL."""
    return Node("at_least", (x,), (float(low),))


def at_most(x, high: float):
    return Node("at_most", (x,), (float(high),))


def clipped(x, low: float, high: float):
    return at_most(at_least(x, low), high)


def not_zero(x):
    """x, or NULL where it is 0."""
    return Node("not_zero", (x,))


def positive_flag(x):
    """1 where x > 0, else 0; NULL stays NULL."""
    return Node("flag", (x,))


def where_both(x, y):
    """x where both x and y are known."""
    return Node("where_both", (x, y))


def above(x, bound: float, value):
    """value where x > bound, else NULL."""
    return Node("above", (x, value), (float(bound),))


def known_mean(*xs):
    """The mean of those values that are known; NULL if none is."""
    return Node("known_mean", xs)


def lag(x, k: int):
    """The value k rows of the calendar earlier; later for k < 0."""
    return x if k == 0 else Node("lag", (x,), (k,))


def ts_mean(x, w: int):
    return Node("mean", (x,), (w, observations(w)))


def ts_sum(x, w: int):
    return Node("sum", (x,), (w, observations(w)))


def ts_std(x, w: int, least: int | None = None):
    """Sample standard deviation."""
    return Node("std", (x,), (w, least or observations(w)))


def ts_max(x, w: int):
    return Node("max", (x,), (w, observations(w)))


def ts_min(x, w: int):
    return Node("min", (x,), (w, observations(w)))


def ts_rank(x, w: int):
    """Share rank of the current value among the window's, ties averaged; NULL where the current value is."""
    return Node("rank", (x,), (w, observations(w)))


def days_since_max(x, w: int):
    """Rows since the oldest greatest value of exactly w rows, NULLs lowest; NULL where the current value is."""
    return Node("age_max", (x,), (w,))


def days_since_min(x, w: int):
    return Node("age_min", (x,), (w,))


def ts_skew(x, w: int):
    """Bias-corrected skewness; 0 in a constant window."""
    return Node("skew", (x,), (w, max(3, observations(w))))


def ts_kurt(x, w: int):
    """Bias-corrected excess kurtosis; -3 in a constant window."""
    return Node("kurt", (x,), (w, max(4, observations(w))))


def ewm(x, alpha: float, least: int):
    """Exponentially weighted mean over all rows so far, weights by calendar distance; NULL until ``least`` values."""
    return Node("ewm", (x,), (float(alpha), least))


def streak(x):
    """Signed length of the run of equal signs that ends here; 0 for 0."""
    return Node("streak", (x,))


def xs_rank(x):
    """Share rank among the date's universe members with a value, ties averaged."""
    return Node("xs_rank", (x,))


def ts_cov(x, y, w: int):
    """Population covariance of rows where both are known, by central moments."""
    return Node("cov", (where_both(x, y), where_both(y, x)), (w, observations(w)))


def to_digits(x, digits: int = 10):
    """x rounded, so that values which differ by rounding noise alone are ties to a later rank."""
    return Node("digits", (x,), (digits,))


def line_fit(x, y, w: int):
    """Correlation of rows where both are known, kept within -1 and 1; NULL where the spread is next to none."""
    return Node("corr", (where_both(x, y), where_both(y, x)), (w, observations(w)))


def ts_corr(x, y, w: int):
    """``line_fit`` to ten digits."""
    return to_digits(line_fit(x, y, w))


def decay_linear(x, w: int):
    """Mean with weights w for the newest to 1 for the oldest of w rows; NULL if any is."""
    total = x * float(w)
    for i in range(1, w):
        total = total + lag(x, i) * float(w - i)
    return total / (w * (w + 1) / 2)


def delta(x, k: int):
    return x - lag(x, k)


def change(x, k: int = 1, skip: int = 0):
    return lag(x, skip) / lag(x, k) - 1
