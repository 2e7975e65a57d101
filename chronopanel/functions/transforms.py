"""Variance-stabilising and safe arithmetic transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def deflate(x: Column | str, price_index: Column | str) -> Column:
    return ratio(x, price_index) * 100


def box_cox(x: Column | str, lam: Column | float) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(lam == 0, F.log(_c(x))).otherwise((F.pow(_c(x), lam) - 1) / lam)


def inv_box_cox(z: Column | str, lam: Column | float) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(lam == 0, F.exp(_c(z))).otherwise(F.pow(_c(z) * lam + 1, 1 / lam))


def missing_to_null(x: Column | str) -> Column:
    """NaN becomes NULL, so that one kind of missing value remains."""
    return F.when(~F.isnan(_c(x)), _c(x))


@dataclass(frozen=True)
class Response:
    """A Box-Cox response of a model: ``lam`` 0 is the logarithm, 0.5 a square root, None the values themselves."""

    lam: float | None = None

    def forward(self, x: Column | str) -> Column:
        """Values on the model's scale, NULL outside the transform's domain."""
        v = _c(x).cast("double")
        if self.lam is None:
            return v
        return F.when(v >= 0 if self.lam > 0 else v > 0, box_cox(v, self.lam))

    def median(self, mu: Column | str) -> Column:
        """The median on the values' scale; NULL where no value has this transform."""
        if self.lam is None or self.lam == 0:
            return _c(mu) if self.lam is None else F.exp(_c(mu))
        return F.when(_c(mu) * self.lam + 1 > 0, inv_box_cox(mu, self.lam))

    def mean(self, mu: Column | str, sd: Column | str) -> Column:
        """The mean on the values' scale: the median, corrected for the curvature up to the second order."""
        if self.lam is None:
            return _c(mu)
        bend = (1 - self.lam) * F.pow(_c(sd), 2) / (2 * F.pow(_c(mu) * self.lam + 1, 2))
        return self.median(mu) * (1 + bend)
