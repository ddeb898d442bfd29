"""Distance kernels as SQL expressions: the text runs in Spark (F.expr) and in other SQL engines alike."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polynomial approximations of the modified Bessel functions I0 and K0
# (Abramowitz and Stegun, Handbook of Mathematical Functions, 9.8.1, 9.8.2, 9.8.5, 9.8.6).
I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
I0_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)
K0_SMALL = (-0.57721566, 0.42278420, 0.23069756, 0.03488590, 0.00262698, 0.00010750, 0.00000740)
K0_LARGE = (1.25331414, -0.07832358, 0.02189568, -0.01062446, 0.00587872, -0.00251540, 0.00053208)


def number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def polynomial(coefficients: tuple[float, ...], y: str) -> str:
    text = number(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({number(c)} + {y} * {text})"
    return text


def bessel_i0(x: str) -> str:
    small = polynomial(I0_SMALL, f"(({x}) / 3.75e0 * (({x}) / 3.75e0))")
    large = f"exp({x}) / sqrt({x}) * {polynomial(I0_LARGE, f'(3.75e0 / ({x}))')}"
    return f"CASE WHEN ({x}) < 3.75e0 THEN {small} ELSE {large} END"


def bessel_k0(x: str) -> str:
    """K0 for positive x."""
    y = f"(({x}) * ({x}) / 4e0)"
    small = f"(-ln(({x}) / 2e0) * {polynomial(I0_SMALL, f'(({x}) / 3.75e0 * (({x}) / 3.75e0))')} + {polynomial(K0_SMALL, y)})"
    large = f"exp(-({x})) / sqrt({x}) * {polynomial(K0_LARGE, f'(2e0 / ({x}))')}"
    return f"CASE WHEN ({x}) <= 2e0 THEN {small} ELSE {large} END"


@dataclass(frozen=True)
class ReactionDiffusion:
    """Steady state of diffusion with decay around a point source; decay length sqrt(diffusion / decay)."""

    diffusion: float = 1.0
    decay: float = 1.0
    production: float = 1.0
    min_distance: float = 1e-3
    dims: int = 2

    def __post_init__(self) -> None:
        for name in ("diffusion", "decay", "production", "min_distance"):
            v = getattr(self, name)
            if not math.isfinite(v) or v <= 0:
                raise ValueError(f"{name} must be positive and finite")
        if self.dims not in (2, 3):
            raise ValueError("dims must be 2 or 3")

    @classmethod
    def of_length(cls, length: float, **rest: float) -> ReactionDiffusion:
        return cls(diffusion=length * length, decay=1.0, **rest)

    @property
    def length(self) -> float:
        return math.sqrt(self.diffusion / self.decay)

    def sql(self, distance: str) -> str:
        """The kernel at a distance; distances under min_distance count as min_distance."""
        r = f"greatest({distance}, {number(self.min_distance)})"
        scaled = f"({r} / {number(self.length)})"
        if self.dims == 2:
            return f"{number(self.production)} * ({bessel_k0(scaled)}) / {number(2 * math.pi * self.diffusion)}"
        return f"{number(self.production)} * exp(-{scaled}) / ({number(4 * math.pi * self.diffusion)} * {r})"

    def column(self, distance: str) -> Column:
        return F.expr(self.sql(distance))


def valid_parameters(diffusion: Column, decay: Column, dims: Column) -> Column:
    """Whether ReactionDiffusion takes the parameters: finite, positive, in two or three dimensions."""
    fine = lambda c: (c > 0) & (c < float("inf"))  # noqa: E731  NaN is greater than all
    return F.coalesce(fine(diffusion) & fine(decay) & dims.isin(2, 3), F.lit(False))
