"""Cost models as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Effort factor and exponent, schedule factor and exponent of the project types.
COCOMO = {
    "organic": (2.4, 1.05, 2.5, 0.38),
    "semi-detached": (3.0, 1.12, 2.5, 0.35),
    "embedded": (3.6, 1.20, 2.5, 0.32),
}
#: Prices of a million tokens in and out, tokens a second.
LOCOMO = {"large": (10.0, 30.0, 30.0), "medium": (3.0, 15.0, 50.0), "small": (0.5, 2.0, 100.0), "local": (0.0, 0.0, 15.0)}


def project_type(name: str) -> tuple[str, tuple[float, float, float, float]]:
    """A known type, or 'name,a,b,c,d'; anything else is organic."""
    parts = [p.strip() for p in name.split(",")]
    if len(parts) == 5:
        try:
            return parts[0], tuple(float(p) for p in parts[1:])  # type: ignore[return-value]
        except ValueError:
            pass
    key = name.strip().lower()
    return (key, COCOMO[key]) if key in COCOMO else ("organic", COCOMO["organic"])


@dataclass(frozen=True)
class Cocomo:
    type: str = "organic"
    wage: float = 56_286
    overhead: float = 2.4
    eaf: float = 1.0

    def effort(self, sloc: Column) -> Column:
        """Person-months."""
        a, b, _, _ = project_type(self.type)[1]
        return F.lit(a) * F.pow(sloc / 1000.0, F.lit(b)) * F.lit(self.eaf)

    def cost(self, sloc: Column) -> Column:
        return self.effort(sloc) * F.lit(self.wage / 12) * F.lit(self.overhead)

    def months(self, sloc: Column) -> Column:
        _, _, c, d = project_type(self.type)[1]
        return F.lit(c) * F.pow(self.effort(sloc), F.lit(d))

    def people(self, sloc: Column) -> Column:
        months = self.months(sloc)
        return F.when(months > 0, self.effort(sloc) / months).otherwise(0.0)


@dataclass(frozen=True)
class Locomo:
    """Cost of writing the code with a language model. ``config`` names five factors: output tokens and input tokens
    for a line, and how much complexity adds to context, cycles and the base of cycles."""

    preset: str = "medium"
    in_price: float | None = None
    out_price: float | None = None
    tps: float | None = None
    cycles: float | None = None
    review: float = 0.01
    tokens_out: float = 10.0
    tokens_in: float = 20.0
    complexity: float = 5.0
    iterations: float = 1.5
    iteration_complexity: float = 2.0

    @classmethod
    def of(cls, preset: str = "medium", in_price: float = 0, out_price: float = 0, tps: float = 0, cycles: float = 0, review: float = 0.01, config: str = "") -> Locomo:
        """From options, 0 being none; ``config`` is 'tokens_out,tokens_in,complexity,iterations,iteration_complexity',
        and what is no number in it keeps its default."""
        names = ("tokens_out", "tokens_in", "complexity", "iterations", "iteration_complexity")
        own = {}
        for name, part in zip(names, config.split(","), strict=False) if config.count(",") == len(names) - 1 else ():
            try:
                own[name] = float(part)
            except ValueError:
                continue
        return cls(preset.lower(), in_price or None, out_price or None, tps or None, cycles or None, review, **own)

    def _price(self, i: int, own: float | None) -> float:
        return LOCOMO.get(self.preset, LOCOMO["medium"])[i] if own is None else own

    def figures(self, code: int, complexity: int) -> dict[str, float]:
        """``estimate`` for one sum."""
        root = (complexity / code) ** 0.5 if code else 0.0
        context, cycles = 1 + root * self.complexity, self.iterations + root * self.iteration_complexity if self.cycles is None else self.cycles
        out, into, speed = code * self.tokens_out * cycles, code * self.tokens_in * context * cycles, self._price(2, self.tps)
        cost = into / 1e6 * self._price(0, self.in_price) + out / 1e6 * self._price(1, self.out_price)
        return {"cost": cost, "input_tokens": into, "output_tokens": out, "seconds": out / speed if speed else 0.0, "review_hours": code * self.review / 60, "preset": self.preset, "multiplier": context * cycles, "cycles": cycles}

    def estimate(self, code: Column, complexity: Column) -> dict[str, Column]:
        density = F.when(code > 0, complexity / code).otherwise(0.0)
        context = 1 + F.sqrt(density) * F.lit(self.complexity)
        cycles = F.lit(float(self.cycles)) if self.cycles is not None else self.iterations + F.sqrt(density) * F.lit(self.iteration_complexity)
        out = code * F.lit(self.tokens_out) * cycles
        into = code * F.lit(self.tokens_in) * context * cycles
        price = into / 1e6 * F.lit(self._price(0, self.in_price)) + out / 1e6 * F.lit(self._price(1, self.out_price))
        return {"input_tokens": into, "output_tokens": out, "cost": price, "seconds": out / F.lit(self._price(2, self.tps)), "review_hours": code * F.lit(self.review) / 60.0, "cycles": cycles}


def badge(code: Column) -> dict[str, Column]:
    """The variant that badges show."""
    effort = F.lit(3.2) * F.pow(code / 1000.0, F.lit(1.05))
    return {"effort": effort, "cost": effort * F.lit(56_286 / 12) * F.lit(1.8), "months": F.lit(2.5) * F.pow(effort, F.lit(0.38))}


#: Bytes of a megabyte by unit; those from the joke that don't depend on the year too.
MEGABYTES = {"si": 1_000_000.0, "binary": 1_048_576.0, "mixed": 1_024_000.0, "xkcd-kelly": 1012.0**2, "xkcd-intel": 1023.937528**2, "xkcd-bakers": 1152.0**2}


def megabyte(unit: str, year: int = 2000) -> float | None:
    """Bytes of a megabyte; None for the imaginary one; unknown units are SI."""
    unit = unit.lower()
    if unit == "xkcd-imaginary":
        return None
    if unit == "xkcd-kb":
        return 1_000_000.0 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 1_048_576.0
    if unit == "xkcd-drive":
        return float(min(908, 908 - (year - 2013) * 4)) ** 2
    return MEGABYTES.get(unit, MEGABYTES["si"])


def megabytes(size: Column, unit: str = "si", year: int = 2000) -> Column:
    divisor = megabyte(unit, year)
    return F.lit(None).cast("double") if divisor is None else size / F.lit(divisor)
