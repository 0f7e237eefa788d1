"""Probabilistic programs: exact answers and Monte Carlo estimates."""

from .exact import Answer, exact
from .montecarlo import Estimate, monte_carlo

__all__ = ["Answer", "Estimate", "exact", "monte_carlo", "solve"]


def solve(spark, program: str, engine: str | None = None, **options):
    """Answer a program's queries with the engine its pragma names (exact without one)."""
    from ..lang.parser import parse

    p = parse(program)
    if (engine or p.pragmas.get("prob_engine", "exact_ddnnf")) == "mc":
        return monte_carlo(spark, p, **options)
    return exact(p)
