"""Checks of parameters, made before a plan is built."""

from __future__ import annotations

from datetime import date

from tarn.constants import YEARS


def within(name: str, value: float, span: tuple[float, float]) -> None:
    """An error unless ``value`` lies in ``span``, both ends included."""
    low, high = span
    if not low <= value <= high:
        raise ValueError(f"{name} goes from {low} to {high}, not {value}")


def years_checked(years: list[int], span: tuple[int, int] = YEARS) -> list[int]:
    """``years`` in order, each once; an error if one lies outside of ``span``."""
    for year in years:
        within("year", year, span)
    return sorted(set(years))


def years_of(year: int | None = None, first: int | None = None, last: int | None = None) -> list[int]:
    """One year, or all from ``first`` to ``last``; open ends reach as far as there are images."""
    if year is not None:
        return years_checked([year])
    return years_checked(list(range(first or YEARS[0], (last or YEARS[1]) + 1)))


def year_bounds(year: int) -> tuple[date, date]:
    """The first day of a year and of the next one, which is outside."""
    return date(year, 1, 1), date(year + 1, 1, 1)


def confirmed(answer: bool) -> None:
    """An error unless whoever starts a run has confirmed it."""
    if answer is not True:
        raise ValueError("the run has to be confirmed")
