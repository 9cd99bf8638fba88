"""Whole queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations


def all_catalogues() -> list:
    """The catalogues of the core, in the order of their importance."""
    from tallyhouse.plans import files, journeys, panels, profiles, register, relations

    return [register.C, panels.C, relations.C, journeys.C, profiles.C, files.C]
