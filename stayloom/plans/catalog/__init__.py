"""Named queries over the star-schema test tables, each with the SQL it must agree with."""

from . import clinic, cohort, dose, encoding, learning, profiles, roundtrips, tests_of_association

_PARTS = (cohort, dose, profiles, encoding, tests_of_association, learning, clinic, roundtrips)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
