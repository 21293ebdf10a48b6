"""Collecting every reason why a row is refused.

While a row is being processed its reasons are one text column,
``code:fields,code:fields``; it is empty for good rows, so carrying and testing
it costs almost nothing.  Only refused rows get it turned into a map.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

NO_PROBLEMS = ""


def problem(code: str, where: dict[str, Column]) -> Column:
    """``code:field field`` naming the fields whose condition holds, NULL when none does."""
    if len(where) == 1:
        [(field, condition)] = where.items()
        return F.when(condition, F.lit(f"{code}:{field}"))
    fields = F.concat_ws(" ", *[F.when(condition, F.lit(field)) for field, condition in where.items()])
    return F.when(reduce(or_, where.values()), F.concat(F.lit(f"{code}:"), fields))


def add_problems(known: Column, *found: Column) -> Column:
    return F.concat_ws(",", F.nullif(known, F.lit(NO_PROBLEMS)), *found)


def errors_map(problems: Column) -> Column:
    """Problem text -> ``map<code, fields>``; empty for a good row."""
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(problems == NO_PROBLEMS, nothing).otherwise(F.str_to_map(problems, F.lit(","), F.lit(":")))
