"""All registered queries by name."""

from premia.registry import (
    calculating, cleaning, grouping, quality, reporting, running, scanning, statistics, trending,
)

MODULES = (scanning, cleaning, calculating, grouping, trending, quality, statistics, reporting,
           running)


def all_queries():
    return {q.name: q for module in MODULES for q in module.QUERIES}
