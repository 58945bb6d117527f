"""All queries of the library."""

from __future__ import annotations

from quern.plans import extensions, relational, scalars, stored, windows, workloads
from quern.plans.registry import Catalogue

CATALOGUE = Catalogue()
for _part in (relational, windows, scalars, stored, workloads, extensions):
    CATALOGUE.include(_part.C)
