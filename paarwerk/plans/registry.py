"""All queries of the core, and the SQL that checks them."""

from paarwerk.plans.oracles import ORACLES
from paarwerk.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
