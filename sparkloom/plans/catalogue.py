"""All queries of the library."""

from sparkloom.plans import checking, extras, faulting, joining, merging, publishing, reading, scalars, star, tables  # noqa: F401
from sparkloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
