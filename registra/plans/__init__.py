"""Registered queries of the register operators and their SQL twins."""

from . import electors, exports, households, pages, records, reports, roll, storage

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (electors, records, pages, reports, storage, exports, households, roll):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
