"""All queries over the library's own operators, with their SQL."""

from __future__ import annotations

from evalloom.plans import agree, assembly, cases, logs

QUERIES: dict = {**agree.QUERIES, **logs.QUERIES, **cases.QUERIES, **assembly.QUERIES}
SQL: dict = {**agree.SQL, **logs.SQL, **cases.SQL, **assembly.SQL}
