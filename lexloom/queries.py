"""Registry of the core queries: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from .plans import audit, cleaning, lexical

QUERIES = {**lexical.QUERIES, **audit.QUERIES, **cleaning.QUERIES}
SQL = {**lexical.SQL, **audit.SQL, **cleaning.SQL}
