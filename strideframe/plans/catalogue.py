"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import images, records, relational, sequences, skeletons

FLAGSHIP = "q10_steady_segments"
QUERIES = relational.QUERIES | sequences.QUERIES | skeletons.QUERIES | records.QUERIES | images.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | sequences.ORACLE_SQL | skeletons.ORACLE_SQL | records.ORACLE_SQL | images.ORACLE_SQL
