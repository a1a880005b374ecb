"""All queries over the engine's own operators."""

from lodeline.plans import analytics, keyvalue, storage

QUERIES = keyvalue.R.queries | analytics.R.queries | storage.R.queries
ORACLE_SQL = keyvalue.R.sql | analytics.R.sql | storage.R.sql
