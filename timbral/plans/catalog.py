"""All registered queries of the base library and their SQL twins."""

from timbral.plans import acoustics, changes, queries, records, scoring, speakers, updates, voiceprints  # noqa: F401  each registers its own

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
