"""Keyed change data on Spark: ordered puts and deletes, sorted immutable runs, merge-on-read lookups, compaction, recovery."""
