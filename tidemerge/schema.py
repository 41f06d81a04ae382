"""Shapes of the tables that the operators take and give.

The order of arrival is always explicit: ``seq`` within a log, ``file_id`` among runs. A deletion is a row with
``is_deleted`` and an empty value, never a null value.
"""

from __future__ import annotations

CHANGE = "seq bigint, key string, value string, is_deleted boolean"
RUN = "file_id bigint, key string, value string, is_deleted boolean"
WAL_RECORD = "operation string, key string, value string, timestamp bigint"
MANIFEST = "ordinal int, path string, file_id bigint"
LOOKUP = "key string, status string, value string"

FOUND, DELETED, ABSENT = "FOUND", "DELETED", "ABSENT"

#: An entry's estimated overhead is a tree node of 80 bytes and 32 more; a write buffer holds 4096 bytes; every
#: 16th entry of a run is indexed; a Bloom filter is made for 1000 keys at a false-positive rate of 0.01 unless told otherwise.
ENTRY_OVERHEAD = 112
WRITE_BUFFER_BYTES = 4096
INDEX_INTERVAL = 16
BLOOM_KEYS, BLOOM_RATE = 1000, 0.01
