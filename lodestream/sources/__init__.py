from lodestream.sources.schemas import ATTEMPT_SCHEMA, RECORD_SCHEMA
from lodestream.sources.store import SnapshotStore
from lodestream.sources.tables import read_table, seed_records

__all__ = ["ATTEMPT_SCHEMA", "RECORD_SCHEMA", "SnapshotStore", "read_table", "seed_records"]
