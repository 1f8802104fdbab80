"""All registered queries of the engine."""

from versemill.catalog import ORACLES, QUERIES
from versemill.queries import editions, extras, reading, repair, storage, structure, study

__all__ = ["ORACLES", "QUERIES", "editions", "extras", "reading", "repair", "storage", "structure", "study"]
