"""Reading tables with fixed schemas, writing results."""

from crashlens.sources.readers import Staged, convert_tables, read_rejects, read_strings, read_table, read_tables, stage_table
from crashlens.sources.schemas import SCHEMAS
from crashlens.sources.sinks import scratch_path, write_result

__all__ = [
    "SCHEMAS",
    "Staged",
    "convert_tables",
    "read_rejects",
    "read_strings",
    "read_table",
    "read_tables",
    "scratch_path",
    "stage_table",
    "write_result",
]
