from .ingest import collect_stream, ingest_files, table_stream  # noqa: F401
from .state import current_state, failures_since_checkpoint, latest_state, stale_sources  # noqa: F401
from .timers import failures_by_cursor, rocks_store, silent_sources, stored_values  # noqa: F401
from .windows import dedup_stream, session_counts, windowed_counts  # noqa: F401
