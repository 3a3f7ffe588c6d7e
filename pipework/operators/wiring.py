"""The runtime's rules for queues and stage wiring, as data: the runner checks one
spec with them, the catalogue checks whole tables of specs."""

from __future__ import annotations

# --- fixed values: queue types and messages (verbatim) --------------------
QUEUE_TYPES = ("QUEUE_TYPE_UNSPECIFIED", "QUEUE_TYPE_IN_MEMORY")
MSG_CAPACITY = "queue capacity must be > 0: %s"
MSG_SCHEMA_ID = "queue schema_id is required: %s"
MSG_QUEUE_TWICE = "duplicate queue name: %s"
MSG_QUEUE_TYPE = "unsupported queue type for queue: %s"
MSG_WIRING = "invalid %s stage wiring: %s"
# -------------------------------------------------------------------------

#: kind → (has an input queue, has an output queue)
WIRING = {"source": (False, True), "transform": (True, True), "sink": (True, False)}
