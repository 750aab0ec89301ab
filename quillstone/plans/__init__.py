"""The registered queries of the note-to-form operators."""

from . import forms, queries, records  # noqa: F401  (each adds its own to queries.QUERIES and queries.SQL)

CORE = queries
