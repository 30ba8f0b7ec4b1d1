"""Registered queries: importing this package registers all of them."""

from . import events, queries, research  # noqa: F401
