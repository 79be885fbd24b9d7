"""The queries, by family."""

from . import assets, catalog, decisions, extensions, files, grid, identity, index, ledger, patch, platforms, published, streams, surface, sync  # noqa: F401
