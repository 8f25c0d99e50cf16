"""Registered queries; importing this package registers all of them."""

from . import block_queries, codec_queries, colour_queries, media_queries, scan_queries, stats_queries, stream_queries, structure_queries  # noqa: F401
