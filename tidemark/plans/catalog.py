"""All registered queries of the market engine; importing the modules registers them."""

from tidemark.plans import connector_queries, feed_queries, frame_queries, indicator_queries, relational_queries, request_queries, series_queries, service_queries, streaming_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
