"""All registered queries of the session engine."""

from . import detect_queries, evaluate_queries, stream_queries, verdict_queries  # noqa: F401  they register themselves

flagship = detect_queries.e14_self_check
