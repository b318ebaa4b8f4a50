"""All registered queries; importing the modules registers them."""

from tessella.plans import cluster_queries, color_queries, evaluation_queries, field_queries, graph_queries, math_queries, plot_queries, point_queries, sampling_queries, source_queries, stream_queries  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES  # noqa: F401
