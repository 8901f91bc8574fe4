"""Every query of the reference's own operators; importing the modules registers them."""

from ..operators import analytics, calibration, coordination, dashboards, detectors, evaluation, graph, graphruns, ingestion, lookups, memory, parallel, replay, scalars, sessions, similarity, staleness, states, trajectories, turnwise, windows  # noqa: F401
from ..streaming import realtime  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
