"""evograph: architecture-evolution analytics expressed as Spark DataFrame jobs.

Every table is keyed by ``(project, version)`` (graphs) or
``(project, v_old, v_new)`` (transitions) so that all projects and all
version pairs are processed in one distributed job.
"""

from evograph.session import get_spark, ensure_checkpoint_dir  # noqa: F401

GRAPH_KEY = ["project", "version"]
TRANSITION_KEY = ["project", "v_old", "v_new"]
