"""Column-level building blocks (all built-in Spark expressions)."""
from vigil.functions.expr import *  # noqa: F401,F403
