"""ledgerscope: suspicious-activity analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's own
expressions, so Catalyst plans, prunes and pushes down the whole pipeline.
"""

from ledgerscope.params import Params, DEFAULT_PARAMS

__all__ = ["Params", "DEFAULT_PARAMS"]
