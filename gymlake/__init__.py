"""gymlake: fitness-club analytics as Spark DataFrame operators.

Every operator is a pure ``DataFrame -> DataFrame`` function that answers for
all gyms, coaches and members at once.  "Today" is always an explicit
``as_of`` argument; nothing reads the clock.
"""

from gymlake.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
