"""Print the formatted physical plan of registered queries: python scripts/explain.py sf_dir name..."""
import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

from gymlake.plans import catalog  # noqa: E402
from gymlake.session import get_spark  # noqa: E402
from gymlake.sources.tables import Tables  # noqa: E402

spark = get_spark("local[8]", 16)
catalog.queries()
for name in sys.argv[2:]:
    df = catalog.REGISTRY[name].build(Tables(spark, sys.argv[1]))
    print(f"===== {name}")
    df.explain("formatted" if os.environ.get("FULL") else "simple")
