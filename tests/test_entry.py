"""The registration works without what a subpackage needs."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys, warnings
warnings.simplefilter("ignore")
sys.modules[{blocked!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert "cer" in names and not any(n.startswith("op1_") for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_without_the_optional_subpackage():
    for blocked in ("inkwell.llm", "xxhash"):
        subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=Path(__file__).parents[1], check=True, timeout=120)


def test_package_is_shipped(spark):
    from inkwell import shipping

    shipping.ship(spark)
    shipping.ship(spark)

    def here(batches):
        import inkwell

        for _ in batches:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([inkwell.__name__])], names=["name"])

    assert spark.range(1).mapInArrow(here, "name string").first()[0] == "inkwell"
