"""Sales, recipe and document analytics expressed as Spark DataFrame plans.

Sub-packages:

- ``sources``   -- role binding of the input tables, readers (CSV, JSON, pages)
- ``functions`` -- column-expression helpers (money, text, calendar)
- ``operators`` -- the analytics operators (sales, recipes, periods, checks,
                   rewrites, retrieval, guarded SQL, answers, generation)
- ``plans``     -- the registered queries and their SQL oracles
- ``streaming`` -- incremental (Structured Streaming) variants
"""

from ledgerline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
