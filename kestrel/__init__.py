"""kestrel: question-answering retrieval, reranking and calibration on Spark.

Every operator is either a ``Column -> Column`` expression builder
(``kestrel.functions``) or a ``DataFrame -> DataFrame`` function
(``kestrel.operators``). Sources and sinks live in ``kestrel.sources``;
the registered query catalogue and its DuckDB oracles in ``kestrel.plans``.
"""

from kestrel.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
