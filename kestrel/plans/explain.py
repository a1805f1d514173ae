"""Write the physical plans of the headline queries to PLANS.md.

``python -m kestrel.plans.explain [sf_dir]`` — each entry is the tree part of
``explain("formatted")`` (scan schemas, pushed filters, exchanges, joins,
window limits), so plan reviews can be diffed between rounds.
"""

from __future__ import annotations

import contextlib
import io
import sys


NOTES = {
    "c1_bm25_topk": "Eager operator: the plan shown is the final read of the written top-k table; the scoring "
                    "plan runs inside bm25_topk (one corpus scan, Arrow vocabulary lookup, running top-k).",
    "c2_dense_topk": "Corpus scan → Arrow matmul with a running top-k (MapInPandas) → partial WindowGroupLimit → one exchange on qid.",
    "d1_has_answer": "Run table ⋈ corpus, Arrow NFC projection, JVM token match.",
    "g7_evaluate_predictions": "Reads the written per-(dataset, kept, score) counts; metrics and AUROC derive from it.",
    "h8_pack_chunks": "Token arrays join their start offsets; pieces regroup by chunk id (bounded by chunk length).",
    "e4_threshold_stop": "Stop rank by a per-question window over ≤ top_k rows, then max_by arg-max per question.",
    "a7_skip_if_done": "Anti-join against the distinct done keys (AQE handles a skewed key).",
}


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    out = []
    for line in buf.getvalue().splitlines():
        if line.startswith("(1)"):
            break
        out.append(line)
    return "\n".join(out).strip()


def main(sf_dir: str = "/root/testdata/sf0.01") -> None:
    from kestrel.plans.catalog import QUERIES
    from kestrel.session import get_spark

    import tempfile

    spark = get_spark("local[8]", 8, extra={"spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='kestrel-plans-')}"})
    parts = ["# Physical plans of headline queries\n",
             f"Generated by `python -m kestrel.plans.explain {sf_dir}` (Spark {spark.version}, AQE on; "
             "initial plans — AQE may coalesce partitions or switch joins at run time).\n"]
    for name, note in NOTES.items():
        df = QUERIES[name](spark, sf_dir)
        parts.append(f"## {name}\n\n{note}\n\n```\n{tree(df)}\n```\n")
        if name == "c1_bm25_topk":
            import numpy as np

            from kestrel.operators import retrieval as rt
            from kestrel.plans import fixtures as fx

            qt = rt.query_terms(fx.queries(spark, sf_dir)).toPandas()
            di = rt.bm25_doc_index(fx.corpus(spark, sf_dir), np.array(sorted(qt["term"].unique()), dtype=object))
            parts.append("### c1 corpus pass inside bm25_topk (one scan, no exchange)\n\n"
                         f"```\n{tree(di)}\n```\n")
    with open("PLANS.md", "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
