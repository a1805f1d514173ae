"""DuckDB rebuild of the fixtures, as named CTEs.

``sql(body, *fixtures)`` returns ``WITH <fixtures and their dependencies>
<body>``. Expressions mirror ``kestrel.plans.fixtures`` term by term.
"""

from __future__ import annotations

from kestrel.functions.text import TOKEN_PATTERN, VERBAL_LABELS

PAT = TOKEN_PATTERN.replace("'", "''")


def u(tag: str, *keys: str) -> str:
    """SQL twin of kestrel.functions.hashing.uniform."""
    key = " || '-' || ".join([f"'{tag}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def toks(expr: str, lower: bool = True) -> str:
    t = f"regexp_extract_all({expr}, '{PAT}', 1)"
    return f"list_transform({t}, lambda x: lower(x))" if lower else t


LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in VERBAL_LABELS) + "]"

FX: dict[str, tuple[list[str], str]] = {}


def _fx(name, deps, body):
    FX[name] = (deps, body)


_fx("fx_corpus", [], "SELECT doc_id AS pid, source AS title, text FROM documents")
_fx("fx_queries", [], f"""SELECT item_id AS qid, text AS q,
  array_to_string(list_slice({toks('text')}, 1, 4), ' ') AS answer FROM benchmark""")
_fx("bm_qt", ["fx_queries"], f"""SELECT DISTINCT qid, lower(unnest(regexp_extract_all(q, '{PAT}', 1))) AS term
  FROM fx_queries""")
_fx("bm_dt", ["fx_corpus"], f"""SELECT pid, regexp_extract_all(
  CASE WHEN length(coalesce(title, '')) > 0 THEN title || ' ' || text ELSE text END, '{PAT}', 1) AS toks
  FROM fx_corpus""")
_fx("bm_st", ["bm_dt"], "SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM bm_dt")
_fx("bm_tf", ["bm_dt", "bm_qt"], """SELECT pid, dl, term, count(*) AS tf FROM (
  SELECT pid, len(toks) AS dl, lower(unnest(toks)) AS term FROM bm_dt)
  WHERE term IN (SELECT term FROM bm_qt) GROUP BY pid, dl, term""")
_fx("bm_df", ["bm_tf"], "SELECT term, count(*) AS df FROM bm_tf GROUP BY term")
_fx("bm_sc", ["bm_qt", "bm_tf", "bm_df", "bm_st"], """SELECT bm_qt.qid, bm_tf.pid,
  sum(ln(1 + (bm_st.n - bm_df.df + 0.5) / (bm_df.df + 0.5)) * bm_tf.tf
      / (bm_tf.tf + 1.2 * (1 - 0.75 + 0.75 * bm_tf.dl / bm_st.avgdl))) AS score
  FROM bm_qt JOIN bm_tf USING (term) JOIN bm_df USING (term), bm_st GROUP BY bm_qt.qid, bm_tf.pid""")
_fx("fx_run", ["bm_sc"], """SELECT qid, pid, score, rank FROM (
  SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid ASC) - 1 AS INTEGER) AS rank
  FROM bm_sc) WHERE rank < 40""")
_fx("fx_ctx", ["fx_run", "fx_corpus"], """SELECT r.qid, r.rank, r.pid, r.score, c.title, c.text
  FROM fx_run r JOIN fx_corpus c USING (pid)""")
_fx("fx_attempts", ["fx_run"], f"""SELECT qid, rank, pid, t, (t + 10) / 10.0 AS temperature,
  round({u('c', 'qid', 'pid', 't')}, 2) AS c, round({u('prob', 'qid', 'pid', 't')}, 2) AS prob
  FROM (SELECT qid, rank, pid, CAST(unnest(range(6)) AS INTEGER) AS t FROM fx_run)""")
_fx("fx_preds", [], f"""SELECT lang AS dataset, doc_id AS id, quality AS y,
  round({u('p', 'doc_id')}, 2) AS p,
  CASE WHEN {u('na', 'doc_id')} < 0.1 THEN 'No answer'
       ELSE 'The answer is ' || regexp_extract(text, '{PAT}', 1) END AS y_pred,
  CASE WHEN {u('ctype', 'doc_id')} < 0.34 THEN 'ling' WHEN {u('ctype', 'doc_id')} < 0.67 THEN 'number' ELSE 'ct' END AS c_type,
  CASE WHEN {u('ctype', 'doc_id')} < 0.34 THEN {LABELS_SQL}[CAST(floor({u('craw', 'doc_id')} * 11) AS BIGINT) + 1]
       WHEN {u('ctype', 'doc_id')} < 0.67 THEN
         CASE WHEN {u('craw', 'doc_id')} < 0.5 THEN CAST(CAST(floor({u('craw', 'doc_id')} * 22) AS BIGINT) AS VARCHAR)
              ELSE CAST(CAST(floor({u('craw', 'doc_id')} * 20 - 10) AS BIGINT) AS VARCHAR) || '.5' END
       ELSE CAST(round({u('craw', 'doc_id')} * 100, 1) AS VARCHAR) || ' (0-100)' END AS c_raw
  FROM labels JOIN documents USING (doc_id)""")
_fx("fx_logits", [], """SELECT vec_id AS id, CAST(list_slice(embedding, 1, 11) AS DOUBLE[]) AS logits, label AS y
  FROM embeddings""")
_fx("fx_tokens", [], f"""SELECT doc_id, list_transform(regexp_extract_all(text, '{PAT}', 1),
  lambda t: CAST((('0x' || substr(md5(t), 1, 8))::BIGINT % 30000) AS INTEGER)) AS tokens FROM documents""")


def register(name: str, deps: list[str], body: str) -> None:
    """Add a named CTE usable by later oracle queries."""
    _fx(name, deps, body)


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in FX[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(body: str, *fixtures: str | None) -> str:
    fixtures = tuple(f for f in fixtures if f)
    if not fixtures:
        return body
    parts = [f"{n} AS ({FX[n][1]})" for n in _order(list(fixtures))]
    return "WITH " + ",\n".join(parts) + "\n" + body
