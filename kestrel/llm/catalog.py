"""Registered queries of the corpus operators and their DuckDB oracles.

Every query reads its whole table and derives the digest columns of its
contract from what the operator returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import (bit_slices, chat_trees, filter_audit, html_extract, line_dedup, mixing, near_dups, nn_descent,
                         piece_tokenizer, quality_rules, sharding, toxicity, turn_repair)
from kestrel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space of the contracts as a DuckDB class.
_WS = r"[\x20\x09-\x0D]"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- 1 -----------------------------------------------------------------

@query("op1_html_extraction")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, d, "pages"))


# --- 2 -----------------------------------------------------------------

@query("op2_toxicity")
def op2(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit_on_labels(docs, table(spark, d, "labels"))
    return toxicity.score_texts(docs, model).select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


# --- 3 -----------------------------------------------------------------

@query("op3_nn_descent")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return nn_descent.nearest_neighbours(table(spark, d, "embeddings"))


# --- 4 -----------------------------------------------------------------

@query("op4_line_dedup", rf"""
WITH lines AS (
  SELECT doc_id, n_all, unnest(xs) AS line, unnest(range(1, n_all + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs, len(string_split(coalesce(text, ''), chr(10))) AS n_all FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, max(n_all)::BIGINT AS n_lines, count(*) FILTER (k IN (FROM shared))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (FROM shared)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id""")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.map_kept(table(spark, d, "documents"), lambda text, n, dropped: (n, dropped, _sha(text)),
                               "n_lines bigint, n_dropped bigint, kept_sha256 string", ["doc_id"])


# --- 5 -----------------------------------------------------------------

_PROBE = "<|im_end|><|im_start|>assistant ok"


@query("op5_chat_formatting", rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
esc AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id""")
def op5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(_PROBE).alias("text"))
    done = chat_trees.format_branches(chat_trees.chains(rows.unionByName(probe)))
    back = done.select("tree", "formatted", chat_trees.read_turns(F.col("formatted")).alias("turns"),
                       chat_trees.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


# --- 6 -----------------------------------------------------------------

#: Production mix: shares of each level's values (unlisted: 1).
MIX_WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
MIX_EPOCHS, MIX_PERCENT, MIX_SEED = 4, 100, 11


def mix_levels() -> dict:
    """Domain (the last digit group of the source's name mod 3), language,
    source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1)
    domain = F.concat(F.lit("d"), (F.when(number != "", number).otherwise(F.lit("0")).cast("bigint") % 3).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def _fill_sql(out: str, src: str, parents: str, child: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""
{out}_a AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS rest,
  (sum(w) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS heavy,
  row_number() OVER ({by} ORDER BY cap / w, {child}) AS rn FROM {src}),
{out}_b AS (SELECT *, min(CASE WHEN rest * w < cap * heavy THEN rn END) OVER ({by}) AS f FROM {out}_a),
{out} AS (SELECT *, CASE WHEN f IS NULL OR rn < f THEN cap ELSE least(cap,
  (max(CASE WHEN rn = f THEN rest END) OVER ({by})) * w // (max(CASE WHEN rn = f THEN heavy END) OVER ({by}))) END::BIGINT AS share FROM {out}_b)"""


def _weight_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1 END::BIGINT"


@query("op6_source_mixing", rf"""
WITH docs AS (
  SELECT doc_id, 'd' || (CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 0
      ELSE regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1)::BIGINT END % 3) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> ''))::BIGINT AS n,
    coalesce(doc_id::VARCHAR, 'null') || '-' || md5(coalesce(text, '')) AS fp FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM docs GROUP BY ALL),
d0 AS (SELECT domain, (sum(tokens) * {MIX_EPOCHS})::BIGINT AS cap, {_weight_sql('domain')} AS w,
  (SELECT sum(tokens) * {MIX_PERCENT} // 100 FROM leaf)::BIGINT AS budget FROM leaf GROUP BY domain),
{_fill_sql('d1', 'd0', '', 'domain')},
l0 AS (SELECT domain, lang, (sum(tokens) * {MIX_EPOCHS})::BIGINT AS cap, {_weight_sql('lang')} AS w, any_value(share) AS budget
  FROM leaf JOIN d1 USING (domain) GROUP BY domain, lang),
{_fill_sql('l1', 'l0', 'domain', 'lang')},
s0 AS (SELECT domain, lang, source, tokens, tokens * {MIX_EPOCHS} AS cap, {_weight_sql('source')} AS w, share AS budget
  FROM leaf JOIN l1 USING (domain, lang)),
{_fill_sql('s1', 's0', 'domain, lang', 'source')},
quota AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest FROM s1),
placed AS (SELECT *, md5('{MIX_SEED}-' || epochs::VARCHAR || '-' || fp) AS k FROM docs JOIN quota USING (domain, lang, source)),
cum AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - sum(n) OVER (PARTITION BY domain, lang, source, k) AS before FROM placed)
SELECT doc_id, domain, lang, source, n AS n_tokens, (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM cum""")
def op6(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", mix_levels()["domain"])
    mixed = mixing.select_mix(docs, {k: F.col(k) for k in ("domain", "lang", "source")}, MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"),
                        F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "copies")


# --- 7 -----------------------------------------------------------------

def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_digest(tok, ids):
    return len(ids), _sha(tok.listed(ids)), _sha(tok.decode(ids))


@query("op7_sentencepiece")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return piece_tokenizer.map_tokens(table(spark, d, "documents"), piece_model(), token_digest,
                                      "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id"])


# --- 8 -----------------------------------------------------------------

@query("op8_near_dups", rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'),
                             lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
size_ AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN size_ a ON a.doc_id = x JOIN size_ b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x)
SELECT x AS doc_id, coalesce((SELECT n FROM size_ s WHERE s.doc_id = x), 0)::BIGINT AS n_shingles, min(y) AS component_id, min(y) = x AS kept
FROM reach GROUP BY x""")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, d, "documents"), width=3, percent=85).select(
        F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


# --- 9 -----------------------------------------------------------------

@query("op9_sharding")
def op9(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, d, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, ["doc_id"], n_shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


# --- 10 ----------------------------------------------------------------

@query("op10_quality_rules", rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM base),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM rep) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({', '.join(repr(x) for x in sorted(set(quality_rules.STOP_WORDS.split())))}))) AS n_stop
  FROM base LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND word_chars / n_words BETWEEN 1.5 AND 25.0 AND n_symbols / n_words <= 0.5
   AND n_stop / n_words >= 0.01 AND n_dup_lines / n_lines <= 0.7) AS kept FROM m""")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, d, "documents")).drop("failed_rule")


# --- 11 ----------------------------------------------------------------

def _hash_turns(old, rows: list[tuple[str, str]]):
    """SHA-256 of the rows as lines ``role:text``, with \\n between."""
    state, some = old
    state = state.copy()
    state.update(("\n" if some else "").encode() + "\n".join(f"{r}:{t}" for r, t in rows).encode())
    return state, True


DIGEST = turn_repair.Fold(lambda: (hashlib.sha256(), False), _hash_turns, lambda x: x[0].hexdigest(), "string")


def _repair_moves() -> str:
    """(state, initial or null for any, blank rows too, cost, letters, new
    lines before, role of the row or null, whether the row stays, next state)."""
    rows = []
    for state in range(4):
        lines, letters, cost, s = "", "", 0, state
        for _ in range(3):
            rows.append((state, None, True, cost + 4, letters + "D", lines, None, False, s))
            rows += [(state, i, False, cost, letters + "K", lines, None, True, n) for i, n in turn_repair.NEXT[s].items()]
            role = turn_repair.WANTED[s]
            rows.append((state, None, False, cost + 3, letters + "R", lines, role, True, turn_repair.NEXT[s][role[0]]))
            lines, letters, cost, s = f"{lines}{role}:|", letters + "I", cost + 3, turn_repair.NEXT[s][role[0]]
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(lit, r))})" for r in rows)


@query("op11_turn_repair", rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM raw WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
    regexp_replace(text, '{_WS}+$', '') AS said FROM placed),
marked AS (
  SELECT *, said = '' AS blank, said <> '' AND again > 1 AS dup, said <> '' AND again = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS trunc,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM seen),
moves(s, init, gone, cost, letters, lines, role, stays, s2) AS (VALUES {_repair_moves()}),
path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s, min(cost)::BIGINT, arg_min(audit, lpad(cost::VARCHAR, 9, '0') || audit), arg_min(lines, lpad(cost::VARCHAR, 9, '0') || audit) FROM (
    SELECT p.conv_id, p.i + 1 AS i, m.s2 AS s, p.cost + m.cost + CASE WHEN m.stays AND r.trunc THEN 3 ELSE 0 END AS cost,
      p.audit || m.letters AS audit,
      p.lines || replace(m.lines, '|', chr(10)) || CASE WHEN m.stays THEN coalesce(m.role, r.role) || ':' || r.text || chr(10) ELSE '' END AS lines
    FROM path p JOIN marked r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    JOIN moves m ON m.s = p.s AND (m.init IS NULL OR m.init = left(r.role, 1)) AND (m.gone OR NOT (r.blank OR r.dup))) GROUP BY conv_id, i, s),
ends AS (
  SELECT conv_id, cost + e.c AS cost, audit || e.l AS audit, lines || replace(e.t, '|', chr(10)) AS lines
  FROM path JOIN (VALUES (0, 0, '', ''), (1, 6, 'II', 'user:|assistant:|'), (2, 3, 'I', 'assistant:|'), (3, 0, '', '')) e(s, c, l, t) USING (s)
  QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
best AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, lpad(cost::VARCHAR, 9, '0') || audit) AS audit,
  arg_min(lines, lpad(cost::VARCHAR, 9, '0') || audit) AS lines FROM ends GROUP BY conv_id),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
  sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM best b LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id""")
def op11(spark: SparkSession, d: str) -> DataFrame:
    hurt = turn_repair.damage(table(spark, d, "conversations"))
    return turn_repair.repair(hurt, DIGEST, "repaired_sha256", copies=F.col("copies"), gone=F.col("gone"))


# --- 12 ----------------------------------------------------------------

@query("op12_filter_audit", rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS ws FROM documents),
fails AS (
  SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
      100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM w),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM fails LEFT JOIN marks USING (doc_id)),
v(i) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT part, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, k AS step, o[k] AS i,
    count(*) FILTER (NOT f[o[k]] AND NOT before) AS kept, count(*) FILTER (f[o[k]] AND NOT before) AS removed,
    count(*) FILTER (f[o[k]] AND before) AS redundant, count(*) FILTER (f[o[k]] AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails,
    count(*) FILTER (f[o[k]] AND NOT before AND good = 1) AS good_lost, count(*) FILTER (f[o[k]] AND NOT before AND toxic = 1) AS toxic_lost
  FROM (SELECT *, len(list_filter(o[:k - 1], lambda x: f[x])) > 0 AS before FROM docs, orders, (SELECT unnest(range(1, 6))::INT AS k)) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM steps""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    own = filter_audit.own_failures(F.col("text"))
    masks = filter_audit.failure_masks(table(spark, d, "documents"), own)
    return filter_audit.interaction_audit(filter_audit.part_counts(masks, table(spark, d, "labels")), "".join(own) + "E")


# --- 13 ----------------------------------------------------------------

@query("op13_bit_sliced_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return bit_slices.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
