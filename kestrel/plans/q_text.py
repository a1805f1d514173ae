"""Text-function (B) queries over documents, benchmark, conversations and
the derived prompts."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from kestrel.functions import text as tx
from kestrel.operators import prompts as pr
from kestrel.operators import templates as tp
from kestrel.plans import fixtures as fx
from kestrel.plans.registry import query
from kestrel.plans.oracle import LABELS_SQL, register, sql, toks
from kestrel.plans.q_calibration import parse_sql
from kestrel.plans.q_rerank import END, START, prompts


def chars_sql(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s) if s else "''"


def lit_sql(s: str) -> str:
    """SQL string literal for any text (newlines via chr)."""
    parts = s.split("\n")
    q = [("'" + p.replace("'", "''") + "'") for p in parts]
    return " || chr(10) || ".join(q)


def norm_text_sql(x: str) -> str:
    e = f"translate({x}, {chars_sql(tx.NORM_FROM)}, {chars_sql(tx.NORM_TO)})"
    for ch, n in tx.NORM_PRIMES:
        e = f"replace({e}, chr({ord(ch)}), '{chr(39) * 2 * n}')"
    e = f"replace({e}, chr({ord('…')}), '...')"
    return f"replace({e}, ' . . . ', ' ... ')"


@query("b1_normalize_text", sql(f"SELECT doc_id, md5({norm_text_sql('text')}) AS norm_md5 FROM documents"))
def b1(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.normalize_text("text")).alias("norm_md5"))


@query("b2_word_tokens", sql(f"""SELECT doc_id, CAST(len({toks('text', False)}) AS INTEGER) AS n_tokens,
  md5(array_to_string({toks('text')}, ' ')) AS tokens_md5 FROM documents"""))
def b2(spark, d):
    docs = fx.table(spark, d, "documents")
    t = tx.word_tokens("text", lower=False)
    return docs.select("doc_id", F.size(t).alias("n_tokens"),
                       F.md5(F.array_join(tx.word_tokens("text"), " ")).alias("tokens_md5"))


@query("b3_canonical_unicode", sql("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5 FROM documents"))
def b3(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.canonical_unicode("text")).alias("nfc_md5"))


PUNCT = "'" + string.punctuation.replace("'", "''") + "'"


@query("b4_normalize_answer", sql(f"""SELECT item_id AS qid, array_to_string(list_filter(
  string_split_regex(translate(lower(text), {PUNCT}, ''), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the') AND w <> ''), ' ') AS norm
  FROM benchmark"""))
def b4(spark, d):
    b = fx.table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("qid"), tx.normalize_answer("text").alias("norm"))


@query("b5_compose_passage", sql("""SELECT doc_id AS pid,
  md5(CASE WHEN length(coalesce(source, '')) > 0 THEN source || ' ' || text ELSE text END) AS passage_md5 FROM documents"""))
def b5(spark, d):
    c = fx.corpus(spark, d)
    return c.select("pid", F.md5(tx.compose_passage("title", "text")).alias("passage_md5"))


TPL_B6 = "[<title>] <context>\nQ: <question>\nA:"


@query("b6_render_template", sql(f"""SELECT c.qid, c.rank,
  md5(replace(replace(replace({lit_sql(TPL_B6)}, '<question>', q.q), '<title>', c.title), '<context>', c.text)) AS prompt_md5
  FROM fx_ctx c JOIN fx_queries q USING (qid)""", "fx_ctx", "fx_queries"))
def b6(spark, d):
    r = fx.retrievals(spark, d)
    ex = r.select("qid", "q", F.posexplode("contexts").alias("rank", "c"))
    p = tx.render_template(TPL_B6, [("<question>", F.col("q")), ("<title>", F.col("c.title")),
                                    ("<context>", F.col("c.text"))])
    return ex.select("qid", F.col("rank").cast("int").alias("rank"), F.md5(p).alias("prompt_md5"))


@query("b7_render_context_block", sql("""SELECT qid, md5(chr(10) || string_agg(title || ' - ' || text, chr(10) ORDER BY rank)) AS block_md5
  FROM fx_ctx WHERE rank < 3 GROUP BY qid""", "fx_ctx"))
def b7(spark, d):
    r = fx.retrievals(spark, d)
    return r.select("qid", F.md5(tx.render_context_block("contexts", 3)).alias("block_md5"))


@query("b8_extract_between", sql(f"""SELECT qid, rank,
  md5(regexp_replace(split_part(split_part(z_prompt, '{START}', 2), '{END}', 1), '^\\s+|\\s+$', '', 'g')) AS section_md5,
  md5(split_part(z_prompt, chr(10), 1)) AS head_md5,
  md5(substr(z_prompt, strpos(z_prompt, chr(10)) + 1)) AS rest_md5
  FROM fx_prompts""", "fx_prompts"))
def b8(spark, d):
    p = prompts(spark, d)
    head, rest = tx.split_once("z_prompt", "\n")
    return p.select("qid", "rank", F.md5(tx.extract_between("z_prompt", START, END)).alias("section_md5"),
                    F.md5(head).alias("head_md5"), F.md5(rest).alias("rest_md5"))


@query("b9_render_chat", sql("""SELECT conv_id, md5('<|system|>' || chr(10) || 'Be brief.' || chr(10)
  || string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10)) AS prompt_md5,
  count(*) AS n_messages FROM conversations GROUP BY conv_id"""))
def b9(spark, d):
    c = fx.table(spark, d, "conversations")
    r = pr.render_chat(c, system="Be brief.")
    return r.select("conv_id", F.md5("prompt").alias("prompt_md5"), F.col("n_messages").cast("long").alias("n_messages"))


TURN_TEMPLATE = """{% if messages[0]['role'] != 'system' %}<|im_start|>system
Be brief.<|im_end|>
{% endif %}{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\\n' + message['content'] | trim + '<|im_end|>' }}
{% if loop.last and add_generation_prompt and message['role'] != 'assistant' %}<|im_start|>assistant
{% endif %}{% endfor %}"""
_blanks = " || ".join(f"chr({ord(c)})" for c in tp.BLANKS)


@query("b9b_chat_template", sql(f"""SELECT conv_id, md5(
    CASE WHEN first(r ORDER BY turn, r, x) <> 'system' THEN '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) ELSE '' END
    || string_agg('<|im_start|>' || r || chr(10) || trim(x, {_blanks}) || '<|im_end|>' || chr(10), '' ORDER BY turn, r, x)
    || CASE WHEN last(r ORDER BY turn, r, x) <> 'assistant' THEN '<|im_start|>assistant' || chr(10) ELSE '' END) AS prompt_md5,
  count(*) AS n_messages FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations) GROUP BY conv_id"""))
def b9b(spark, d):
    r = tp.render_template_chat(fx.table(spark, d, "conversations"), TURN_TEMPLATE, add_generation_prompt=True)
    return r.select("conv_id", F.md5("prompt").alias("prompt_md5"), F.col("n_messages").cast("long").alias("n_messages"))


@query("b10_inject_before", sql("""SELECT a.qid, a.rank, a.t,
  md5(replace(p.z_prompt, 'Answer:', printf('Temperature: %.4f', a.temperature) || chr(10) || 'Answer:')) AS prompt_md5
  FROM fx_attempts a JOIN fx_prompts p USING (qid, rank)""", "fx_attempts", "fx_prompts"))
def b10(spark, d):
    a = fx.attempts(spark, d).join(prompts(spark, d).select("qid", "rank", "z_prompt"), ["qid", "rank"])
    return a.select("qid", "rank", "t",
                    F.md5(tx.inject_before("z_prompt", "Answer:", tx.temperature_line("temperature"))).alias("prompt_md5"))


@query("b11_cut_at_tag", sql("""SELECT doc_id, md5(split_part(text, '.', 1) || '.' || ' [more]') AS cut_md5 FROM documents"""))
def b11(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.cut_at_tag("text", ".", F.lit(" [more]"))).alias("cut_md5"))


@query("b12_is_abstain", sql("SELECT id, CAST(contains(lower(y_pred), 'no answer') AS INTEGER) AS abstain FROM fx_preds", "fx_preds"))
def b12(spark, d):
    return fx.preds(spark, d).select("id", tx.is_abstain("y_pred").cast("int").alias("abstain"))


@query("b13_parse_verdict", sql("""SELECT conv_id, turn, CAST(contains(lower(trim(text)), 'yes') AS INTEGER) AS verdict
  FROM conversations"""))
def b13(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.parse_verdict("text").alias("verdict"))


@query("b14_grade_substring", sql("""SELECT c.qid, c.rank, CAST(contains(c.text, q.answer) AS INTEGER) AS correct
  FROM fx_ctx c JOIN fx_queries q USING (qid)""", "fx_ctx", "fx_queries"))
def b14(spark, d):
    r = fx.retrievals(spark, d)
    ex = r.select("qid", "answer", F.posexplode("contexts").alias("rank", "c"))
    return ex.select("qid", F.col("rank").cast("int").alias("rank"),
                     tx.grade_substring(F.col("answer"), F.col("c.text")).alias("correct"))


@query("b15_parse_list", sql(f"""SELECT item_id AS qid, CAST(len(w) AS INTEGER) AS n, array_to_string(w, '|') AS items FROM (
  SELECT item_id, {toks('text', False)} AS w FROM benchmark)"""))
def b15(spark, d):
    """Every token of the text, in single and double quotes by turns."""
    b = fx.table(spark, d, "benchmark")
    item = lambda t, i: F.when(i % 2 == 0, F.concat(F.lit("'"), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
                               ).otherwise(F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    lit = F.concat(F.lit("["), F.array_join(F.transform(tx.word_tokens("text", lower=False), item), ", "), F.lit("]"))
    parsed = tx.parse_list(lit)
    return b.select(F.col("item_id").alias("qid"), F.size(parsed).alias("n"), F.array_join(parsed, "|").alias("items"))


@query("b16_format_confidence", sql(f"""SELECT qid, rank, t,
  CASE t % 3 WHEN 2 THEN {LABELS_SQL}[CAST(floor(c * 10) AS INTEGER) + 1]
             WHEN 1 THEN CAST(round(round(c * 10, 2), 2) AS VARCHAR) || ' (0-10)'
             ELSE CAST(round(c * 100, 2) AS VARCHAR) || ' (0-100)' END AS c_text
  FROM fx_attempts""", "fx_attempts"))
def b16(spark, d):
    a = fx.attempts(spark, d)
    ctype = F.element_at(F.array(F.lit("ct"), F.lit("number"), F.lit("ling")), (F.col("t") % 3) + 1)
    val = (F.when(ctype == "ling", F.floor(F.col("c") * 10)).when(ctype == "number", F.round(F.col("c") * 10, 2))
           .otherwise(F.col("c")))
    return a.select("qid", "rank", "t", tx.format_confidence(val, ctype).alias("c_text"))


register("fx_eval_src", ["fx_preds"], f"SELECT id, c_type, c_raw, ({parse_sql()}) AS p FROM fx_preds")


@query("b17_parse_confidence", sql(
    "SELECT id, c_type, c_raw, round(p, 6) AS p FROM fx_eval_src", "fx_eval_src"))
def b17(spark, d):
    p = fx.preds(spark, d)
    return p.select("id", "c_type", "c_raw", F.round(tx.parse_confidence("c_raw", "c_type"), 6).alias("p"))


@query("b18_verbal_scale", sql(f"""SELECT id, CAST(list_position({LABELS_SQL}, c_raw) - 1 AS INTEGER) AS idx, c_raw AS label
  FROM fx_preds WHERE c_type = 'ling'""", "fx_preds"))
def b18(spark, d):
    p = fx.preds(spark, d).where(F.col("c_type") == "ling")
    idx = tx.verbal_index("c_raw")
    return p.select("id", idx.alias("idx"), tx.verbal_label(idx).alias("label"))


JUDGE_TPL = "Question: <question>\nGold: <ground-truth>\nPredictions:\n<predictions>"


@query("b19_judge_prompt", sql(f"""SELECT qid, md5(replace(replace(replace({lit_sql(JUDGE_TPL)}, '<predictions>', preds), '<question>', q), '<ground-truth>', answer)) AS prompt_md5
FROM (SELECT c.qid, first(q.q) AS q, first(q.answer) AS answer,
             string_agg(CAST(c.rank + 1 AS VARCHAR) || '. ' || c.title, chr(10) ORDER BY c.rank) AS preds
      FROM fx_ctx c JOIN fx_queries q USING (qid) GROUP BY c.qid)""", "fx_ctx", "fx_queries"))
def b19(spark, d):
    r = fx.retrievals(spark, d)
    preds = F.transform("contexts", lambda c: c["title"])
    return r.select("qid", F.md5(tx.judge_prompt(JUDGE_TPL, preds, F.col("q"), F.col("answer"))).alias("prompt_md5"))


SUFFIX = "\nHow sure are you at temperature <temp_value>?"


@query("b20_append_question", sql(f"""SELECT a.qid, a.rank, a.t,
  md5(p.z_prompt || ' ' || q.answer || replace({lit_sql(SUFFIX)}, '<temp_value>', CAST(a.temperature AS VARCHAR))) AS prompt_md5
  FROM fx_attempts a JOIN fx_prompts p USING (qid, rank) JOIN fx_queries q USING (qid)""",
                                   "fx_attempts", "fx_prompts", "fx_queries"))
def b20(spark, d):
    a = fx.attempts(spark, d).join(prompts(spark, d).select("qid", "rank", "z_prompt"), ["qid", "rank"]) \
        .join(fx.queries(spark, d).select("qid", "answer"), "qid")
    out = tx.append_question("z_prompt", F.concat(F.lit(" "), F.col("answer")), SUFFIX, temperature=F.col("temperature"))
    return a.select("qid", "rank", "t", F.md5(out).alias("prompt_md5"))
