"""Compiled chat templates against plain Python, on all conversations."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import templates as tp
from kestrel.plans.q_text import TURN_TEMPLATE
from tests.conftest import SF001

HEADER = """{% for message in messages %}
{% if message['role'] == 'user' %}
{{ '<|user|>\\n' + message['content'] + eos_token }}
{% elif message.role == 'system' %}
{{ '<|system|>\\n' + message.content + eos_token }}
{% else %}
{{ '<|' + message['role'] + '|>\\n' + message['content'].strip() + eos_token }}
{% endif %}
{% if loop.last and add_generation_prompt %}
{{ '<|assistant|>' }}
{% endif %}
{% endfor %}"""
BRACKETS = """{{ bos_token }}{%- for message in messages -%}
  {%- if message['role'] in ['user', 'system'] -%}
    {{ '[INST] ' + message['content'] | trim + ' [/INST]' }}
  {%- elif not loop.first and loop.index0 % 2 == 1 -%}
    {{ ' ' + message['content'] + ' ' + eos_token }}
  {%- else -%} ? {%- endif -%}
{%- endfor -%}"""


def turns(ms):
    out = "" if ms[0][0] == "system" else "<|im_start|>system\nBe brief.<|im_end|>\n"
    for i, (role, text) in enumerate(ms):
        out += f"<|im_start|>{role}\n{text.strip()}<|im_end|>\n"
        if i == len(ms) - 1 and role != "assistant":
            out += "<|im_start|>assistant\n"
    return out


def header(ms):
    out = "".join(f"<|{r}|>\n{x if r in ('user', 'system') else x.strip()}</s>\n" for r, x in ms)
    return out + "<|assistant|>\n"


def brackets(ms):
    out = "<s>"
    for i, (role, text) in enumerate(ms):
        out += f"[INST] {text.strip()} [/INST]" if role in ("user", "system") else f" {text} </s>" if i % 2 else "?"
    return out


@pytest.mark.parametrize("template,plain", [(TURN_TEMPLATE, turns), (HEADER, header), (BRACKETS, brackets)])
def test_templates_equal_plain_text(spark, template, plain):
    rows = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(-5, 0, None, " \u3000x\x1c\n"), (-5, 1, "assistant", None), (-5, None, "user", "\t"), (-6, 0, "system", "s"), (None, 1, "tool", "")]
    both = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    got = tp.render_template_chat(both, template, add_generation_prompt=True, bos_token="<s>", eos_token="</s>").collect()
    by: dict = {}
    for r in both.collect():
        by.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    want = {c: plain([m[1:] for m in sorted(ms)]) for c, ms in by.items()}
    assert {r.conv_id: r.prompt for r in got} == want


@pytest.mark.parametrize("bad", ["{% for x in y %}{% endfor %}", "{% if a %}", "{{ nothing }}", "{{ message.__class__() }}", "{% set a = 1 %}"])
def test_unknown_parts_are_refused(spark, bad):
    with pytest.raises(ValueError):
        tp.compile_template(bad, F.array(), a=True)
