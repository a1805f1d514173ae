"""Chat templates compiled to one Column.

A template in the usual Jinja form of tokenizer files is read once on the
driver and becomes a Column over an array of messages; no Python runs per row.
Supported: ``{% for message in messages %}``, ``{% if %}`` / ``elif`` / ``else``,
``{{ ... }}`` with strings joined by ``+``, ``message['role']`` and
``message['content']`` (or with a dot), ``messages[n]``, ``loop.first``,
``loop.last``, ``loop.index``, ``loop.index0``, ``%``, ``==``, ``!=``, ``in``,
``and``, ``or``, ``not``, ``| trim``, ``.strip()``, and names given as
parameters (``add_generation_prompt``, ``bos_token``, ...). Anything else is a
``ValueError``. Like the tokenizers' own setting, a line break after a block and
blanks before one are not text.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python's and Jinja's trim take off.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_TAG = re.compile(r"\{%-?\s*(?P<block>.*?)\s*-?%\}|\{\{-?\s*(?P<out>.*?)\s*-?\}\}", re.S)


def _pieces(template: str) -> list[tuple[str, str]]:
    """(kind, content) of the texts, blocks and outputs in order."""
    out, at, cut_left = [], 0, ""
    for m in _TAG.finditer(template):
        text = template[at:m.start()]
        if cut_left == "all":
            text = text.lstrip()
        elif cut_left == "line":
            text = text.removeprefix("\n")
        is_block = m["block"] is not None
        if m[0][2] == "-":
            text = text.rstrip()
        elif is_block and ((bare := text.rstrip(" \t")).endswith("\n") or (not bare and cut_left != "")):
            text = bare
        out += [("text", text)] if text else []
        out.append(("block", m["block"]) if is_block else ("out", m["out"]))
        cut_left = "all" if m[0][-3] == "-" else "line" if is_block else ""
        at = m.end()
    rest = template[at:].lstrip() if cut_left == "all" else template[at:].removeprefix("\n") if cut_left == "line" else template[at:]
    return out + ([("text", rest)] if rest else [])


def _parse(pieces: list[tuple[str, str]], ends: tuple[str, ...] = ()) -> list[tuple]:
    """Nodes up to one of the block words ``ends``, which stays in ``pieces``."""
    nodes: list[tuple] = []
    while pieces:
        kind, content = pieces[0]
        word = content.split(None, 1)[0] if kind == "block" and content else ""
        if kind == "block" and word in ends:
            return nodes
        pieces.pop(0)
        if kind != "block":
            nodes.append((kind, content))
        elif word == "for":
            if content.split() != ["for", "message", "in", "messages"]:
                raise ValueError(f"only loops over messages: {content}")
            nodes.append(("for", _parse(pieces, ("endfor",))))
            pieces.pop(0)
        elif word == "if":
            cases = [(content[2:], _parse(pieces, ("elif", "else", "endif")))]
            while not (head := pieces.pop(0)[1]).startswith("endif"):
                cond = head[4:] if head.startswith("elif") else "True"
                cases.append((cond, _parse(pieces, ("elif", "else", "endif"))))
            nodes.append(("if", cases))
        else:
            raise ValueError(f"unknown block: {content}")
    if ends:
        raise ValueError(f"template ends without {' or '.join(ends)}")
    return nodes


def _value(source: str, scope: dict) -> Column:
    # a filter binds tighter than any operator, as a method call does
    tree = ast.parse(re.sub(r"\|\s*trim\b", ".strip()", source.strip()), mode="eval").body

    def get(name: str) -> Column:
        if name not in scope:
            raise ValueError(f"unknown name in a template: {name}")
        return scope[name]

    def field(of: ast.expr, name: str) -> Column:
        if isinstance(of, ast.Name) and of.id == "loop":
            return get(f"loop.{name}")
        return F.coalesce(walk(of)[name], F.lit(""))

    def walk(e: ast.expr) -> Column:
        match e:
            case ast.Constant(value=str() | int() | bool() as v):
                return F.lit(v)
            case ast.Name(id=name):
                return get(name)
            case ast.Attribute(value=of, attr=name) | ast.Subscript(value=of, slice=ast.Constant(value=str() as name)):
                return field(of, name)
            case ast.Subscript(value=of, slice=ast.Constant(value=int() as i)):
                return F.get(walk(of), F.lit(i))
            case ast.Call(func=ast.Attribute(value=of, attr="strip"), args=[], keywords=[]):
                return F.btrim(walk(of), F.lit(BLANKS))
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return F.concat(walk(a), walk(b))
            case ast.BinOp(left=a, op=ast.Mod(), right=b):
                return walk(a) % walk(b)
            case ast.BoolOp(op=ast.And(), values=[first, *rest]):
                c = walk(first)
                for r in rest:
                    c = c & walk(r)
                return c
            case ast.BoolOp(op=ast.Or(), values=[first, *rest]):
                c = walk(first)
                for r in rest:
                    c = c | walk(r)
                return c
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return ~walk(a)
            case ast.Compare(left=a, ops=[op], comparators=[b]):
                match op:
                    case ast.Eq():
                        return walk(a).eqNullSafe(walk(b))
                    case ast.NotEq():
                        return ~walk(a).eqNullSafe(walk(b))
                    case ast.In() if isinstance(b, ast.List | ast.Tuple):
                        return walk(a).isin(*[ast.literal_eval(x) for x in b.elts])
                    case ast.In():
                        return F.contains(walk(b), walk(a))
        raise ValueError(f"not supported in a template: {ast.unparse(e)}")

    return walk(tree)


def _render(nodes: list[tuple], scope: dict) -> Column:
    parts = []
    for kind, content in nodes:
        if kind == "text":
            parts.append(F.lit(content))
        elif kind == "out":
            parts.append(_value(content, scope))
        elif kind == "for":
            parts.append(F.array_join(F.transform(scope["messages"], _turn(content, scope)), ""))
        else:
            chosen = F
            for cond, body in content:
                chosen = chosen.when(_value(cond, scope), _render(body, scope))
            parts.append(chosen.otherwise(F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _turn(body: list[tuple], scope: dict):
    """The text of a loop's body for a message and its position."""
    def text(m: Column, i: Column) -> Column:
        return _render(body, scope | {"message": m, "loop.index0": i, "loop.index": i + 1, "loop.first": i == 0,
                                      "loop.last": i == F.size(scope["messages"]) - 1})
    return text


def compile_template(template: str, messages: Column, **names: str | bool) -> Column:
    """The text of ``template`` for ``messages``, an array of structs with
    ``role`` and ``content``. ``names`` are the values of its free names."""
    return _render(_parse(_pieces(template)), {"messages": messages, **{k: F.lit(v) for k, v in names.items()}})


def render_template_chat(messages: DataFrame, template: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", **names: str | bool) -> DataFrame:
    """(conv, prompt, n_messages): ``template`` over each conversation's rows by
    turn, role and text. Null roles and texts are empty; a null conversation
    id is one conversation; an empty table gives no rows. A conversation is
    one prompt, so its rows meet in one task."""
    empty = F.lit("")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("content"))
    g = messages.groupBy(conv).agg(F.sort_array(F.collect_list(one)).alias("_m"))
    return g.select(conv, compile_template(template, F.col("_m"), **names).alias("prompt"), F.size("_m").alias("n_messages"))
