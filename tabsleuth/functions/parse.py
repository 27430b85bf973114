"""Parsing of model replies and prompts (SC11-SC16, SC18, SC20, SC22, L7, L8).

All JVM-side string / regex / VARIANT expressions: a reply column of any
size is parsed without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

# The markers of the reasoning protocol.
FINAL_MARK = "final answer:"
THOUGHT_MARK = "thought:"
ACTION_MARK = "Action:"
ANSWER_MARK = "Answer:"
STOP_SEQUENCES = ["Observation:", "\nThought"]


def _after_last(text: Column, marker: str, case_insensitive: bool) -> Column:
    flags = "(?is)" if case_insensitive else "(?s)"
    import re
    return F.regexp_extract(text, flags + ".*" + re.escape(marker) + "(.*)", 1)


def final_candidate(text: Column) -> Column:
    """SC11 step 1 (L8): the text that should hold the final JSON."""
    c = strip_ws(text)
    low = F.lower(c)
    after = strip_ws(F.substring_index(_after_last(c, FINAL_MARK, True), "\n", 1))
    c = (F.when(low.contains(FINAL_MARK), after)
         .when(low.startswith(THOUGHT_MARK), strip_ws(F.substring(c, len(THOUGHT_MARK) + 1, 1 << 30)))
         .otherwise(c))
    fenced = c.startswith("```")
    stripped = strip_ws(F.regexp_replace(c, r"^`+|`+$", ""))
    stripped = F.when(F.lower(stripped).startswith("json"), strip_ws(F.substring(stripped, 5, 1 << 30))) \
        .otherwise(stripped)
    return F.when(fenced, stripped).otherwise(c)


def literal_to_json(c: Column) -> Column:
    """True / False / None of a Python literal as their JSON words."""
    x = F.regexp_replace(c, r"\bTrue\b", "true")
    x = F.regexp_replace(x, r"\bFalse\b", "false")
    return F.regexp_replace(x, r"\bNone\b", "null")


def _parse_literal(c: Column) -> Column:
    """JSON whose strings may be in single quotes, as VARIANT; null if it is not."""
    return F.from_json(c, "variant", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def parse_final(text: Column) -> Column:
    """SC11: struct(ok, table_source, answer VARIANT, candidate)."""
    cand = final_candidate(text)
    braced = F.when(cand.rlike(r"(?s)^\{.*\}$"), cand)
    v = F.coalesce(F.try_parse_json(cand), _parse_literal(braced), _parse_literal(literal_to_json(braced)))
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    src = F.try_variant_get(v, "$.table_source", "variant")
    ans = F.try_variant_get(v, "$.answer", "variant")
    ok = F.coalesce(is_obj & src.isNotNull() & ans.isNotNull(), F.lit(False))
    raw = F.coalesce(F.get_json_object(cand, "$.answer"), F.get_json_object(literal_to_json(cand), "$.answer"))
    return F.struct(ok.alias("ok"), F.when(ok, src.cast("string")).alias("table_source"),
                    F.when(ok, ans).alias("answer"), F.when(ok, raw).alias("answer_raw"),
                    cand.alias("candidate"))


def is_terminal(text: Column, parsed_ok: Column | None = None) -> Column:
    """SC13: 'final answer:' in any case, or a parsable final JSON."""
    ok = parsed_ok if parsed_ok is not None else parse_final(text)["ok"]
    return F.lower(text).contains(FINAL_MARK) | ok


def parse_plain(text: Column) -> Column:
    """SC12: text after the last 'Answer:', first line, stripped."""
    return F.when(text.contains(ANSWER_MARK),
                  strip_ws(F.substring_index(_after_last(text, ANSWER_MARK, False), "\n", 1)))


def parse_action(text: Column) -> Column:
    """SC14: code after the last 'Action:' -- a triple-backtick block (language
    tag skipped), else a single-backtick span, else the stripped text."""
    after = _after_last(text, ACTION_MARK, False)
    triple = F.regexp_extract(after, r"(?is)```(\w*\s*)?(.*?)```", 2)
    has_triple = after.rlike(r"(?is)```(\w*\s*)?(.*?)```")
    single = F.regexp_extract(after, r"(?s)`(.*?)`", 1)
    has_single = after.rlike(r"(?s)`(.*?)`")
    code = (F.when(has_triple, strip_ws(triple)).when(has_single, strip_ws(single)).otherwise(strip_ws(after)))
    return F.when(text.contains(ACTION_MARK), code)


def extract_list(text: Column, greedy: bool = True) -> Column:
    """SC15: the JSON list from the first '[' to the last (greedy) or first
    ']'; array<string> or null when absent or not a list."""
    pat = r"(?s)\[.*\]" if greedy else r"(?s)\[.*?\]"
    return F.from_json(F.regexp_extract(text, pat, 0), "array<string>")


def stop_cut(text: Column, stops: Sequence[str] = tuple(STOP_SEQUENCES)) -> Column:
    """SC16: cut at the earliest occurrence of any stop sequence."""
    pos = F.least(*[F.when(F.locate(s, text) > 0, F.locate(s, text)) for s in stops])
    return F.when(pos.isNull(), text).otherwise(F.substring(text, 1, pos - 1))


def observation_text(code: Column, output: Column, n_rows: Column | None = None) -> Column:
    """SC18: no action -> error text; an empty result frame -> 'Empty
    DataFrame'; empty output -> 'success!'; multi-line output gets a
    leading newline."""
    c = F.when(code.isNull(), F.lit("Error: no action found."))
    if n_rows is not None:
        c = c.when(n_rows == 0, F.lit("Empty DataFrame"))
    return (c.when(F.coalesce(strip_ws(output), F.lit("")) == "", F.lit("success!"))
            .when(output.contains("\n"), F.concat(F.lit("\n"), output))
            .otherwise(output))


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """SC20: ``str.format`` with named fields; ``{{`` / ``}}`` are literal braces.

    The template is cut at its fields before any value is put in, so braces in
    a value are never read as fields."""
    x = F.regexp_replace(F.regexp_replace(template, r"\{\{", "\u0001"), r"\}\}", "\u0002")
    for i, k in enumerate(values):
        x = F.replace(x, F.lit("{" + k + "}"), F.lit(f"\u0003{i}\u0004"))
    x = F.replace(F.replace(x, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
    parts = F.split(x, "\u0003")
    filled = F.array(*[F.coalesce(v.cast("string"), F.lit("None")) for v in values.values()]) if values else None
    if filled is None:
        return x
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(
        F.element_at(filled, F.substring_index(p, "\u0004", 1).cast("int") + 1), F.substring_index(p, "\u0004", -1)))
    return F.concat(parts[0], F.array_join(rest, ""))


def drop_evidence(prompt: Column, evidence: Column, placeholder: str = "[evidence omitted]") -> Column:
    """Replace the evidence block after the first round."""
    return F.replace(prompt, evidence, F.lit(placeholder))

