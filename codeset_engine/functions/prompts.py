"""Prompt templates and chat messages as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, functions as F, types as T

from .. import schemas

PLACEHOLDER = r"\{(\w+)\}"


def _json_shape(kind: T.DataType, indent: int = 0) -> str:
    """Example JSON of a response type, with braces doubled for use inside a template."""
    pad = "  " * (indent + 1)
    if isinstance(kind, T.StructType):
        body = ",\n".join(f'{pad}"{f.name}": {_json_shape(f.dataType, indent + 1)}' for f in kind)
        return "{{\n" + body + "\n" + "  " * indent + "}}"
    if isinstance(kind, T.ArrayType):
        return f"[{_json_shape(kind.elementType, indent)}]"
    names = {T.DoubleType: "0.0", T.BooleanType: "true", T.IntegerType: "0"}
    return names.get(type(kind), '"text"')


def _template(task: str, inputs: Mapping[str, str], response: T.StructType | None) -> str:
    """Task line, one titled block per variable, and the expected JSON derived from the schema."""
    blocks = [task] + [f"{title}:\n{{{name}}}" for name, title in inputs.items()]
    if response is not None:
        blocks.append("Answer with JSON of this form only:\n" + _json_shape(response))
    return "\n\n".join(blocks)


# Template names and their variables. The wording is this project's own; any
# other template with the same variables can be passed to render_prompt.
TEMPLATES: dict[str, str] = {
    "diagnosis_extraction": _template(
        "List every diagnosis, condition and symptom stated in the document. Quote the terms as "
        "written, add qualifiers and severity where given, and infer nothing.",
        {"document_text": "Document"}, schemas.DIAGNOSES_RESPONSE),
    "procedure_extraction": _template(
        "List every procedure, treatment and intervention stated in the document, with site, "
        "side and approach where given. Infer nothing.",
        {"document_text": "Document"}, schemas.PROCEDURES_RESPONSE),
    "icd10_suggestion": _template(
        "Choose the most specific ICD-10 codes for the entity from the candidates and rate your "
        "confidence between 0 and 1.",
        {"medical_entity": "Entity", "context": "Context", "retrieved_codes": "Candidates"},
        schemas.SUGGESTIONS_RESPONSE),
    "cpt_suggestion": _template(
        "Choose the CPT codes that describe the procedure best from the candidates, with "
        "modifiers and related codes, and rate your confidence between 0 and 1.",
        {"procedure": "Procedure", "context": "Context", "retrieved_codes": "Candidates"},
        schemas.SUGGESTIONS_RESPONSE),
    "code_validation": _template(
        "Check whether the documentation supports the code, whether the code is specific and "
        "complete, and which rules it breaks.",
        {"code": "Code", "code_description": "Description", "documentation": "Documentation"},
        schemas.VALIDATION_RESPONSE),
    "reranking": _template(
        "Order the candidate codes by relevance to the entity and score each between 0 and 1.",
        {"medical_entity": "Entity", "context": "Context", "candidates": "Candidates"},
        schemas.RERANK_RESPONSE),
    "audit_summary": _template(
        "Summarise the coding session in Markdown: documents, codes, mean confidence, codes of "
        "high confidence (>0.85) and codes to review (<0.6), issues by severity, advice.",
        {"session_data": "Session"}, None),
    "medical_ner": _template(
        "Mark all diagnoses, procedures, medications, anatomy, laboratory tests and vital signs "
        "with their character positions.",
        {"text": "Text"}, schemas.ENTITIES_RESPONSE),
}


def template_named(name: str) -> str:
    if name not in TEMPLATES:
        raise KeyError(f"Prompt '{name}' not found. Available: {sorted(TEMPLATES)}")
    return TEMPLATES[name]


def prompt_variables(template: str) -> list[str]:
    """Distinct placeholder names of a template, in order of appearance."""
    return list(dict.fromkeys(re.findall(PLACEHOLDER, template)))


def prompt_variables_column(template: Column) -> Column:
    """The same for a column of templates."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1)))


def render_prompt(template: str, values: Mapping[str, Column]) -> Column:
    """Template with placeholders filled from columns.

    The template is taken apart once, at plan time, so braces inside values are never
    expanded. Null values become empty text. Missing variables are an error.
    """
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            if name not in values:
                raise KeyError(f"Missing required variable for prompt: '{name}'")
            pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def render_named(name: str, **values: Column) -> Column:
    return render_prompt(template_named(name), values)


def build_messages(user: Column, system: Column | None = None,
                   context: Column | None = None) -> Column:
    """``array<struct<role, content>>``: system if any, context if any, user."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def optional(role: str, value: Column | None, content: Column | None) -> list[Column]:
        return [] if value is None else [F.when(value != "", message(role, content))]

    context_text = None if context is None else F.concat(F.lit("Context:\n"), context)
    return F.array_compact(F.array(*optional("system", system, system),
                                   *optional("user", context, context_text),
                                   message("user", user)))
