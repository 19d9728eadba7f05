"""Row types of the data model. Schemas are always explicit, never inferred."""

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# --- code tables -----------------------------------------------------------------
ICD10CM = _struct(code=S, description=S, code_type=S, category=S, is_billable=B)
ICD10PCS = _struct(code=S, description=S, code_type=S, section=S, body_system=S)
CPT = _struct(code=S, description=S, code_type=S)

# One physical table holds all code sets; type-specific columns are null elsewhere.
CODES = _struct(code=S, description=S, code_type=S, category=S, is_billable=B,
                section=S, body_system=S, collection_type=S, year=I)
COLUMNS_BY_TYPE = {"icd10cm": ICD10CM.names, "icd10pcs": ICD10PCS.names, "cpt": CPT.names}

YEAR_METADATA = _struct(year=I, code_type=S, exists=B, total_codes=L, file_size=L, file_path=S,
                        last_updated=T.TimestampType(), columns=T.ArrayType(S))

# --- vector collections ----------------------------------------------------------
COLLECTION_ENTRY = _struct(id=S, collection=S, embedding=T.ArrayType(T.FloatType()), document=S,
                           metadata=T.MapType(S, S), code=S, description=S, collection_type=S,
                           code_type=S, year=I)

CHUNK = _struct(source_file=S, source_path=S, file_type=S, file_size_kb=D, code_type=S, year=S,
                cms_category=S, chunk_index=I, total_chunks=I, chunk_id=S, chunk_size=I,
                has_previous_chunk=B, has_next_chunk=B, page_number=I, start_index=I,
                page_label=S, total_pages=I, element_type=S, parent_element=S, sheet_name=S,
                row_number=I)

# --- model responses -------------------------------------------------------------
DIAGNOSIS = _struct(condition=S, qualifier=S, severity=S, context=S, location_in_text=S)
PROCEDURE = _struct(procedure_name=S, anatomical_site=S, laterality=S, approach=S, context=S,
                    location_in_text=S)
ISSUE = _struct(issue_type=S, severity=S, description=S, recommendation=S)
SUGGESTION = _struct(code=S, description=S, confidence=D, reasoning=S, specificity_level=S,
                     modifiers=T.ArrayType(S), additional_codes=T.ArrayType(S))
RERANKED = _struct(code=S, description=S, relevance_score=D, reasoning=S)
ENTITY = _struct(text=S, type=S, start=I, end=I, context=S)

DIAGNOSES_RESPONSE = _struct(diagnoses=T.ArrayType(DIAGNOSIS))
PROCEDURES_RESPONSE = _struct(procedures=T.ArrayType(PROCEDURE))
SUGGESTIONS_RESPONSE = _struct(suggestions=T.ArrayType(SUGGESTION), notes=S)
VALIDATION_RESPONSE = _struct(is_valid=B, validation_score=D, issues=T.ArrayType(ISSUE),
                              alternative_codes=T.ArrayType(S), compliance_notes=S)
RERANK_RESPONSE = _struct(reranked_codes=T.ArrayType(RERANKED))
ENTITIES_RESPONSE = _struct(entities=T.ArrayType(ENTITY))

USAGE = _struct(prompt_tokens=L, completion_tokens=L, total_tokens=L)
MODEL_CALL = _struct(content=S, role=S, finish_reason=S, usage=USAGE, duration=D, model=S)
MESSAGE = _struct(role=S, content=S)

# --- logs ------------------------------------------------------------------------
AUDIT_EVENT = _struct(timestamp=T.TimestampType(), level=S, module=S, function=S, line=I,
                      message=S, user=S, action=S, resource=S)
