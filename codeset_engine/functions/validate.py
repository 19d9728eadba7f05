"""Validators. Each returns ``struct<is_valid: boolean, error: string>``.

Errors are built as a chain of conditions; the first that holds names the problem and
none means the value is valid. Null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .strings import strip

# Accepted formats, limits and messages.
ICD10CM_PATTERN = r"^[A-TV-Z][0-9]{2}(\.[A-Z0-9]{1,4})?$"
ICD10PCS_PATTERN = r"^[0-9A-HJ-NP-Z]{7}$"
CPT_PATTERN = r"^[0-9]{5}$"
HCPCS_PATTERN = r"^[A-Z][0-9]{4}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ALLOWED_EXTENSIONS = (".csv", ".docx", ".pdf", ".txt", ".xls", ".xlsx")
MAX_FILE_SIZE_MB = 50
CPT_MIN, CPT_MAX = 10, 99999
MIN_YEAR = 2015

# Messages. Those that end in a space are followed by the value.
EMPTY_CODE = "Code cannot be empty"
BAD_ICD10CM = "Invalid ICD-10-CM format: "
ICD10PCS_LENGTH = "ICD-10-PCS must be exactly 7 characters: "
BAD_ICD10PCS = "Invalid ICD-10-PCS format: "
BAD_CPT = "Invalid CPT format (must be 5 digits): "
CPT_OUT_OF_RANGE = "CPT code out of valid range: "
BAD_HCPCS = "Invalid HCPCS format: "
UNKNOWN_TYPE = "Unknown code type: "
EMPTY_FILENAME = "Filename cannot be empty"
EMPTY_FILE = "File is empty (0 bytes)"
FILE_TOO_BIG = f"File size %.1fMB exceeds maximum {MAX_FILE_SIZE_MB}MB"
NO_SUCH_FILE = "File does not exist: "
NOT_A_FILE = "Path is not a file: "
SCORE_NOT_NUMERIC = "Confidence score must be numeric, got "
SCORE_OUT_OF_RANGE = "Confidence score must be between 0 and 1, got "
YEAR_NOT_INTEGER = "Year must be an integer, got "
BAD_EMAIL = "Invalid email format: "
NOT_A_MAP = "Expected dictionary, got null"
MISSING_KEYS = "Missing required keys: "


def _outcome(error: Column) -> Column:
    return F.struct(error.isNull().alias("is_valid"), error.alias("error"))


def _first_error(*checks: tuple[Column, Column]) -> Column:
    """Message of the first condition that holds, null when none does."""
    return F.coalesce(*[F.when(condition, message) for condition, message in checks],
                      F.lit(None).cast("string"))


def _said(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _is_blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def _icd10cm_error(code: Column) -> Column:
    clean = F.upper(strip(code))
    return _first_error(
        (_is_blank(code), F.lit(EMPTY_CODE)),
        (~clean.rlike(ICD10CM_PATTERN), _said(BAD_ICD10CM, clean)),
    )


def _icd10pcs_error(code: Column) -> Column:
    clean = F.upper(strip(code))
    return _first_error(
        (_is_blank(code), F.lit(EMPTY_CODE)),
        (F.length(clean) != 7, _said(ICD10PCS_LENGTH, clean)),
        (~clean.rlike(ICD10PCS_PATTERN), _said(BAD_ICD10PCS, clean)),
    )


def _cpt_error(code: Column) -> Column:
    clean = strip(code)
    in_range = clean.between(f"{CPT_MIN:05d}", f"{CPT_MAX:05d}")   # five digits by then
    return _first_error(
        (_is_blank(code), F.lit(EMPTY_CODE)),
        (~clean.rlike(CPT_PATTERN), _said(BAD_CPT, clean)),
        (~in_range, _said(CPT_OUT_OF_RANGE, clean)),
    )


def _hcpcs_error(code: Column) -> Column:
    clean = F.upper(strip(code))
    return _first_error(
        (_is_blank(code), F.lit(EMPTY_CODE)),
        (~clean.rlike(HCPCS_PATTERN), _said(BAD_HCPCS, clean)),
    )


_CODE_ERRORS = {"icd10cm": _icd10cm_error, "icd10pcs": _icd10pcs_error,
                "cpt": _cpt_error, "hcpcs": _hcpcs_error}


def validate_icd10cm(code: Column) -> Column:
    return _outcome(_icd10cm_error(code))


def validate_icd10pcs(code: Column) -> Column:
    return _outcome(_icd10pcs_error(code))


def validate_cpt(code: Column) -> Column:
    return _outcome(_cpt_error(code))


def validate_hcpcs(code: Column) -> Column:
    return _outcome(_hcpcs_error(code))


def validate_code(code: Column, code_type: Column) -> Column:
    """Validator chosen per row by ``code_type`` (any case)."""
    kind = F.lower(code_type)
    unknown = ~F.coalesce(kind.isin(*_CODE_ERRORS), F.lit(False))
    error = F.when(unknown, _said(UNKNOWN_TYPE, F.coalesce(code_type, F.lit("null"))))
    for name, rule in _CODE_ERRORS.items():
        error = error.when(kind == name, rule(code))
    return _outcome(error)


def file_extension(name: Column) -> Column:
    """Lower-case suffix of the last path part; a leading or trailing dot is no suffix."""
    return F.lower(F.regexp_extract(F.rtrim(name, F.lit("/")), r"[^/](\.[^./]+)$", 1))


def _extension_error(name: Column) -> Column:
    extension = file_extension(name)
    refused = F.concat(F.lit("File type '"), extension, F.lit("' not allowed. Allowed: "),
                       F.lit(", ".join(ALLOWED_EXTENSIONS)))
    return _first_error(
        (_is_blank(name), F.lit(EMPTY_FILENAME)),
        (~extension.isin(*ALLOWED_EXTENSIONS), refused),
    )


def _size_error(n_bytes: Column) -> Column:
    # bround: a size exactly between two tenths goes to the even one, as in Python.
    megabytes = F.bround(n_bytes.cast("double") / F.lit(1024.0 * 1024.0), 1)
    too_big = F.format_string(FILE_TOO_BIG, megabytes)
    return _first_error(
        (n_bytes > MAX_FILE_SIZE_MB * 1024 * 1024, too_big),
        (n_bytes == 0, F.lit(EMPTY_FILE)),
    )


def validate_file_extension(name: Column) -> Column:
    return _outcome(_extension_error(name))


def validate_file_size(n_bytes: Column) -> Column:
    return _outcome(_size_error(n_bytes))


def validate_file(path: Column, n_bytes: Column, exists: Column, is_file: Column) -> Column:
    """Existence, kind, extension, size: the first failure wins."""
    return _outcome(F.coalesce(
        F.when(~exists, _said(NO_SUCH_FILE, path)),
        F.when(~is_file, _said(NOT_A_FILE, path)),
        _extension_error(path),
        _size_error(n_bytes),
    ))


def validate_confidence(score: Column) -> Column:
    """``score`` may be a number or text; text that is no number is refused."""
    number = score.try_cast("double")
    return _outcome(_first_error(
        (number.isNull() | F.isnan(number), _said(SCORE_NOT_NUMERIC,
                                                  F.coalesce(score.cast("string"), F.lit("null")))),
        (~number.between(0.0, 1.0), _said(SCORE_OUT_OF_RANGE, score)),
    ))


def validate_year(year: Column, as_of: Column) -> Column:
    """``as_of`` is the current year, passed in so that results are repeatable."""
    number = year.try_cast("int")
    latest = as_of + 1
    return _outcome(_first_error(
        (number.isNull(), _said(YEAR_NOT_INTEGER,
                                F.coalesce(year.cast("string"), F.lit("null")))),
        (number < MIN_YEAR, F.concat(F.lit("Year "), number.cast("string"),
                                     F.lit(f" is too old (minimum {MIN_YEAR})"))),
        (number > latest, F.concat(F.lit("Year "), number.cast("string"),
                                   F.lit(" is in the future (maximum "), latest.cast("string"),
                                   F.lit(")"))),
    ))


def validate_email(address: Column) -> Column:
    value = F.coalesce(address, F.lit(""))
    return _outcome(_first_error((~value.rlike(EMAIL_PATTERN),
                                  _said(BAD_EMAIL, value))))


def validate_non_empty(value: Column, field: str = "Field") -> Column:
    return _outcome(_first_error(
        (value.isNull(), F.lit(f"{field} must be a string, got null")),
        (strip(value) == "", F.lit(f"{field} cannot be empty")),
    ))


def validate_required_keys(data: Column, required: list[str]) -> Column:
    """Map column against required keys; the missing ones are listed in sorted order."""
    wanted = F.array(*[F.lit(key) for key in required])
    missing = F.array_sort(F.array_except(wanted, F.map_keys(data)))
    return _outcome(_first_error(
        (data.isNull(), F.lit(NOT_A_MAP)),
        (F.size(missing) > 0, F.concat(F.lit(MISSING_KEYS),
                                       F.array_join(missing, ", "))),
    ))
