"""Whether records in JSON have the shape of a profile: which fields hold a wrong type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a record and their types; a question mark allows null.
RECORD = {
    "cv_id": "text", "raw_text": "text", "language": "text", "name": "text", "email": "text", "phone": "text", "label": "text", "total_score": "whole",
    "skills": ["text"], "achievements": ["text"], "leadership": ["text"],
    "education": [{"degree": "text", "institution": "text", "field": "text", "year": "whole?", "gpa": "number?"}],
    "experience": [{"title": "text", "company": "text", "start": "text?", "end": "text?", "duration_months": "whole", "description": "text"}],
    "projects": [{"name": "text", "tools": ["text"], "description": "text", "link": "text?"}],
    "certifications": [{"name": "text", "issuer": "text", "year": "whole?"}],
    "languages": [{"language": "text", "proficiency": "text?"}],
    "criteria_scores": [{"name": "text", "score": "whole", "max_points": "whole", "weight": "number", "method": "text", "rationale": "text", "overridden_by": "text?"}],
}
_LIST = "array<variant>"


def _fits(value: Column, kind: str) -> Column:
    """Whether a value has a type; numbers may also stand as text, and a missing value fits."""
    held = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    void = F.lit(kind.endswith("?")) & (held == "VOID")
    if kind.startswith("text"):
        fits = held == "STRING"
    else:
        whole = number == F.floor(number) if kind.startswith("whole") else F.lit(True)
        fits = ~held.startswith("ARRAY") & ~held.startswith("OBJECT") & number.isNotNull() & whole
    return value.isNull() | void | F.coalesce(fits, F.lit(False))


def _errors(value: Column, kind, at: Column) -> Column:
    """Paths of what does not fit below a value, in order."""
    none = F.array().cast("array<string>")
    if isinstance(kind, str):
        return F.when(_fits(value, kind), none).otherwise(F.array(at))
    held = F.schema_of_variant(value)
    if isinstance(kind, list):
        inner = F.transform(F.try_variant_get(value, "$", _LIST), lambda x, i: _errors(x, kind[0], F.concat(at, F.lit("."), i.cast("string"))))
        return F.when(value.isNull(), none).when(held.startswith("ARRAY"), F.flatten(inner)).otherwise(F.array(at))
    parts = [_errors(F.try_variant_get(value, f"$.{name}", "variant"), inner, F.concat(at, F.lit(f".{name}"))) for name, inner in kind.items()]
    return F.when(value.isNull(), none).when(held.startswith("OBJECT"), F.concat(*parts)).otherwise(F.array(at))


def errors(record: Column) -> Column:
    """Paths of the fields of a JSON record that hold a wrong type (``experience.0.title``); empty for a valid one.

    A text that is no JSON object, or null, has the one error ``invalid JSON``.
    """
    value = F.try_parse_json(record)
    fields = [_errors(F.try_variant_get(value, f"$.{name}", "variant"), kind, F.lit(name)) for name, kind in RECORD.items()]
    return F.when(F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.concat(*fields)).otherwise(F.array(F.lit("invalid JSON")))
