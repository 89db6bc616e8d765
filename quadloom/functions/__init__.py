"""Column functions."""

from quadloom.functions.iris import dot_segments_removed, is_absolute, iri_parts, relativized, resolved
from quadloom.functions.literals import canonical_double, canonical_json, escaped, literal_text, number_text, quad_text

__all__ = [
    "canonical_double", "canonical_json", "dot_segments_removed", "escaped", "iri_parts", "is_absolute", "literal_text", "number_text", "quad_text", "relativized", "resolved",
]
