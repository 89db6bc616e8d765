"""Literals in columns: canonical numbers and JSON, and N-Quads text."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadloom.model import terms as T

_ECHAR = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


_double = T.canonical_double


@F.pandas_udf(StringType())
def _canonical_double(values: pd.Series) -> pd.Series:
    known: dict[float, str] = {v: _double(float(v)) for v in (values.dropna() + 0.0).unique()}  # -0.0 + 0.0 is 0.0: zeros of either sign are one key
    out = values.map(known).astype(object).where(values.notna(), None)  # also if all are null, which pandas maps to floats
    return out.where((values != 0) | ~np.signbit(values), _double(-0.0))


def canonical_double(x: Column) -> Column:
    """The canonical xsd:double text: exact to 16 digits, which the JVM's formatting is not."""
    number = x.cast("double")
    return F.when(F.isnan(number), _double(float("nan"))).otherwise(_canonical_double(number))  # pandas takes NaN for null


@F.pandas_udf(StringType())
def _number_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None or v != v else T.number_text(v))


def number_text(x: Column) -> Column:
    """The ECMAScript text of a number."""
    return _number_text(x.cast("double"))


@F.pandas_udf(StringType())
def _canonical_json(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else T.canonical_json(json.loads(v)))


def canonical_json(text: Column) -> Column:
    """RFC 8785 text of JSON text."""
    return _canonical_json(text)


def escaped(text: Column) -> Column:
    """A literal's text in canonical N-Quads."""
    out = text
    for char, code in _ECHAR.items():
        out = F.replace(out, F.lit(char), F.lit(code))
    rest = out
    for n in [*range(32), 127]:
        if chr(n) not in _ECHAR:
            rest = F.replace(rest, F.lit(chr(n)), F.lit(f"\\u{n:04X}"))
    return F.when(out.rlike("[\\x00-\\x1f\\x7f]"), rest).otherwise(out)


def literal_text(value: Column, datatype: Column, language: Column) -> Column:
    tail = F.when(language.isNotNull(), F.concat(F.lit("@"), language)).when(datatype.isNull() | (datatype == T.XSD_STRING), "").otherwise(F.concat(F.lit("^^<"), datatype, F.lit(">")))
    return F.concat(F.lit('"'), escaped(value), F.lit('"'), tail)


def _resource(name: Column) -> Column:
    return F.when(name.startswith("_:"), name).otherwise(F.concat(F.lit("<"), name, F.lit(">")))


def quad_text() -> Column:
    """The N-Quads line, without its line end, of a row of a quad table."""
    o = F.when(F.col("kind") == "literal", literal_text(F.col("object"), F.col("datatype"), F.col("language"))).otherwise(_resource(F.col("object")))
    graph = F.when(F.coalesce(F.col("graph"), F.lit("")) == "", F.lit(" .")).otherwise(F.concat(F.lit(" "), _resource(F.col("graph")), F.lit(" .")))
    return F.concat(_resource(F.col("subject")), F.lit(" "), _resource(F.col("predicate")), F.lit(" "), o, graph)
