"""Functions that Spark cannot express, as Arrow-batched UDFs."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.formulas import omml as office_math
from lectern.formulas.mtef import Decoder, Truncated
from lectern.formulas.render import Latex, MathML, spaced, validated
from lectern.sources.compound import equation_bytes

WARNING = "struct<type: string, message: string, position: long, hex: string, extra: map<string, string>>"
DECODED = f"mathml string, latex string, warnings array<{WARNING}>, error string"


@functools.lru_cache(maxsize=20_000)
def decoded(data: bytes) -> tuple[str | None, str | None, tuple, str | None]:
    """MathML, LaTeX, warnings, error of an equation object; equal objects are decoded once."""
    try:
        body, warnings = equation_bytes(data)
        decoder = Decoder(body)
        _, nodes = decoder.decode()
    except (ValueError, IndexError, Truncated, RecursionError) as broken:
        return None, None, (), str(broken)
    warnings += decoder.warnings
    mathml = MathML(warnings).document(nodes)
    return mathml, Latex(warnings).document(nodes), tuple(warnings), None


def decode_equation(data: Column) -> Column:
    """``struct<mathml, latex, warnings, error>`` of a binary equation, in its compound file or without."""

    @F.pandas_udf(DECODED)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [decoded(bytes(v)) if v is not None else (None, None, None, None) for v in values]
        return pd.DataFrame([(m, x, None if w is None else list(w), e) for m, x, w, e in rows], columns=["mathml", "latex", "warnings", "error"])

    return run(data)


def validate_latex(latex: Column) -> Column:
    """``struct<valid, errors>``."""

    @F.pandas_udf("valid boolean, errors array<string>")
    def run(values: pd.Series) -> pd.DataFrame:
        found = [validated(v) for v in values]
        return pd.DataFrame({"valid": [not e for e in found], "errors": found})

    return run(latex)


def latex_spacing(latex: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(spaced, na_action="ignore")

    return run(latex)


def omml(xml: Column, display: bool = False) -> Column:
    """``struct<latex, mathml, error>`` of a fragment of office markup."""

    @F.pandas_udf("latex string, mathml string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                el = None if v is None else office_math.parse(v)
                rows.append((None, None, None) if el is None else (office_math.to_latex(el, display), office_math.to_mathml(el, display), None))
            except (ValueError, SyntaxError) as broken:
                rows.append((None, None, str(broken)))
        return pd.DataFrame(rows, columns=["latex", "mathml", "error"])

    return run(xml)
