"""Checking JSON records against a feature spec, all in one narrow projection.

Per field the JSON type is known, so ``1``, ``true``, ``"1"`` and ``[1]`` are told apart.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.functions.scalars import q, trimmed
from riskmill.spec import FeatureSpec

# The messages of rejected records.
NOT_JSON = "Request body must be valid JSON."
NOT_OBJECT = "Request body must be a JSON object."
MISSING = "Missing required field: '{field}'"
INVALID = "Invalid {field}: "
NOT_A_NUMBER = ". Must be a number."
OUT_OF_RANGE = ". Must be between {lo} and {hi}."
NOT_A_FLAG = ". Must be 0 or 1."
NOT_IN_DOMAIN = "'. Must be one of: {allowed}"

NUMBER_TEXT = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
INTEGER_TEXT = r"^\s*([+-]?\d+)\s*$"
OBJECT_TEXT = r"^\s*\{"
INFINITE_TEXT = r"(?i)^\s*([+-]?)inf(?:inity)?\s*$"


@dataclass(frozen=True)
class _Field:
    """Columns that hold what is known about one field: JSON kind, text, number, whole number."""

    name: str

    def _column(self, part: str) -> Column:
        return q(f"__{part}_{self.name}")

    @property
    def value(self) -> Column:
        return self._column("value")

    @property
    def kind(self) -> Column:
        return self._column("kind")

    @property
    def text(self) -> Column:
        return self._column("text")

    @property
    def number(self) -> Column:
        return self._column("number")

    @property
    def integer(self) -> Column:
        return self._column("integer")

    @property
    def missing(self) -> Column:
        """Absent, null or an empty text."""
        return self.kind.isNull() | (self.kind == "VOID") | ((self.kind == "STRING") & (self.text == ""))

    @property
    def shown(self) -> Column:
        """The value as it appears in a message."""
        return (
            F.when(self.kind == "BOOLEAN", F.initcap(self.text))
            .when(self.kind.startswith("DECIMAL"), self.text.try_cast("double").cast("string"))
            .otherwise(self.text)
        )

    @property
    def is_number(self) -> Column:
        return self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")

    def as_number(self) -> Column:
        """The value as a double; NULL when it is not a number."""
        sign = F.regexp_extract(self.text, INFINITE_TEXT, 1)
        from_text = F.when(
            self.text.rlike(INFINITE_TEXT), F.when(sign == "-", float("-inf")).otherwise(float("inf"))
        ).otherwise(F.regexp_extract(self.text, NUMBER_TEXT, 1).try_cast("double"))
        return (
            F.when(self.is_number, self.text.try_cast("double"))
            .when(self.kind == "STRING", from_text)
            .when(self.kind == "BOOLEAN", (self.text == "true").cast("double"))
        )

    def as_integer(self) -> Column:
        """The value as a whole number, fractions cut off; a fraction written as text is none."""
        number = self.text.try_cast("double")
        whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
        return (
            F.when(self.kind == "BIGINT", self.text.try_cast("bigint"))
            .when(self.kind == "STRING", F.regexp_extract(self.text, INTEGER_TEXT, 1).try_cast("bigint"))
            .when(self.kind == "BOOLEAN", (self.text == "true").cast("bigint"))
            .when(self.is_number, F.when(F.abs(number) < 1e18, whole.cast("bigint")))
        )


def form_records(form: DataFrame, spec: FeatureSpec, body: str = "body") -> DataFrame:
    """Records as a form sends them: ``form`` has every feature as text, the result a JSON ``body`` in their place.

    Numbers and flags are trimmed and sent as numbers, or as they were typed where they are none; empty fields are left
    out. Other columns stay.
    """
    def number(c: str, kind: str) -> Column:
        text = trimmed(q(c))
        typed = text.try_cast(kind).cast("string")
        finite = typed.isNotNull() & ~typed.isin("NaN", "Infinity", "-Infinity")
        return F.when(finite, typed).when(text.isNotNull(), F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2))

    parts = [
        F.concat(F.lit(f"{json.dumps(c)}:"), number(c, "bigint" if c in spec.binary else "double")) if c not in spec.categorical
        else F.concat(F.lit(f"{json.dumps(c)}:"), F.expr(f"substring(to_json(array(`{c}`)), 2, length(to_json(array(`{c}`))) - 2)"))
        for c in spec.features
    ]
    filled = [F.when(trimmed(q(c)).isNotNull(), part) for c, part in zip(spec.features, parts, strict=True)]
    kept = [c for c in form.columns if c not in spec.features and c != body]
    return form.select(*[q(c) for c in kept], F.concat(F.lit("{"), F.concat_ws(",", *filled), F.lit("}")).alias(body))


def _read_fields(df: DataFrame, spec: FeatureSpec, body: str) -> tuple[DataFrame, dict]:
    """Parses each record once and each field once, step by step, so that nothing is repeated."""
    fields = {c: _Field(c) for c in spec.features}

    def named(part, make, names=spec.features):
        return [make(fields[c]).alias(f"__{part}_{c}") for c in names]

    record = F.col("__record")
    parsed = df.withColumn("__record", F.try_parse_json(q(body)))
    parsed = parsed.select(
        *[q(c) for c in df.columns],
        (record.isNull() | F.is_variant_null(record)).alias("__no_json"),
        q(body).rlike(OBJECT_TEXT).alias("__object"),
        *named("value", lambda f: F.try_variant_get(record, f'$["{f.name}"]', "variant")),
    )
    parsed = parsed.select(
        "*",
        *named("kind", lambda f: F.schema_of_variant(f.value)),
        *named("text", lambda f: F.try_variant_get(f.value, "$", "string")),
    )
    parsed = parsed.select(
        "*", *named("number", _Field.as_number, spec.numeric), *named("integer", _Field.as_integer, spec.binary)
    )
    return parsed, fields


def _plain(x: float) -> str:
    return f"{x:g}" if x == int(x) else repr(x)


def _about(field: str, shown: Column, problem: str) -> Column:
    return F.concat(F.lit(INVALID.format(field=field)), shown, F.lit(problem))


def _range_text(lo: float, hi: float) -> str:
    return OUT_OF_RANGE.format(lo=_plain(lo), hi=_plain(hi))


def _domain_text(domain) -> str:
    return NOT_IN_DOMAIN.format(allowed=sorted(domain) if domain else "any text")


def _range_error(f: _Field, spec: FeatureSpec) -> Column:
    number = f.number
    error = F.when(number.isNull(), _about(f.name, f.shown, NOT_A_NUMBER))
    if f.name in spec.ranges:
        lo, hi = spec.ranges[f.name]
        error = error.when(~number.between(lo, hi), _about(f.name, f.shown, _range_text(lo, hi)))
    return error


def _flag_error(f: _Field) -> Column:
    good = F.coalesce(f.integer.isin(0, 1), F.lit(False))
    return F.when(~good, _about(f.name, f.shown, NOT_A_FLAG))


def _category_error(f: _Field, spec: FeatureSpec) -> Column:
    domain = spec.domains.get(f.name)
    known = f.text.isin(*domain) if domain else F.lit(True)
    good = F.coalesce((f.kind == "STRING") & known, F.lit(False))
    return F.when(~good, _about(f.name, F.concat(F.lit("'"), f.shown), _domain_text(domain)))


def _present(messages) -> Column:
    if not messages:
        return F.array().cast("array<string>")
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def validate_records(df: DataFrame, spec: FeatureSpec, body: str = "body") -> DataFrame:
    """Adds the typed features and ``errors``, an empty array for a good record.

    Shape comes first, then missing fields alone, then ranges, flags and categories in the spec's
    order. Fields the spec does not name are ignored.
    """
    parsed, fields = _read_fields(df, spec, body)
    missing = _present([
        F.when(fields[c].missing, F.lit(MISSING.format(field=c))) for c in spec.features
    ])
    wrong = _present(
        [_range_error(fields[c], spec) for c in spec.numeric]
        + [_flag_error(fields[c]) for c in spec.binary]
        + [_category_error(fields[c], spec) for c in spec.categorical]
    )
    errors = (
        F.when(F.coalesce(F.col("__no_json"), F.lit(True)), F.array(F.lit(NOT_JSON)))
        .when(~F.col("__object"), F.array(F.lit(NOT_OBJECT)))
        .when(F.size(missing) > 0, missing)
        .otherwise(wrong)
    )
    typed = {c: fields[c].number for c in spec.numeric}
    typed |= {c: fields[c].integer.try_cast("int") for c in spec.binary}
    typed |= {c: F.when(fields[c].kind == "STRING", fields[c].text) for c in spec.categorical}
    return parsed.select(
        *[q(c) for c in df.columns], *[typed[c].alias(c) for c in spec.features], errors.alias("errors")
    )


def validate_rows(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The same checks for a table that already has typed columns."""
    missing = _present([
        F.when(q(c).isNull() | (q(c).cast("string") == ""), F.lit(MISSING.format(field=c)))
        for c in spec.features
    ])
    messages = []
    for c in spec.numeric:
        lo, hi = spec.ranges.get(c, (float("-inf"), float("inf")))
        text = q(c).cast("string")
        error = F.when(F.isnan(q(c).cast("double")), _about(c, text, NOT_A_NUMBER))
        if c in spec.ranges:
            error = error.when(~q(c).between(lo, hi), _about(c, text, _range_text(lo, hi)))
        messages.append(error)
    for c in spec.binary:
        messages.append(F.when(~q(c).isin(0, 1), _about(c, q(c).cast("string"), NOT_A_FLAG)))
    for c in spec.categorical:
        if c in spec.domains:
            messages.append(F.when(
                ~q(c).isin(*spec.domains[c]),
                _about(c, F.concat(F.lit("'"), q(c)), _domain_text(spec.domains[c])),
            ))
    errors = F.when(F.size(missing) > 0, missing).otherwise(_present(messages))
    return df.withColumn("errors", errors)


def unknown_categories(df: DataFrame, domain: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not in a domain table (``column, value``), for domains of any size."""
    known = domain.filter(F.col("column") == column).select(F.col("value").alias(column))
    return df.join(known, column, "left_anti")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the errors column, and the quarantined rest."""
    good = F.size("errors") == 0
    return checked.filter(good).drop("errors"), checked.filter(~good)
