"""Coded findings: arrays of small structs with the absent members left out."""


def text(value):
    return f"'{value}'"


def finding(condition, code, value=None, **extra):
    """A struct of the extra texts, the code and a number, or NULL unless the condition holds.

    `code` is a plain word, or SQL text if it contains a bracket.
    """
    name = code if "(" in code else text(code)
    parts = [f"'{k}', {text(v)}" for k, v in extra.items()]
    parts += [f"'code', {name}", f"'value', CAST({value or 'NULL'} AS DOUBLE)"]
    return f"IF({condition}, named_struct({', '.join(parts)}), NULL)"


def collect_findings(*findings):
    return f"array_compact(array({', '.join(findings)}))"


def code_list(*pairs):
    """Codes whose condition is true, in order; pairs are (condition, code)."""
    return collect_findings(*[f"IF({condition}, {text(code)}, NULL)" for condition, code in pairs])


def text_array(values):
    return f"CAST(array({', '.join(text(v) for v in values)}) AS ARRAY<STRING>)"


def explode_findings(df, column, keep=("report_date",)):
    """Long form of a finding array: one row per finding.

    The outer form keeps Spark from repeating the whole array expression in a filter on
    its size; the placeholder rows of empty arrays go out by their missing code.
    """
    return df.selectExpr(*keep, f"inline_outer({column})").where("code IS NOT NULL")
