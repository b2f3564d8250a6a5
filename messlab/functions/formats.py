"""strftime directives as Spark datetime patterns."""

from __future__ import annotations

# Strftime directive -> Spark datetime pattern.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "j": "DDD",
}


def spark_pattern(strftime: str) -> str:
    """Translate ``%Y-%m-%d`` style text; anything but a directive is quoted."""
    out, literal = [], ""
    chars = iter(strftime)
    for ch in chars:
        directive = next(chars, "%") if ch == "%" else None
        if directive in DIRECTIVES:
            out.append(_quoted(literal) + DIRECTIVES[directive])
            literal = ""
        else:
            literal += ch if directive is None else "%" if directive == "%" else ch + directive
    return "".join(out) + _quoted(literal)


# Strftime directive -> text of the time {t}, whatever the session zone.
PARTS = {
    "Y": "lpad(year({t}), 4, '0')", "y": "lpad(year({t}) % 100, 2, '0')", "m": "lpad(month({t}), 2, '0')",
    "d": "lpad(day({t}), 2, '0')", "j": "lpad(dayofyear({t}), 3, '0')",
    "H": "lpad(hour({t}), 2, '0')", "I": "lpad((hour({t}) + 11) % 12 + 1, 2, '0')",
    "M": "lpad(minute({t}), 2, '0')", "S": "lpad(second({t}), 2, '0')",
    "f": "lpad(CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT) % 1000000, 6, '0')",
    "p": "if(hour({t}) < 12, 'AM', 'PM')",
    "b": "left(date_format(make_date(2001, month({t}), 1), 'MMMM'), 3)",
    "B": "date_format(make_date(2001, month({t}), 1), 'MMMM')",
    "a": "date_format(make_date(2001, 1, 1 + weekday({t})), 'EEE')",
    "A": "date_format(make_date(2001, 1, 1 + weekday({t})), 'EEEE')",
}
DAY = "%Y-%m-%d"


def text_sql(value: str, strftime: str, *, is_date: bool = False) -> str:
    """SQL of the text of a time; a TIMESTAMP_NTZ or DATE never passes the session zone."""
    value = f"CAST({value} AS TIMESTAMP_NTZ)" if is_date else value
    parts, literal, rest = [], "", strftime
    while rest:
        if rest.startswith(DAY):
            known, rest = f"CAST(CAST({value} AS DATE) AS STRING)", rest[len(DAY):]
        elif rest[0] == "%" and rest[1:2] in PARTS and rest[1:2]:
            known, rest = PARTS[rest[1]].format(t=value), rest[2:]
        else:
            taken = 2 if rest[0] == "%" else 1
            literal += "%" if rest[:2] in ("%", "%%") else rest[1:2] if taken == 2 else rest[0]
            rest = rest[taken:]
            continue
        parts += [_literal(literal)] * bool(literal) + [known]
        literal = ""
    parts += [_literal(literal)] * bool(literal or not parts)
    # A null time has no text, even where the pattern holds no directive.
    return f"if({value} IS NULL, NULL, concat({', '.join(parts)}))"


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _quoted(text: str) -> str:
    if not any(c.isalpha() or c in "'[]{}#" for c in text):
        return text
    return "'" + text.replace("'", "''") + "'"
