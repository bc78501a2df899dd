"""Names, selectors and text as Column expressions: channel grammar, filters, natural order, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import srgb_to_linear

#: Blanks that are trimmed and split at.
BLANK = r"[ \t\n\r\f\x0B]"


# layer.sub.Tail, split at the last dot.


def layer_of(name: Column) -> Column:
    """The prefix up to and with the last dot; empty for the root layer."""
    return F.regexp_extract(name, r"^((?s:.*)\.)?[^.]*$", 1)


def tail_of(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def is_alpha(name: Column) -> Column:
    return F.lower(tail_of(name)) == "a"


def join_if_not_empty(first: Column, second: Column, dot: str = ".") -> Column:
    return F.when(first == "", second).when(second == "", first).otherwise(F.concat(first, F.lit(dot), second))


def in_layer(name: Column, layer: str) -> Column:
    """Starts with the layer, and no dot follows."""
    return name.startswith(layer) & (F.instr(F.substring(name, len(layer) + 1, 1 << 30), ".") == 0)


# Filters.


def regex_match(text: Column, pattern: str) -> Column:
    """A search whatever the case; nothing matches an invalid pattern, everything an empty one."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return text.rlike(f"(?i){pattern}") if pattern else F.lit(True)


def fuzzy_match_id(text: Column, pattern: str) -> Column:
    """Number of the first word of the filter that the text holds, or null. Words are apart by commas or blanks.

    Case does not count only if every byte of the filter is a lower-case letter. A filter that begins with ^ or
    ends with $ is a regular expression.
    """
    if not pattern:
        return F.lit(0)
    if pattern.startswith("^") or pattern.endswith("$"):
        return F.when(regex_match(text, pattern), F.lit(0))
    subject = F.lower(text) if re.fullmatch("[a-z]+", pattern) else text
    found: Column = F.lit(None).cast("int")
    for k, word in reversed(list(enumerate(w for w in re.split("[, ]", pattern) if w))):
        found = F.when(F.contains(subject, F.lit(word)), F.lit(k)).otherwise(found)
    return found


def fuzzy_match(text: Column, pattern: str) -> Column:
    return fuzzy_match_id(text, pattern).isNotNull()


def matches(text: Column, pattern: str, use_regex: bool) -> Column:
    return regex_match(text, pattern) if use_regex else fuzzy_match(text, pattern)


def split_filter(pattern: str) -> tuple[str, str]:
    """image:group at the last colon; without one the group's filter is empty."""
    head, colon, tail = pattern.rpartition(":")
    return (head, tail) if colon else (pattern, "")


# Natural order.


def natural_key(name: Column) -> Column:
    """Sorts like names whose digit runs count as numbers and whose letters have no case."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"0*([0-9]+)", "00000000000000000000$1"), r"0*([0-9]{20})(?![0-9])", "$1")


# Text.


def split_any(text: Column, delimiters: str) -> Column:
    """At any of the delimiters, with empty parts."""
    return F.split(text, "[" + re.escape(delimiters) + "]", -1)


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def parse_number(text: Column) -> Column:
    """Null unless the whole text is a number."""
    return trim_blanks(text).try_cast("double")


def short_name(path: Column) -> Column:
    """After the last slash or backslash, before the last colon."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r":[^:]*$", "")


def split_selector(path: Column) -> tuple[Column, Column]:
    """path:selector at the last colon, unless that is a drive letter's before a slash."""
    pattern = r"^((?s:.+)):([^:]*)$"
    plain = path.rlike(r"^[A-Za-z]:[/\\][^:]*$") | ~path.rlike(":")
    return F.when(plain, path).otherwise(F.regexp_extract(path, pattern, 1)), F.when(plain, F.lit("")).otherwise(F.regexp_extract(path, pattern, 2))


def fill_template(template: str, path: Column, index: Column) -> Column:
    """{file}, {dir}, {ext} with its dot, {idx} and {idx:0Nd}; anything else in braces is an error."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    values = {
        "file": F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""),
        "dir": F.regexp_replace(F.regexp_extract(path, r"^((?s:.*)/)?[^/]*$", 1), r"(?<=.)/$", ""),
        "ext": F.regexp_extract(file, r".(\.[^.]*)$", 1),
        "idx": index.cast("string"),
    }
    parts: list[Column] = []
    for text, key in re.findall(r"([^{]+)|\{([^{}]*)\}", template):
        if text:
            parts.append(F.lit(text))
        elif key in values:
            parts.append(values[key])
        elif m := re.fullmatch(r"idx:0?(\d*)d?", key):
            parts.append(F.lpad(index.cast("string"), int(m[1] or 1), "0"))
        else:
            raise ValueError(f"unknown placeholder {{{key}}}")
    return F.concat(*parts)


def pixel_text(v: Column) -> Column:
    """Two hexadecimal digits of the 8-bit value."""
    held = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.lpad(F.hex(F.floor(held * 255 + 0.5).cast("long")), 2, "0")


def statistic_text(v: Column) -> Column:
    """Scientific if not 0 and below 0.01 or from 1000 in size, else three decimals."""
    size = F.abs(v)
    return F.when((v != 0) & ((size < 0.01) | (size >= 1000)), F.format_string("%.2e", v)).otherwise(F.format_string("%.3f", v))


def parse_color(text: str) -> tuple[float, float, float, float]:
    """#RGB, #RGBA, #RRGGBB or #RRGGBBAA in sRGB with linear alpha, or three or four linear numbers apart by commas."""
    text = text.strip()
    if not text:
        return 0.0, 0.0, 0.0, 0.0
    if text.startswith("#"):
        digits = text[1:]
        if len(digits) not in (3, 4, 6, 8) or not re.fullmatch("[0-9a-fA-F]+", digits):
            raise ValueError(f"not a colour: {text}")
        pairs = [d * 2 for d in digits] if len(digits) < 6 else re.findall("..", digits)
        values = [int(p, 16) / 255 for p in pairs]
        linear = [v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in values[:3]]
        return (*linear, values[3] if len(values) == 4 else 1.0)
    numbers = [float(x) for x in text.split(",")]
    if len(numbers) not in (3, 4):
        raise ValueError(f"not a colour: {text}")
    return (*numbers, 1.0)[:4]


def color_values(text: Column) -> Column:
    """array<double> of four of each text that parse_color() takes; null for any other."""
    plain = F.trim(text)
    digits = F.substring(plain, 2, 8)
    short = F.length(digits) < 5
    part = lambda k: F.when(short, F.repeat(F.substring(digits, k + 1, 1), 2)).otherwise(F.substring(digits, 2 * k + 1, 2))
    level = lambda k: F.conv(part(k), 16, 10).cast("double") / 255
    opaque = F.length(digits).isin(3, 6)
    hexadecimal = F.array(*[srgb_to_linear(level(k)) for k in range(3)], F.when(opaque, 1.0).otherwise(level(3)))
    numbers = F.transform(F.split(plain, ","), lambda p: parse_number(p))
    listed = F.when(F.size(numbers).isin(3, 4) & ~F.exists(numbers, lambda v: v.isNull()), F.slice(F.concat(numbers, F.array(F.lit(1.0))), 1, 4))
    marked = plain.rlike("^#([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")
    return F.when(plain == "", F.array(*[F.lit(0.0)] * 4)).when(marked, hexadecimal).when(~F.startswith(plain, F.lit("#")), listed)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Code points that two texts begin with alike."""
    n = F.least(F.length(a), F.length(b))
    same = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))).otherwise(F.array().cast("array<boolean>"))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")
