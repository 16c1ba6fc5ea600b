"""Text scalars as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, spelled out: \\s of the regex dialects differs.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Kana, CJK ideographs with extension A, Hangul, compatibility ideographs.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
ALNUM = r"\p{IsAlphabetic}\p{N}"


def estimate_tokens(text: Column) -> Column:
    """Letters by five, digits by three, white space of three and more, and every other character."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (count("[A-Za-z]{1,5}") + count("[0-9]{1,3}") + count(f"[{WS}]{{3,}}") + count(f"[^A-Za-z0-9{WS}]")).cast("long")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"[{WS}]+", " "), "^ | $", "")


TERM = f"[{CJK}]|[{ALNUM}&&[^{CJK}]]+"


def terms(text: Column) -> Column:
    """Lower-cased alphanumeric runs; each CJK character is a term of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_count(text: Column) -> Column:
    """How many terms a text has."""
    return F.regexp_count(F.lower(text), F.lit(TERM))


def term_set(text: Column) -> Column:
    """Distinct lower-cased words without their outer punctuation, sorted."""
    words = F.transform(F.split(collapse(text), " "), lambda w: F.lower(F.regexp_replace(w, f"^[^{ALNUM}]+|[^{ALNUM}]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def round_ratio(value: Column) -> Column:
    return F.round(value, 2)


def canonical_coordinate(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value, 4) + F.lit(0.0))


def snippet_160(text: Column) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > 160, F.concat(F.substring(flat, 1, 157), F.lit("..."))).otherwise(flat)


def yaml_scalar(text: Column) -> Column:
    """One line, as a JSON string where YAML would read it as more than a string."""
    line = F.regexp_replace(text, "[\r\n]", " ")
    risky = line.contains(": ") | line.rlike(r"^[\"'\[{#&*!|>%@`\-?]") | line.endswith(":")
    quoted = F.regexp_extract(F.to_json(F.struct(line.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(risky, quoted).otherwise(line)


def table_cell(text: Column) -> Column:
    """A Markdown table cell: backslash and pipe escaped, on one line."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.trim(F.regexp_replace(escaped, "\r\n|\r|\n", " "))


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def margin_key(text: Column) -> Column:
    """What makes running headers of different pages equal: no white space, digits as '#', ASCII lower case."""
    bare = F.regexp_replace(F.regexp_replace(text, f"[{WS}]", ""), "[0-9]", "#")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def longest_run(text: Column, char: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"\\Q{char}\\E+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def human_size(size: Column) -> Column:
    """A file size in B, KB, MB or GB, one decimal from KB on."""
    scaled = lambda power, unit: F.format_string(f"%.1f {unit}", size / 1024**power)
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, scaled(1, "KB")).when(size < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))
    )


def roman(number: Column) -> Column:
    """Upper-case roman numeral of 1 to 3999; null outside."""
    digit = lambda n, one, five, ten: F.element_at(
        F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (n + 1).cast("int")
    )
    whole = F.concat(
        F.repeat(F.lit("M"), (number / 1000).cast("int")),
        digit(F.floor(number % 1000 / 100), "C", "D", "M"),
        digit(F.floor(number % 100 / 10), "X", "L", "C"),
        digit(number % 10, "I", "V", "X"),
    )
    return F.when((number >= 1) & (number <= 3999), whole)


def alphabetic(number: Column) -> Column:
    """a to z, then aa to zz, aaa and so on: one letter repeated."""
    letter = F.chr((F.lit(97) + (number - 1) % 26).cast("int"))
    return F.when(number >= 1, F.repeat(letter, (F.floor((number - 1) / 26) + 1).cast("int")))


def page_label(style: Column, number: Column, prefix: Column) -> Column:
    """A page label in style D, R, r, A or a; without a style the prefix alone."""
    body = (
        F.when(style == "D", number.cast("string"))
        .when(style == "R", roman(number))
        .when(style == "r", F.lower(roman(number)))
        .when(style == "A", F.upper(alphabetic(number)))
        .when(style == "a", alphabetic(number))
        .otherwise(F.lit(""))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), body)


def clock(ms: Column, hours: Column, fraction: bool = True) -> Column:
    """mm:ss or hh:mm:ss, with milliseconds where they are not zero."""
    digits = lambda n: n.cast("long").cast("string")
    pad = lambda n: F.lpad(digits(n), F.greatest(F.lit(2), F.length(digits(n))), "0")  # noqa: E731 - lpad cuts what is longer
    base = F.when(hours, F.concat_ws(":", pad(F.floor(ms / 3600000)), pad(F.floor(ms / 60000) % 60), pad(F.floor(ms / 1000) % 60))).otherwise(
        F.concat_ws(":", pad(F.floor(ms / 60000)), pad(F.floor(ms / 1000) % 60))
    )
    if not fraction:
        return base
    return F.when(ms % 1000 > 0, F.concat(base, F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))).otherwise(base)


def frame_rate(value: Column) -> Column:
    """'num/den' or a number as frames a second; null where the denominator is zero."""
    parts = F.split(value, "/")
    num, den = F.try_to_number(parts[0], F.lit("999999999")), F.coalesce(F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999")), F.lit(1))
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over the shorter one; 0 where that is empty."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / shorter).otherwise(F.lit(0.0))


def luhn(digits: Column) -> Column:
    """The check digit holds and not all digits are zero."""
    return F.call_function("luhn_check", digits) & digits.rlike("[1-9]")


def strip_tracking(url: Column) -> Column:
    """A URL without utm_*, fbclid and gclid parameters; an empty query goes with its mark."""
    parts = F.split(url, "#", 2)
    halves = F.split(parts[0], r"\?", 2)
    kept = F.filter(F.split(F.get(halves, F.lit(1)), "&"), lambda p: ~p.rlike("^(utm_[^=]*|fbclid|gclid)(=|$)") & (p != ""))
    base = F.when(F.size(halves) < 2, halves[0]).when(F.size(kept) > 0, F.concat(halves[0], F.lit("?"), F.array_join(kept, "&"))).otherwise(halves[0])
    return F.when(F.size(parts) > 1, F.concat(base, F.lit("#"), F.get(parts, F.lit(1)))).otherwise(base)


def severity_score(severity: Column) -> Column:
    return F.when(severity == "high", 40).when(severity == "medium", 20).otherwise(8)


def risk_band(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 25, "medium").otherwise("low")


def percent_decode(value: Column) -> Column:
    """Percent escapes as UTF-8; a value that does not decode stays as it is, and '+' is no space."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def is_private_ipv4(ip: Column) -> Column:
    """Whether an IPv4 address is outside the global unicast ranges."""
    o = [F.get(F.split(ip, r"\."), F.lit(k)).cast("int") for k in range(4)]
    return (
        o[0].isin(0, 10, 127)
        | (o[0] >= 224)
        | ((o[0] == 100) & o[1].between(64, 127))
        | ((o[0] == 169) & (o[1] == 254))
        | ((o[0] == 172) & o[1].between(16, 31))
        | ((o[0] == 192) & (o[1] == 168))
        | ((o[0] == 192) & (o[1] == 0) & o[2].isin(0, 2))
        | ((o[0] == 198) & o[1].isin(18, 19))
        | ((o[0] == 198) & (o[1] == 51) & (o[2] == 100))
        | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113))
    )


def visible_characters(markdown: Column) -> Column:
    """Alphanumeric characters outside lines that are comments."""
    return F.regexp_count(F.regexp_replace(markdown, r"(?m)^\s*<!--.*-->\s*$", ""), F.lit(f"[{ALNUM}]"))


def markdown_url(url: Column) -> Column:
    """In angle brackets where white space or unbalanced parentheses would end it."""
    unbalanced = F.regexp_count(url, F.lit(r"\(")) != F.regexp_count(url, F.lit(r"\)"))
    return F.when(url.contains(" ") | unbalanced, F.concat(F.lit("<"), F.replace(url, F.lit(">"), F.lit("%3E")), F.lit(">"))).otherwise(url)


def critic_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\{(?:\+\+|--|~~|==|>>)|(?:\+\+|--|~~|==|<<)\}|~>)", r"\\$1")


def truncate_utf16(text: Column, units: int) -> Column:
    """struct<text, truncated>: as much of the text as fits so many UTF-16 units; a pair of surrogates is not split."""
    raw = F.encode(text, "UTF-16BE")
    head = F.substring(raw, 1, 2 * units)
    split_pair = F.hex(F.substring(head, -2, 1)).between("D8", "DB")
    kept = F.when(split_pair, F.substring(raw, 1, 2 * units - 2)).otherwise(head)
    long = F.octet_length(raw) > 2 * units
    return F.struct(F.when(long, F.decode(kept, "UTF-16BE")).otherwise(text).alias("text"), long.alias("truncated"))


def bracket_safe(text: Column) -> Column:
    """Square brackets get a backslash unless they are balanced."""
    marks = F.split(F.regexp_replace(text, r"[^\[\]]", ""), "")
    step = lambda c: F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
    walked = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), lambda a, c: F.struct((a["depth"] + step(c)).alias("depth"), F.least(a["low"], a["depth"] + step(c)).alias("low")))
    balanced = (walked["depth"] == 0) & (walked["low"] == 0)
    return F.when(balanced, text).otherwise(F.regexp_replace(text, r"([\[\]])", r"\\$1"))


def join_path(folder: Column, href: Column) -> Column:
    """A reference seen from a folder as one path: '.' and empty parts go, '..' takes the part before with it; one that starts with '/' is seen from the root."""
    parts = F.split(F.when(href.startswith("/"), href).otherwise(F.concat(folder, F.lit("/"), href)), "/")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
