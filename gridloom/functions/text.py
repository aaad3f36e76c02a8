"""Text rules as native column functions.

Spaces, digits and letters are Unicode-aware. White space takes in the separators 1C to 1F, and digits the superscripts and
subscripts, as in the text model whose results these functions give. Every function is null-safe
as its text says and stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.plans import specs

SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
DITTO = "^[" + SPACE[1:-1] + specs.DITTO_CHARACTERS + "]{1,6}$"


def literal(v) -> str:
    """A value, or a list of values, as SQL text."""
    if isinstance(v, (list, tuple)):
        return f"array({', '.join(map(literal, v))})"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v) + "D" * isinstance(v, float)


def literal_map(values: dict) -> Column:
    """A map of fixed values as one expression: made of literals one by one, it would take the driver longer to say than to look up."""
    return F.expr(f"map({', '.join(literal(x) for kv in values.items() for x in kv)})")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_cell(c: Column) -> Column:
    """White space as single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def is_ditto(c: Column) -> Column:
    """A repeat mark: 1 to 6 characters, all of them marks; null and blank are not."""
    return F.coalesce(strip(c).rlike(DITTO), F.lit(False))


def is_ditto_loose(c: Column) -> Column:
    """Has a dash and at most two letters or digits."""
    t = F.coalesce(strip(c), F.lit(""))
    return t.rlike("[-—–_]") & (F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) <= 2)


def norm(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]", "")


def agree(a: Column, b: Column) -> Column:
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def norm_code(c: Column) -> Column:
    """The repaired code, or the text as it was."""
    t = F.regexp_replace(F.lower(strip(c)), "[ _]", "")
    t = F.regexp_replace(t, "^[.—–-]+|[.—–-]+$", "")
    return F.coalesce(F.try_element_at(literal_map(specs.CODE_MAP), t), c)


def is_junk(c: Column) -> Column:
    """Blank, or at least four letters and a printed stem."""
    t = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("ё"), F.lit("е"))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (t == "") | ((letters >= 4) & t.rlike("|".join(specs.JUNK_STEMS)))


def has_stem(c: Column, stems: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(stems))


def looks_key(c: Column, col: Column) -> Column:
    """A row's key: a number in column 0, a short text with a digit in column 1."""
    t = strip(c)
    first = F.regexp_replace(F.substring(t, 1, 2), r"^[().]+|[().]+$", "")
    return F.when(col == 0, first.rlike(f"^{DIGIT}+$")).when(col == 1, t.rlike(DIGIT) & (F.length(t) <= 6)).otherwise(F.lit(False))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^" + DIGIT[1:-1] + "]", "")


def first_number(c: Column) -> Column:
    """The first number with its fraction, else empty."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\p{Nd}+[.,]?\p{Nd}*", 0)


def strict(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def fuzzy(c: Column) -> Column:
    """For scoring: case, ё, marks of repetition, decimal signs and gaps in numbers don't count."""
    t = F.replace(F.lower(strict(c)), F.lit("ё"), F.lit("е"))
    ditto = t.rlike(DITTO) | t.isin(*specs.SCORED_DITTO)
    out = F.replace(F.regexp_replace(t, f"{SPACE}+", " "), F.lit(","), F.lit("."))
    return F.when(ditto, F.lit("<ditto>")).otherwise(F.regexp_replace(out, r"(?<=\p{Nd}) +(?=\p{Nd})", ""))


def mask_secrets(c: Column) -> Column:
    for pattern, to in specs.SECRET_PATTERNS:
        c = F.regexp_replace(c, pattern, to)
    return c


def reply_json(c: Column) -> Column:
    """The JSON object in a model's reply: without code fences, else from the first brace to the last; null if neither parses."""
    t = strip(F.regexp_replace(strip(F.regexp_replace(strip(c), "^```(?:json)?", "")), "```$", ""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    # Trailing text is an error only inside brackets, and one kind of bracket could be closed by the text itself.
    parses = lambda x: (F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}"))).isNotNull()
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(parses(t), t).when((inner != "") & parses(inner), inner)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def similar(a: Column, b: Column) -> Column:
    """The same first six letters and digits, of which there are some."""
    x, y = F.substring(norm(a), 1, 6), F.substring(norm(b), 1, 6)
    return (x != "") & (x == y)


def like_header(first: Column) -> Column:
    """Whether a row with this first cell looks like a header: neither blank nor a number."""
    t = strict(first)
    return (t != "") & ~t.rlike(f"^{DIGIT}+$")
