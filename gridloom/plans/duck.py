"""The text rules once more, as SQL for the oracle."""

from __future__ import annotations

from gridloom.plans import specs

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
MARK = "^[" + WS[1:-1] + specs.DITTO_CHARACTERS + "]{1,6}$"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def strict(x: str) -> str:
    return strip(f"coalesce({x}, '')")


def ditto(x: str) -> str:
    return f"coalesce(regexp_matches({strip(x)}, {q(MARK)}), false)"


def loose(x: str) -> str:
    t = strict(x)
    return f"(regexp_matches({t}, '[-—–_]') AND length(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 2)"


def norm(x: str) -> str:
    return f"regexp_replace(replace(lower(coalesce({x}, '')), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def agree(a: str, b: str) -> str:
    x, y = norm(a), norm(b)
    return f"({x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x})))"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WS + '+')}, ' ', 'g'))"


def code(x: str) -> str:
    t = f"regexp_replace(regexp_replace(lower({strip(x)}), '[ _]', '', 'g'), '^[.—–-]+|[.—–-]+$', '', 'g')"
    return f"(CASE {t} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in specs.CODE_MAP.items()) + f" ELSE {x} END)"


def stem(x: str, stems: tuple[str, ...]) -> str:
    return f"regexp_matches({x}, {q('|'.join(stems))})"


def junk(x: str) -> str:
    t = f"replace(lower({strict(x)}), 'ё', 'е')"
    return f"({t} = '' OR (length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) >= 4 AND {stem(t, specs.JUNK_STEMS)}))"


def key(x: str, col: str) -> str:
    t = strip(x)
    first = f"regexp_replace(substring({t}, 1, 2), '^[().]+|[().]+$', '', 'g')"
    return f"(CASE {col} WHEN 0 THEN regexp_matches({first}, '^[{DIGIT}]+$') WHEN 1 THEN regexp_matches({t}, '[{DIGIT}]') AND length({t}) <= 6 ELSE false END)"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^{DIGIT}]', '', 'g')"


def number(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '\\p{{Nd}}+[.,]?\\p{{Nd}}*', 0)"


def fuzzy(x: str) -> str:
    t = f"replace(lower({strict(x)}), 'ё', 'е')"
    out = f"replace(regexp_replace({t}, {q(WS + '+')}, ' ', 'g'), ',', '.')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(\\p{{Nd}}) +(\\p{{Nd}})', '\\1\\2', 'g')"
    marks = ", ".join(map(q, specs.SCORED_DITTO))
    return f"(CASE WHEN regexp_matches({t}, {q(MARK)}) OR {t} IN ({marks}) THEN '<ditto>' ELSE {out} END)"


def secrets(x: str) -> str:
    for pattern, to in specs.SECRET_PATTERNS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(to.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS {names}"
