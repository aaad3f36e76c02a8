"""Fixed values of the printed forms: columns, labels, stems, codes and names."""

from __future__ import annotations

# The six tables' columns, by (label, width, upright) or (group, [(label, width, upright), ...]).
COLUMNS = {
    "journal_left": [
        ("№ проходок (проб)", 5, True),
        ("Глубина, м", [("скважины", 5, True), ("обсадки трубами", 5, True)]),
        ("Литологический разрез", 5, True),
        ("ОПИСАНИЕ РАЗРЕЗА", 36, False),
        ("Отметка о таликах, мерзлоте и водоносности", 6, True),
        ("Категория породы", 6, True),
        ("Объём извлечённой породы, см³", 8, True),
    ],
    "sampling_right": [
        ("Объём породы теоретический, см³", 8, True),
        ("Диаметр скважины по манометру", 6, True),
        ("Результат опробования, мг", [("визуально", 5, True), ("лаборатория, вес", 5, True)]),
        ("Вес металла, получен. от дополнит. промывки", 6, True),
        ("Вес металла, привяз. к подсчёту", 6, True),
        ("Процент", [("каменистости", 5, True), ("ледянистости", 5, True)]),
        ("Среднее содержание по промывке", 6, True),
        ("Содержание металла на куб. м с учётом приборности", 8, True),
    ],
    "samorodki": [
        ("№ проходок (проб)", 6, True),
        ("Количество и вес самородков", 16, False),
        ("Размер в трёх измерениях", 12, False),
        ("Окатанность, включая налёты, схематическая зарисовка и др.", 24, False),
    ],
    "podschet": [
        ("Наименование показателей", 28, False),
        ("Лимитность", [("единица измерения", 10, False), ("на пласт.", 9, False), ("на массу", 9, False)]),
        ("Подсчёт произвёл", 18, False),
    ],
    "pokazateli": [("ПОКАЗАТЕЛИ", 34, False), ("На пласт.", 10, False), ("На выем. мощ", 10, False), ("На массу", 10, False)],
    "kontrol": [("Дата контроля", 14, False), ("Что контролируется", 28, False), ("Вес металла", 12, False)],
}
KINDS = tuple(COLUMNS)
FORMS = ("form_journal", "form_act")
# Shares of the width; tables without them go by their columns' widths.
FRACTIONS = {
    "journal_left": (0.049, 0.076, 0.082, 0.081, 0.401, 0.107, 0.089, 0.115),
    "sampling_right": (0.10, 0.10, 0.10, 0.10, 0.10, 0.10, 0.10, 0.12, 0.11, 0.07),
    "podschet": (0.37, 0.06, 0.095, 0.075, 0.40),
}
GRAPH_NUMBERS = {"journal_left": (1, 2, 3, 4, 5, 6, 7, 8), "sampling_right": (9, 10, 11, 12, 13, 14, 15, 16, 17, 18)}
HEADER_ROWS = {"journal_left": 2, "sampling_right": 2, "samorodki": 1, "podschet": 2, "pokazateli": 1, "kontrol": 1}
# Printed row labels and their units.
ROW_LABELS = {
    "podschet": ("Глубина выемки", "Мощность торфов", "Мощность песков", "Среднее содержание", "Вертикальный запас"),
    "pokazateli": ("Общий вес металла по скважине, мг", "Вес металла введенного в подсчёт, мг", "Площадь скважин для теорет. объема, кв. см", "Средний коэффициент по объему"),
}
UNITS = {"podschet": ("м", "-ll-", "-ll-", "мг-м куб.", "мг-м куб.")}
FILL_COLUMNS = {"podschet": (2, 3), "pokazateli": (1, 2, 3)}
TITLES = {"podschet": "Пробность золота: содержание олова проц."}  # in the first cell, over the column's label
SIGNATURE_COLUMN = {"podschet": 5}
WORD_PLACEMENT = ("podschet",)
# Words that tell the tables apart.
KEYWORDS = {
    "journal_left": ("описание", "проходок", "глубина", "разрез"),
    "sampling_right": ("опроб", "теоретич", "процент", "содержание"),
    "samorodki": ("самородк", "окатан", "размер"),
    "podschet": ("подсч", "наименование показател", "пласт"),
    "pokazateli": ("показател", "на пласт", "на массу"),
    "kontrol": ("контрол", "что контролир", "вес металла"),
}
# Stems of printed words in headers, footers and elsewhere.
HEADER_STEMS = (
    "описан", "разрез", "глубин", "проход", "категор", "объ", "породы",
    "отметк", "литолог", "обсадк", "скважин", "диаметр", "теорет", "опроб",
    "процент", "содержан", "каменист", "ледянист", "манометр", "визуальн",
    "лаборатор", "промывк", "мерзлот", "водонос", "показател", "измерен",
)
FOOTER_STEMS = ("буров", "мастер", "техник", "геолог", "начальник", "подпис", "роспис")
JUNK_STEMS = (*HEADER_STEMS, *FOOTER_STEMS,
    "лимитн", "знаютн", "пробност", "олов", "проц", "поняет", "произвел", "фамил",
    "отряд", "участ", "сообщ", "лаборат", "результ", "должност", "дата", "новосиб",
    "весной", "вмечает", "молодост", "верональн", "сотермичн", "химическ", "ангел",
    "выборигор", "маркшейд", "главн", "старш",
)
# Readings of the four codes, in Latin and Cyrillic letters.
CODE_MAP = {
    "nc": "пс", "nс": "пс", "пс": "пс", "nэ": "пс", "nз": "пс", "ne": "пс", "пc": "пс",
    "h3": "нз", "нз": "нз", "нэ": "нз", "n3": "нз",
    "cл": "сл", "сл": "сл", "ca": "сл", "сa": "сл", "cа": "сл", "cл.": "сл",
    "6/o": "б/о", "б/о": "б/о", "6/о": "б/о", "b/o": "б/о", "6о": "б/о",
}
# Characters of repeat marks besides white space, and the further marks that scoring knows. All but ASCII stand by
# their numbers, as ranges, look-alikes and quotes can't be told apart or would end SQL text; both regular expression engines read these.
DITTO_CHARACTERS = r"\-\x{2010}-\x{2015}_l\x{456}/\\\x{AB}\x{BB}\x{22}\x{27}\x{2019}\x{201C}\x{201D}\x{B7}."
SCORED_DITTO = ("-ll-", ">>", "—''—", "—«—")
# Secrets in logs, and what stands for them.
SECRET_PATTERNS = (
    (r"(?i)(Api-Key\s+)([A-Za-z0-9._\-]+)", "$1***"),
    (r"(AQVN[A-Za-z0-9._\-]{10,})", "***"),
    (r"(sk-or-[A-Za-z0-9._\-]{10,})", "***"),
)
# The two forms' fields.
JOURNAL_FIELDS = (
    "Отряд", "Участок", "Операция", "1. Драгир / линия", "2. Линия №", "3. Азимут бурения линии", "4. Скважина №",
    "5. Ствол (наклонный/вертикальный)", "6. Отметка устья скважины", "7. Глубина скважины", "8. Характер коренных пород",
    "9. Пройдено в талом грунте (от–до)", "10. Пройдено в мерзлоте", "11. Скважина забурена / заброшена",
    "12. Уровень воды и его появление", "13. Дебит воды", "14. Диаметр обсадных труб",
    "15. Диаметр скважины (начальный/по пласту)", "16. Категория грунтов",
)
ACT_FIELDS = ("Скважина №", "Глубина, м", "Заключение акта (текст)", "Начальник участка, отряда", "Геолог", "Буровой мастер", "Дата")
FORM_FIELDS = {"form_journal": JOURNAL_FIELDS, "form_act": ACT_FIELDS}
FORM_TITLES = {"form_journal": "Титульный лист «ЖУРНАЛ»", "form_act": "АКТ на завершённую скважину"}
FORM_HEADER = ("Поле", "Значение", "Источник")
RAW_FIELD = "(сырой текст)"  # the one field of a form that the text engine alone has read
HINT_FIELD = "OCR: Скважина № (подсказка)"
# sheets' names, and truth's names of the tables.
SHEET_NAMES = {
    "journal_left": "гр1-8", "sampling_right": "гр9-18", "podschet": "подсчёт", "pokazateli": "показатели",
    "kontrol": "контроль", "samorodki": "самородки", "form_journal": "титул", "form_act": "акт",
}
TRUTH_KINDS = {"гр1-8": "journal_left", "гр9-18": "sampling_right", "самородки": "samorodki", "подсчёт": "podschet", "показатели": "pokazateli", "контроль": "kontrol"}
# Columns that a form prints itself, and confidences.
FIXED_COLUMNS = {"podschet": (0, 1), "pokazateli": (0,), "kontrol": (0,), "samorodki": (0,)}
AGREE_CONF, DISAGREE_CONF, UNREAD_CONF, LOW_CONF = 0.95, 0.45, 0.5, 0.55


def leaves(kind: str) -> list[tuple[str, str | None, int]]:
    """(label, group, width) of each column."""
    out: list[tuple[str, str | None, int]] = []
    for c in COLUMNS[kind]:
        out += [(sub, c[0], w) for sub, w, _ in c[1]] if isinstance(c[1], list) else [(c[0], None, c[1])]
    return out


def column_rows() -> list[tuple[str, int, str, str | None, int, float]]:
    """(kind, ci, label, group, width, frac) of each column of each table."""
    out = []
    for kind in KINDS:
        widths = [w for _, _, w in leaves(kind)]
        fractions = FRACTIONS.get(kind) or [w / float(sum(widths)) for w in widths]
        out += [(kind, i, label, group, w, float(f)) for i, ((label, group, w), f) in enumerate(zip(leaves(kind), fractions))]
    return out
