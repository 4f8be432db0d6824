"""Text folding, cleaning and tests, as built-in column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tavola.config import CITIES, LEGAL_SUFFIXES, SECTION_TITLES, STOP_WORDS


def filled(value: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(value, F.lit(""))


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[filled(F.col(v) if isinstance(v, str) else v) for v in values])


@lru_cache(1)
def _latin_folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Latin letters with marks and their base letters; those that fold to several letters apart."""
    one, base, several = [], [], []
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07))):
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(folded) == 1 and folded != c:
            one.append(c)
            base.append(folded)
        elif folded != c and folded:
            several.append((c, folded))
    return "".join(one), "".join(base), tuple(several)


def fold(text: Column) -> Column:
    """Decompose Latin letters for compatibility and drop their marks.  Other scripts keep their letters."""
    one, base, several = _latin_folds()
    out = F.translate(text, one, base)
    for c, folded in several:
        out = F.replace(out, F.lit(c), F.lit(folded))
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(out, r"\p{M}", ""))


def ascii_fold(text: Column) -> Column:
    """fold(), and then only ASCII."""
    return F.regexp_replace(fold(text), r"[^\x00-\x7F]", "")


def words(text: Column) -> Column:
    """White-space-separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without(tokens: Column, drop: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*drop))


def base_name(name: Column) -> Column:
    """Folded, lower-cased, without one legal suffix at the end and without punctuation."""
    tokens = words(F.lower(fold(F.coalesce(name, F.lit("")))))
    last = F.try_element_at(tokens, F.lit(-1))
    kept = F.when(last.isin(*LEGAL_SUFFIXES), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"[^\p{L}\p{N}\s]", ""))


def drop_stop_words(name: Column) -> Column:
    return F.array_join(without(words(name), STOP_WORDS), " ")


def clean_name(name: Column) -> Column:
    """base_name() without stop words; if none is left, base_name()."""
    base = base_name(name)
    return F.coalesce(filled(drop_stop_words(base)), base)


def normalize_item(name: Column) -> Column:
    """ASCII words of an item's name, without a leading number."""
    out = ascii_fold(F.lower(name))
    out = F.regexp_replace(out, r"^\d+[\s.\-)]*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", " "), r"\s+", " "))


def detect_city(address: Column, cities: tuple[str, ...] = CITIES) -> Column:
    """The first known city, in list order, that an address names as a whole word; else ``unknown``."""
    low = F.lower(F.coalesce(address, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(rf"(?U)\b{c.lower()}\b"), F.lit(c)) for c in cities], F.lit("unknown"))


def item_text(name: Column, description: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))


def item_words(text: Column, strip: str = ".,!?()[]{}'\"") -> Column:
    """Distinct lower-case words with punctuation stripped from their ends."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.btrim(w, F.lit(strip))))


def is_section_header(line: Column) -> Column:
    """A known section title, or a short upper-case line without a price."""
    from tavola.functions.prices import MENU_PRICE

    stripped = F.trim(line)
    shouted = (F.upper(stripped) == stripped) & (F.lower(stripped) != stripped)
    return stripped.rlike(rf"(?iu)^(?:{'|'.join(SECTION_TITLES)})$") | (shouted & (F.length(stripped) < 30) & ~stripped.rlike(MENU_PRICE))


# Opening hours, delivery and tax notes at the foot of a menu.
FOOTER = r"(?iu)pedido\s*m[níi]*nimo|horario|tel[eé]fono|abierto|domingo|s[bá]bado|viernes|lunes|martes|mi[eé]rcoles|reparto|recoger|€\s*\d+[,.]\d{2}\s*(iva|tva|vat)"
# Web addresses, prices run into letters, and letters that no word has in a row.
WEB, MANGLED_PRICE = r"(?i)www\.|\.com|\.es\b", r"^\d+[,.]\d*[a-zA-Z]"
CONSONANTS = r"[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{4,}"
#: Share limits of the garbage test.
MAX_DIGITS, MAX_SYMBOLS, MIN_LETTERS = 0.60, 0.40, 0.20


def is_garbage(text: Column) -> Column:
    """Whether a line read from an image is noise rather than an item; spaces count as symbols."""
    n = F.length(text)
    digits, letters = F.regexp_count(text, F.lit(r"\p{Nd}")), F.regexp_count(text, F.lit(r"\p{L}"))
    share = lambda x: x / n
    tokens = words(text)
    squeezed = F.replace(text, F.lit(" "), F.lit(""))
    kinds = F.size(F.array_distinct(F.filter(F.split(F.lower(squeezed), ""), lambda c: c != "")))
    after_price = F.trim(F.regexp_extract(text, r"\d+\s*€(.*)$", 1))
    # Any rule will do, so those that are cheap or often hold come first and those over words and letters last.
    rules = [
        text.rlike(CONSONANTS),
        text.rlike(MANGLED_PRICE),
        text.rlike(WEB),
        text.rlike(FOOTER),
        share(digits) > MAX_DIGITS,
        share(n - digits - letters) > MAX_SYMBOLS,
        (letters > 0) & (share(letters) < MIN_LETTERS),
        (letters == 0) & (F.regexp_replace(text, "[ .,]", "") != ""),
        (n > 3) & (n < 6) & (digits > 0) & (letters > 0) & ~text.rlike(r"\s"),
        F.contains(text, F.lit("€")) & (share(digits) > 0.3) & (letters < 3),
        text.rlike(r"\d+\s*€") & (after_price != "") & (F.length(after_price) < 12) & (share(letters) < 0.65),
        (n > 6) & (share(letters) < 0.5) & (kinds <= 3),
        (F.size(tokens) >= 2) & (F.size(F.array_distinct(tokens)) == 1),
        (F.size(tokens) >= 3) & (F.size(F.array_distinct(tokens)) < F.size(tokens)),
        F.exists(tokens, lambda w: w.rlike(r"^(.)\1{2,}$")),
    ]
    bad = rules[0]
    for rule in rules[1:]:
        bad = bad | rule
    return F.when(text.isNull() | (n < 3), F.lit(True)).otherwise(bad)
