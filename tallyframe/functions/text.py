"""Text primitives: Unicode strip, accent folding, header slugs."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes, derived from the rule itself.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

_HANGUL = range(0xAC00, 0xD7A4)


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often it is used.

    Catalyst does not share a subexpression across conditional branches, so a
    costly input named in several of them would run several times per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Unicode-aware strip; ``trim`` alone would only remove spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def _decompose(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


@lru_cache(maxsize=None)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """(source, target) for one-to-one folds, and the few one-to-many folds.

    Built from the Unicode database. Characters that fold to nothing stand at
    the end of ``source``, which ``translate`` deletes. Hangul syllables are
    left composed.
    """
    source, target, removed, wide = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if code in _HANGUL or 0xD800 <= code < 0xE000:
            continue
        folded = _decompose(ch)
        if folded == ch:
            continue
        if not folded:
            removed.append(ch)
        elif len(folded) == 1:
            source.append(ch)
            target.append(folded)
        else:
            wide[ch] = folded
    return "".join(source + removed), "".join(target), wide


def _char_class(chars, coarse: bool = False) -> str:
    """A regexp class of code-point ranges.

    ``coarse`` closes the gaps above the Latin blocks: a handful of ranges that
    is quick to test and can only err towards matching.
    """
    codes = sorted(map(ord, chars))
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        latin = code < 0x250 or 0x1E00 <= code <= 0x1F00 or ranges[-1][1] < 0x1F00 < code
        if code == ranges[-1][1] + 1 or (coarse and not latin):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def fold_accents(c: Column, d_stroke: bool = True) -> Column:
    """Compatibility-decompose and drop combining marks (``Điểm`` -> ``Diem``).

    ASCII text takes a short cut; the map for the rare one-to-many characters
    (ligatures, fractions) is consulted only for rows that hold one.
    """
    source, target, wide = _fold_tables()
    if d_stroke:
        source, target = "đĐ" + source, "dD" + target
    maybe_wide, is_wide = _char_class(wide, coarse=True), _char_class(wide)

    def fold(text: Column) -> Column:
        pairs = F.create_map(*[F.lit(x) for kv in wide.items() for x in kv])
        spelled = F.array_join(F.transform(
            F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)), "")
        expanded = F.when(text.rlike(maybe_wide) & text.rlike(is_wide), spelled).otherwise(text)
        return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(expanded, source, target)).otherwise(text)
    return let(c, fold)


def slug(c: Column) -> Column:
    """Value-level twin of :func:`slug_name`."""
    lowered = fold_accents(F.lower(strip(c)))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def slug_name(name: str | None) -> str:
    """ASCII snake case of one header."""
    text = (name or "").replace("\ufeff", "").strip().lower()
    text = _decompose(text).replace("đ", "d")
    return re.sub("[^a-z0-9]+", "_", text).strip("_")


def unique_slugs(names) -> list[str]:
    """One slug per position; repeats get the next free numeric suffix."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = candidate = slug_name(name)
        n = 1
        while candidate in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken.add(candidate)
        out.append(candidate)
    return out


def python_repr(c: Column) -> Column:
    """How Python prints a string literal (quotes chosen, controls escaped)."""
    def quoted(text: Column) -> Column:
        body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            body = F.replace(body, F.lit(raw), F.lit(shown))
        return F.when(text.contains("'") & ~text.contains('"'),
                      F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return let(c, quoted)
