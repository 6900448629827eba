"""Text repair as one column expression: entities, mojibake, typography."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions.rows import let

ENTITY = r"^([A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
# Named entities of one character whose name ends in a semicolon, from the
# standard library's table.
NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and len(v) == 1}

# What the Windows-1252 code page puts at 0x80-0x9F.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
C1 = "".join(chr(c) for c in range(0x80, 0xA0))

_NEXT = "\u0080-\u00bf" + CP1252.translate({c: None for c in range(0x80, 0xA0)})
# Groups that read like one UTF-8 character. Three of them need a Latin-1
# character beside the first, or the first of general punctuation: an accented
# letter before two quotation marks is no such group.
MISREAD = (
    f"(?:[\u00c2-\u00df][{_NEXT}]|\u00e2[{_NEXT}]{{2}}"
    f"|[\u00e0-\u00ef](?:[\u0080-\u00bf][{_NEXT}]|[{_NEXT}][\u0080-\u00bf])"
    f"|[\u00f0-\u00f4][{_NEXT}]{{3}})+"
)

# Curly quotes and their plain forms; Latin ligatures.
CURLY, PLAIN = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u00b4", "''''\"\"\"\"'"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

TERMINAL_ESCAPE = "\x1b\\[[0-9;]*[mK]"
LINE_BREAK = r"\r\n|[\r\u0085\u2028\u2029]"
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]"


# Most texts hold nothing but these and some letters.
COMMON = r"[ -~\t\n]+"
# What repair may change in a text beside entities: line breaks, control
# characters, quotes, ligatures and full width, as few ranges, and misread runs.
IRREGULAR = (
    r"[\x00-\x08\x0b\x0d-\x1f\x7f\u0085\u00b4\u2018-\u201f\u2028\u2029\u206a-\u206f\u3000"
    r"\ufb00-\ufb06\ufeff\uff01-\uff5e\ufff9-\ufffc]|" + MISREAD
)

# Text that holds none of these is already in composed form.
NEEDS_COMPOSING = r"[\p{M}\u0340\u0341\u0374\u037e\u0387\u1100-\u11ff\u1f71-\u1ffd\u2000\u2001\u2126\u212a\u212b\u2329\u232a\uf900-\ufaff]"


def _char_of(digits: Column, base: int) -> Column:
    """Character of a numeric code; NULL when there is none."""
    point = F.conv(digits, base, 10).cast("long")
    valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    utf32 = F.unhex(F.lpad(F.hex(F.when(valid, point)), 8, "0"))
    return F.decode(utf32, "UTF-32")


def unescape_html(text: Column) -> Column:
    """Decode entities that end in a semicolon; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])

    def decode_head(part: Column) -> Column:
        def replaced(name: Column) -> Column:
            char = (
                F.when(name.rlike("^#[0-9]"), _char_of(F.substring(name, 2, 7), 10))
                .when(name.rlike("^#[xX]"), _char_of(F.substring(name, 3, 6), 16))
                .when(name != "", F.try_element_at(names, name))
            )
            return F.coalesce(
                F.concat(char, F.regexp_replace(part, ENTITY, "")), F.concat(F.lit("&"), part)
            )

        return let(F.regexp_extract(part, ENTITY, 1), replaced)

    parts = F.split(text, "&")
    joined = F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(decode_head(p))), ""
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def fix_encoding(text: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1 or Windows-1252, run by run.

    A run is a row of character groups that look like the bytes of one UTF-8
    character each. It is read again as UTF-8; what isn't valid stays, and so
    does all text outside runs, whatever script it is in.
    """

    def reread(run: Column) -> Column:
        encoded = F.encode(F.translate(run, CP1252, C1), "ISO-8859-1")
        return F.coalesce(F.try_validate_utf8(encoded.cast("string")), run)

    def rebuilt(t: Column) -> Column:
        # one piece more than there are runs
        pieces = F.split(t, MISREAD)
        return let(
            F.regexp_extract_all(t, F.lit(MISREAD), F.lit(0)),
            lambda runs: F.array_join(
                F.transform(
                    pieces,
                    lambda p, i: F.concat(p, F.when(i < F.size(runs), reread(F.get(runs, i))).otherwise("")),
                ),
                "",
            ),
        )

    return F.when(text.rlike(MISREAD), rebuilt(text)).otherwise(text)


def _uncommon(text: Column) -> Column:
    """The text with each run of common characters as one blank: much shorter to
    search, and what stands side by side still does."""
    return F.regexp_replace(text, COMMON, " ")


def compose(text: Column) -> Column:
    """Canonical composition. Only rows that need it leave the JVM."""

    @F.arrow_udf("string")
    def nfc(texts: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()],
            pa.string(),
        )

    return F.coalesce(nfc(F.when(_uncommon(text).rlike(NEEDS_COMPOSING), text)), text)


def plain_typography(text: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return F.translate(text, FULL_WIDTH + CURLY, HALF_WIDTH + PLAIN)


def repair_text(text: Column, unescape: bool | None = None) -> Column:
    """Repair but for composition, which ``repaired`` adds. Entities are decoded unless the text looks like
    markup; ``unescape`` True or False decides it outright."""

    def entities(t: Column) -> Column:
        if unescape is None:
            return F.when(F.contains(t, F.lit("<")), t).otherwise(unescape_html(t))
        return unescape_html(t) if unescape else t

    steps = [
        lambda t: F.regexp_replace(t, TERMINAL_ESCAPE, ""),
        fix_encoding,
        plain_typography,
        lambda t: F.regexp_replace(F.regexp_replace(t, LINE_BREAK, "\n"), CONTROL, ""),
    ]

    def mended(t: Column) -> Column:
        for step in steps:
            t = let(t, step)
        return t

    # Each step reads its input more than once, hence the binding.
    return let(
        let(text, entities), lambda t: F.when(_uncommon(t).rlike(IRREGULAR), mended(t)).otherwise(t)
    )


def repaired(df: DataFrame, columns: Sequence[str], unescape: bool | None = None) -> DataFrame:
    """``df`` with the columns repaired and in composed form.

    The two are projections of their own: composing reads a repaired column, it
    does not repair again.
    """
    mended = df.withColumns({c: repair_text(F.col(c), unescape) for c in columns})
    return mended.withColumns({c: compose(F.col(c)) for c in columns})
