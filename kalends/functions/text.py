"""Text expressions. White space is Unicode's: `(?U)` makes the JVM's classes agree with Python's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A line with one of these says who may take part.
TARGET_WORDS = ("대상", "연령", "유아", "어린이", "초등", "중학생", "고등학생", "청소년", "성인", "가족", "보호자")
#: A section heading with one of these opens a section on who may take part.
TARGET_HEADINGS = ("대상", "참여 기준", "참가 기준")
#: The mark of a section heading, and the marks that may stand before it.
SECTION, BULLETS = "■", "▷●○-*※★ "
#: What pages of a queue, a block or a refusal contain, in any case.
BLOCK_MARKERS = (
    "tracer waiting", "접속 대기 중", "접속대기 중", "현재 접속자가 많아", "요청이 차단되었습니다", "서비스 이용이 제한", "access denied",
)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space other than line feeds become a space; ends are trimmed; an empty text is null."""
    return F.nullif(trimmed(F.regexp_replace(c, r"(?U)[^\S\n]+", " ")), F.lit(""))


def unique_lines(c: Column) -> Column:
    """Lines in first-seen order, white space collapsed, blanks and repeats left out; null if none is left."""
    lines = F.transform(F.split(c, "\n"), lambda x: trimmed(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.nullif(F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n"), F.lit(""))


def label_values(lines: Column, mark: str = ":") -> Column:
    """A map from "label: value" strings, cut at the first mark; blanks are skipped and the last of a label wins."""
    cut = F.transform(lines, lambda x: F.split(x, mark, 2))
    fine = F.filter(cut, lambda x: (F.size(x) == 2) & (trimmed(F.get(x, F.lit(0))) != "") & (trimmed(F.get(x, F.lit(1))) != ""))
    pairs = F.transform(fine, lambda x: F.struct(trimmed(F.get(x, F.lit(0))).alias("k"), trimmed(F.get(x, F.lit(1))).alias("v")))

    sorted_ = F.sort_array(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))

    def lasts(x: Column) -> Column:
        """After sorting by label and place the last of a label is the one that another label, or nothing, follows."""
        after = F.arrays_zip(x.alias("x"), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))).alias("after"))
        kept = F.filter(after, lambda z: z["x"].isNotNull() & ~F.coalesce(z["x"]["k"] == z["after"]["k"], F.lit(False)))
        return F.map_from_entries(F.transform(kept, lambda z: F.struct(z["x"]["k"].alias("k"), z["x"]["v"].alias("v"))))

    # The sorted array is the argument of one lambda, so it is computed once however often it is used.
    return F.get(F.transform(F.array(sorted_), lasts), F.lit(0))


def issue(phase: Column, identifier: Column, message: Column) -> Column:
    """One line on what went wrong where."""
    return F.concat(phase, F.lit(" "), identifier, F.lit(": "), message)


def plain_integer(c: Column) -> Column:
    """The whole trimmed string as an integer if it is digits, else null."""
    return F.when(trimmed(c).rlike(r"^\d+$"), trimmed(c).try_cast("int"))


def free_value(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?U)\s+", "")
    return F.when(bare == "무료", True).when(bare == "유료", False)


def target_summary(c: Column) -> Column:
    return F.nullif(trimmed(F.regexp_replace(c, r"(?U)\s*만 나이 기준\s*$", "")), F.lit(""))


def target_lines(c: Column, words: tuple[str, ...] = TARGET_WORDS, headings: tuple[str, ...] = TARGET_HEADINGS, section: str = SECTION, bullets: str = BULLETS) -> Column:
    """The sections of a description on who may take part, and other lines that say so; repeats left out; null if none.

    Headings cut the lines into sections, each kept whole or line by line, so no line leaves its row and none is copied again
    for each that follows.
    """

    def has(line: Column, any_of: tuple[str, ...]) -> Column:
        return line.rlike("|".join(any_of))

    def heading(line: Column) -> Column:
        return (F.ltrim(line, F.lit(bullets)) if bullets else line).startswith(section)

    def kept(part: Column) -> Column:
        lines = F.split(part, "\n")
        first = F.get(lines, F.lit(0))
        open_ = heading(first) & has(first, headings)
        return F.when(open_, lines).otherwise(F.filter(lines, lambda x: ~heading(x) & has(x, words)))

    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), trimmed), lambda x: x != "")
    # \x1E ends a line above, so it is free to mark where a section begins.
    marked = F.transform(lines, lambda x: F.when(heading(x), F.concat(F.lit("\x1e"), x)).otherwise(x))
    sections = F.split(F.array_join(marked, "\n"), "\n?\x1e")
    return unique_lines(F.array_join(F.flatten(F.transform(sections, kept)), "\n"))


def is_block_page(body: Column, markers: tuple[str, ...] = BLOCK_MARKERS) -> Column:
    low = F.lower(body)
    found = F.lit(False)
    for m in markers:
        found = found | low.contains(m)
    return F.coalesce(found, F.lit(False))
