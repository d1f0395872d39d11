"""Column functions on text. Everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters that trimming removes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
# The same characters as the inside of a regular-expression class (Java and RE2 both read it).
SPACE_CLASS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
FENCE = "```"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``fn``.

    A lambda variable holds the evaluated value, so an expensive expression such as a
    split is not evaluated again for every array element that refers to it.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def split_lines(col: Column) -> Column:
    return F.split(F.replace(col, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def sha(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def fragment_key(*cols: Column) -> Column:
    """Deterministic id from its parts, so that a rerun writes the same ids."""
    return sha(F.concat_ws("\0", *[c.cast("string") for c in cols]))


def terms(col: Column) -> Column:
    """Distinct letter/digit runs and the rune bigrams inside them, lower case.

    The bigrams come from one overlapping regex pass, which is linear in the text even for
    unbroken runs (unlike a substring per position).
    """
    return let(
        F.lower(col),
        lambda t: F.array_distinct(
            F.concat(
                F.regexp_extract_all(t, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)),
                F.regexp_extract_all(t, F.lit(r"(?=([\p{L}\p{Nd}]{2}))"), F.lit(1)),
            )
        ),
    )


def words(col: Column) -> Column:
    """Lower-case letter/digit runs in order, with repeats."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def norm(col: Column) -> Column:
    """Drop white space and backslashes: the form in which anchors are compared."""
    return F.regexp_replace(col, "[" + SPACE_CLASS + r"\x{1C}-\x{1F}\\]+", "")


# The patterns removed from text before it is embedded.
_IMAGE = r"!\[([^\]]*)\]\([^)\n]*\)"
_LINK = r"\[([^\]]+)\]\([^)\n]*\)"
_URL = r"https?://[^\s)>]+"
_HEADING = r"(?dm)^\s*#{1,6}\s*"
_LIST = r"(?dm)^\s*(?:[-+]\s+|[0-9]+[.)]\s+)"
_MARKS = r"[|`*_~<>]"
_TITLED_IMAGE = r"!\[([^\]]*)\]\([^\s)]+(?:\s+(?:\"(.*?)\"|'(.*?)'))?\)"


def clean_text(col: Column, keep_lines: bool = False) -> Column:
    """Markdown without its marks (T18): images as a label with their alt text, links as their
    label. ``keep_lines`` keeps line ends and adds image titles to the label."""
    if keep_lines:
        c = F.regexp_replace(col, _TITLED_IMAGE, " 图片 $1 $2$3 ")
    else:
        c = F.regexp_replace(col, _IMAGE, " 图片 $1 ")
    for pattern, to in ((_LINK, " $1 "), (_URL, " "), (_HEADING, ""), (_LIST, ""), (_MARKS, " ")):
        c = F.regexp_replace(c, pattern, to)
    if keep_lines:
        ls = F.transform(F.split(c, "\n", -1), lambda x: strip(F.regexp_replace(x, "[ \\t]+", " ")))
        return F.array_join(F.filter(ls, lambda x: x != ""), "\n")
    return strip(F.regexp_replace(c, "[" + SPACE_CLASS + "]+", " "))


def cut_bytes(col: Column, max_bytes: int) -> Column:
    """Cut one string into pieces of at most ``max_bytes`` UTF-8 bytes, never inside a rune.

    The fold only carries byte positions; text is sliced once at the end.
    """
    short = F.octet_length(col) <= max_bytes

    def continuation(b: Column, pos: Column) -> Column:
        h = F.hex(F.substring(b, pos + 1, F.lit(1)))
        return (h >= "80") & (h < "C0")

    def pieces(b: Column) -> Column:
        def step(acc: Column, _i: Column) -> Column:
            last = F.element_at(acc, -1)
            cut = F.lit(max_bytes - 3)
            for back in (2, 1, 0):
                at = last + (max_bytes - back)
                cut = F.when(~continuation(b, at), max_bytes - back).otherwise(cut)
            return F.when(F.octet_length(b) - last <= max_bytes, acc).otherwise(F.concat(acc, F.array(last + cut)))

        starts = F.aggregate(
            F.sequence(F.lit(1), (F.octet_length(b) / (max_bytes - 3)).cast("int") + 1), F.array(F.lit(0)), step
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda p, i: F.decode(
                    F.substring(
                        b, p + 1, F.coalesce(F.get(s, i + 1), F.octet_length(b)) - p
                    ),
                    "UTF-8",
                ),
            ),
        )

    return F.when(short, F.array(col)).otherwise(let(F.encode(col, "UTF-8"), pieces))


def canonical_json(col: Column) -> Column:
    """A map as JSON text with sorted keys, so that maps can be compared and joined."""
    return F.to_json(F.array_sort(F.map_entries(col)))
