"""Text functions over columns; all run inside the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence's end, with a quote or bracket after it or none: fixed values. In running text colons do not end one.
SENTENCE_END = r"""[.!?。！？]["'”’)]?$"""
CLAUSE_END = r"""[.!?。！？:：;；]["'”’)]?$"""
#: A list item's start: fixed value.
BULLET = r"^(?:[-•▪◦‣]|\d+[.)])\s*"
#: A label of capitals: fixed value.
CAPITALS = r"^[A-Z][A-Z0-9 /&+.-]*$"
#: Signs that identify a part of a page, and those that are stripped from them: fixed values.
IDENTIFIER = r"(?:https?://|www\.)\S+|[A-Za-z]*\d[\w./:%+-]*|[A-Z]{2,}"
OUTER = ".,;:()[]{}"


@functools.cache
def _compatible() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Signs with another compatibility form, by rule: those of one sign (from, to), and ligatures and dots of several."""
    signs = [chr(i) for i in range(0xA0, 0xFFFF) if not 0xD800 <= i < 0xE000]
    forms = [(c, unicodedata.normalize("NFKC", c)) for c in signs]
    one = [(c, f) for c, f in forms if len(f) == 1 and f != c]
    return "".join(c for c, _ in one), "".join(f for _, f in one), tuple((c, f) for c, f in forms if len(f) > 1 and f.isascii() and (0xFB00 <= ord(c) <= 0xFB06 or c in "‥…"))


def compatible(c: Column) -> Column:
    """Full-width signs, ligatures, odd blanks and the like in their plain forms (as NFKC has them, but for signs that it
    composes from several or takes apart otherwise). Plain ASCII texts are left alone at once."""
    before, after, several = _compatible()
    own = F.translate(c, before, after)
    for sign, form in several:
        own = F.replace(own, F.lit(sign), F.lit(form))
    return F.when(c.rlike(r"[^\x00-\x7f]"), own).otherwise(c)


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Compatible forms, soft hyphens dropped, runs of blanks and tabs made one blank, ends stripped. Line breaks stay.

    Only what is no single blank already is matched and replaced."""
    return strip(F.regexp_replace(F.replace(compatible(c), F.lit("\xad"), F.lit("")), r"[\t\r\f\x0B][ \t\r\f\x0B]*| [ \t\r\f\x0B]+", " "))


def word_count(c: Column) -> Column:
    own = strip(c)
    return F.when(own == "", 0).otherwise(F.size(F.split(own, r"(?U)\s+")))


def casefold(c: Column) -> Column:
    return F.lower(F.upper(c))


def safe_stem(c: Column) -> Column:
    """A file name's stem: in compatible forms, other signs than word characters, CJK, dot and hyphen become underscores; 80
    signs at most."""
    own = F.regexp_replace(F.regexp_replace(compatible(c), r"(?U)[^\w一-鿿.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.left(F.when(own == "", "document").otherwise(own), F.lit(80))


def size_label(c: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB, to the base 1024, with one decimal from KB on."""
    out = F.format_string("%.1f TB", F.bround(c / float(1 << 40), 1))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(c < (1 << (power + 10)), F.format_string(f"%.1f {unit}", F.bround(c / float(1 << power), 1))).otherwise(out)
    return F.when(c < 1024, F.concat(c.cast("bigint").cast("string"), F.lit(" B"))).otherwise(out)


def row_key(c: Column) -> Column:
    """The canonical form of a key: digits filled up to eight (an R may stand before up to eight), or P0001-S000001."""
    own = strip(c)
    page, order = (F.regexp_extract(own, r"(?i)^P(\d{1,8})-S(\d{1,10})$", i) for i in (1, 2))
    plain, marked = F.regexp_extract(own, r"^(\d+)$", 1), F.regexp_extract(own, r"(?i)^R?(\d{1,8})$", 1)
    fill = lambda x, n: F.when(F.length(x) < n, F.lpad(x, n, "0")).otherwise(x)
    paragraph = F.concat(F.lit("P"), fill(page.try_cast("bigint").cast("string"), 4), F.lit("-S"), fill(order.try_cast("bigint").cast("string"), 6))
    return F.when(page != "", paragraph).when(plain != "", fill(plain, 8)).when(marked != "", fill(marked, 8))


def numbers(c: Column) -> Column:
    """The sorted multiset of numbers, decimal commas as points."""
    return F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def cjk_ratio(c: Column) -> Column:
    """Share of CJK signs (U+3400 to U+9FFF) among letters; 0 without letters."""
    n = letters(c)
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(c, F.lit("[㐀-鿿]")) / n)


def visual_length(c: Column) -> Column:
    """Width in ems: CJK 1, blanks .25, other letters and digits of any script .55, the rest .45."""
    cjk, blank, plain = (F.regexp_count(c, F.lit(p)) for p in ("[㐀-鿿]", r"(?U)\s", r"[\p{L}\p{N}&&[^㐀-鿿]]"))
    return cjk * 1.0 + blank * 0.25 + plain * 0.55 + (F.length(c) - cjk - blank - plain) * 0.45


def identifiers(c: Column) -> Column:
    """Distinct URLs, tokens with a digit and runs of capitals, without outer punctuation, in lower case."""
    found = F.regexp_extract_all(c, F.lit(f"({IDENTIFIER})"), 1)
    bare = F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x != "")))


def translatable(c: Column) -> Column:
    """Has a Latin letter and is not just up to six capitals."""
    return c.rlike("[A-Za-z]") & ~F.trim(c).rlike("^[A-Z]{1,6}$")


def looks_like_heading(c: Column) -> Column:
    """Three letters or more, 90 signs at most, nine tenths of the letters capitals."""
    n = letters(c)
    return (n >= 3) & (F.length(c) <= 90) & (F.regexp_count(c, F.lit(r"\p{Lu}")) >= n * 0.9)


def similar_size(one: Column, two: Column) -> Column:
    """Font sizes that differ by at most max(1.5, 22 % of the larger)."""
    return F.abs(one - two) <= F.greatest(F.lit(1.5), F.greatest(one, two, F.lit(1.0)) * 0.22)


def traits(c: Column, squeezed: bool = False) -> dict[str, Column]:
    """What is asked of a text when it may go on with another one; it may be squeezed already."""
    own = c if squeezed else squeeze(c)
    label = (F.length(own) <= 30) & (word_count(own) <= 5) & own.rlike(CAPITALS)
    return {"some": own != "", "small": own.rlike(r"^\p{Ll}"), "hyphen": own.endswith("-"), "label": label, "long": F.length(own) >= 8, "sentence": own.rlike(SENTENCE_END), "clause": own.rlike(CLAUSE_END), "item": own.rlike(BULLET)}


def marks(c: Column) -> Column:
    """The traits of a squeezed text as bits of one number, which travels in the text's place; none of them without a text."""
    return functools.reduce(Column.__add__, [F.coalesce(t, F.lit(False)).cast("int") * (1 << i) for i, t in enumerate(traits(c, squeezed=True).values())])


def marked(m: Column) -> dict[str, Column]:
    """The traits that marks hold."""
    return {k: m.bitwiseAND(1 << i) != 0 for i, k in enumerate(traits(F.lit("")))}


def follows(before: dict[str, Column], after: dict[str, Column], size_before: Column | None = None, size_after: Column | None = None) -> Column:
    """A text goes on with the next one, by the traits of both: no label of capitals before it, eight signs or more in both
    (unless a word is broken by a hyphen), and a small letter follows or no sentence ends. Sizes, where given, must be
    similar."""
    broken = before["hyphen"] & after["small"]
    fit = before["some"] & after["some"] & ~before["label"] & (broken | (before["long"] & after["long"]))
    sized = F.lit(True) if size_before is None else similar_size(size_before, size_after)
    return sized & fit & (after["small"] | ~before["sentence"])


def continues(before: Column, after: Column, size_before: Column | None = None, size_after: Column | None = None, squeezed: bool = False) -> Column:
    """`follows` of two texts, which may be squeezed already."""
    return follows(traits(before, squeezed), traits(after, squeezed), size_before, size_after)


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def eta_label(seconds: Column) -> Column:
    """Whole tens of seconds, rounded up, as minutes and seconds."""
    tens = (F.ceil(seconds / 10) * 10).cast("bigint")
    return F.format_string("%d:%02d", (tens / 60).cast("bigint"), F.pmod(tens, F.lit(60)))


def local_path(c: Column) -> Column:
    """A pasted path: paired outer quotes go, and backslashes before blanks, brackets and quotes."""
    bare = F.regexp_replace(F.trim(c), r"""^(["'])(.*)\1$""", "$2")
    return F.when(bare.startswith("/") | bare.startswith("~"), F.regexp_replace(bare, r"""\\([ ()'"&\[\]])""", "$1")).otherwise(bare)


def clamped(c: Column, low: int, high: int, default: int) -> Column:
    """An option as a whole number within its bounds; what is no number is the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.trim(c).try_cast("int"), F.lit(default))))


def chosen(c: Column, allowed: tuple[int, ...], default: int) -> Column:
    """An option that must be one of a few numbers."""
    own = F.trim(c).try_cast("int")
    return F.when(own.isin(*allowed), own).otherwise(F.lit(default))


def task_id_ok(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")


def numbers_without(c: Column, held: Column) -> Column:
    """The sorted multiset of a text's numbers without those of the texts in `held`, each as often as it stands there."""
    own, gone = numbers(c), F.flatten(F.transform(held, numbers))
    times = lambda all_, v: F.size(F.filter(all_, lambda x: x == v))
    left = lambda v: F.array_repeat(v, F.greatest(F.lit(0), times(own, v) - times(gone, v)))
    return F.flatten(F.transform(F.array_distinct(own), left))


def stress_text(c: Column, marker: str, ratio: float, kept: Column, held: Column | None = None) -> Column:
    """A text of a stated length for layout tests: the marker repeated up to ceil(ASCII letters * ratio) signs, one at least,
    then the tokens that must survive and the numbers that do not stand in what the tokens stand for (`held`)."""
    n = F.greatest(F.lit(1), F.ceil(F.regexp_count(c, F.lit("[A-Za-z]")) * F.lit(ratio))).cast("int")
    body = F.left(F.repeat(F.lit(marker), F.ceil(n / len(marker)).cast("int")), n)
    own = numbers(c) if held is None else numbers_without(c, held)
    return F.rtrim(F.concat_ws(" ", body, F.when(F.size(kept) > 0, F.array_join(kept, " ")), F.when(F.size(own) > 0, F.array_join(own, " "))))


def compact_label(c: Column, n_boxes: Column | int = 1) -> Column:
    """One box, one line of up to 48 signs in 8 words, without a sentence's end."""
    own, boxes = squeeze(c), F.lit(n_boxes) if isinstance(n_boxes, int) else n_boxes
    return (boxes == 1) & F.length(own).between(1, 48) & (word_count(own) <= 8) & ~own.contains("\n") & ~own.rlike("[!?;。！？；]$")


def fragmentary_label(c: Column, n_boxes: Column | int = 1) -> Column:
    """A compact label of ASCII letters alone, six at most, no word of more than two."""
    own = squeeze(c)
    short = F.forall(F.split(own, " +"), lambda w: F.length(w) <= 2)
    return compact_label(c, n_boxes) & own.rlike("^[A-Za-z ]+$") & (F.length(F.replace(own, F.lit(" "), F.lit(""))) <= 6) & short


def short_label(c: Column) -> Column:
    """Up to 30 signs in five words, all capitals, digits and a few marks."""
    own = squeeze(c)
    return (F.length(own) <= 30) & (word_count(own) <= 5) & own.rlike(CAPITALS)


def compact_anchors(texts: Column) -> Column:
    """Two to six texts, each of up to 48 signs in 8 words."""
    return F.size(texts).between(2, 6) & F.forall(texts, lambda t: (F.length(squeeze(t)) <= 48) & (word_count(squeeze(t)) <= 8))


def ascii_word(c: Column) -> Column:
    """A sign that an ASCII word may hold."""
    return c.rlike(r"^[A-Za-z0-9./:%+-]$")


def orphan_punctuation(lines: Column) -> Column:
    """The last of two or more non-empty lines is closing punctuation alone."""
    own = F.filter(F.transform(lines, strip), lambda x: x != "")
    return (F.size(own) >= 2) & F.coalesce(F.get(own, F.size(own) - 1).rlike(r"^[)\]}>）】》」』〕〉.,，。！？!?；;：:、]+$"), F.lit(False))


def vector_kind(source_kind: Column, font: Column) -> Column:
    """Text from the page itself, not recognized from an image (where no kind is given, by the font's name)."""
    return F.when(source_kind == "pdf_text", True).when(source_kind == "ocr", False).otherwise(F.coalesce(font, F.lit("")) != "macOS Vision OCR")


def range_label(start: Column, end: Column, total: Column) -> Column:
    """The label of a page range: all pages, or from where to where and how many."""
    n = end - start + 1
    whole = (n == total) & (start == 1)
    return F.when(n < 1, "未选择页面").when(whole, F.concat(F.lit("全部 "), total.cast("string"), F.lit(" 页"))).otherwise(F.concat(F.lit("第 "), start.cast("string"), F.lit("–"), end.cast("string"), F.lit(" 页，共 "), n.cast("string"), F.lit(" 页")))
