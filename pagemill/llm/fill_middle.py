"""Fill-in-the-middle rearrangement of texts, in DataFrame expressions only.

A unit grammar says which neighbours stay in one unit: a list of pairs (class before, class after), each the inside of a
regular expression's brackets. It becomes one zero-width expression that holds between two code points that no pair glues,
and Spark's `split` on it gives the units, of which nothing is lost. Draws are taken from a hash of the id, so that a
document's form and cuts are the same in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of neighbouring classes that stay together.
GRAMMARS = {
    "letter runs": [("A-Za-z", "A-Za-z")],
    "characters": [],
    "words": [(r"^\s", r"^\s"), (r"\s", r"\s")],
    "lines": [(r"^\n", r"\s\S")],
}
#: Signs before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The zero-width expression that holds between two units.

    It begins with a look at the whole code point before, which fails between the halves of a surrogate pair.
    """
    glued = "".join(rf"(?!(?<=[{before}])[{after}])" for before, after in grammar)
    return rf"(?<=[\s\S])(?!\z){glued}"


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of a text, whose concatenation is the text; none of an empty or null one (where `split` gives one)."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(id_: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers: the first groups of eight digits of the sha256 of the seed, a colon and the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(count)]


def rearranged(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form. Texts with a sign of their own are plain, so that the signs part the output
    into exactly four pieces, the first of them empty."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, grammar: list[tuple[str, str]] = GRAMMARS["letter runs"], seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output) for each row of docs.

    n counts the units. The prefix ends after the smaller of two drawn numbers of units, the middle after the larger. The
    form is plain where the text is empty or has one of the signs, or where a third draw's remainder by 100 is at least
    `plain_from`; else spm where a fourth one's is below `spm_below`, else psm. The parts of a plain text are null.

    A null text counts as empty and a null id as an empty one. Rows that repeat an id share its draws. An empty table gives
    no rows; columns other than the two named are not read. There is no shuffle; a text stands in its task's memory as its
    units, some 60 bytes each.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # Each step is a projection of its own, as later ones use it several times.
    d = d.withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("bigint"))
    d = d.withColumn("h", F.array(*draws(F.col("id"), seed)))
    h = [F.col("h")[i] for i in range(4)]
    d = d.withColumn("one", (h[0] % (F.col("n") + 1)).cast("int")).withColumn("two", (h[1] % (F.col("n") + 1)).cast("int"))
    d = d.withColumn("a", F.least("one", "two")).withColumn("b", F.greatest("one", "two"))
    plain = (F.col("n") == 0) | F.col("text").rlike("|".join((PREFIX, SUFFIX, MIDDLE))) | (h[2] % 100 >= plain_from)
    d = d.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm"))

    def part(at: Column, to: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", at + 1, to - at), ""))

    d = d.withColumns({"prefix": part(F.lit(0), F.col("a")), "middle": part(F.col("a"), F.col("b")), "suffix": part(F.col("b"), F.col("n").cast("int"))})
    d = d.withColumn("output", rearranged(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text")))
    return d.select("id", "text", "n", "form", "prefix", "middle", "suffix", "output")
