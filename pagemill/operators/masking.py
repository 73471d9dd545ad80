"""Protected spans: masks with stable tokens, tolerant restoring, and the policy for lost tokens."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order of priority, with their patterns: fixed values.
PATTERNS = (
    ("code", r"```[\s\S]*?```|`[^`\n]+`"),
    ("formula", r"\$\$[\s\S]+?\$\$|(?<!\$)\$[^$\n]{1,200}\$(?!\$)|\\\([^)\n]{1,200}\\\)|\\\[[^\]\n]{1,400}\\\]|(?<!\w)[A-Za-z]\s*=\s*[A-Za-z0-9]+(?:\s*[\^_*/+\-]\s*[A-Za-z0-9²³⁰¹⁴⁵⁶⁷⁸⁹]+)*"),
    ("url", r"(?i)\b(?:https?://|www\.)[^\s<>{}\[\]]+"),
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("doi", r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"),
    ("file_path", r"(?<!\w)(?:[A-Za-z]:\\(?:[^\\\s]+\\)*[^\\\s]+|/(?=[^/\s]*[A-Za-z_~])(?:[^/\s]+/)*[^/\s]+)"),
    ("citation", r"\[(?:\s*\d+(?:\s*[-–]\s*\d+)?\s*,?)+\]|\((?:19|20)\d{2}[a-z]?\)"),
    ("number_unit", r"(?i)(?<![\w.])(?!(?:19|20)\d{2}s\b)[-+]?\d+(?:[.,]\d+)?(?:\s*[×x]\s*10(?:\^[-+]?\d+|[⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+))?\s*(?:%|°?[CF]|kg|g|mg|μg|ug|ng|km|cm|mm|μm|um|nm|mL|ml|L|kPa|MPa|Pa|Hz|kHz|MHz|GHz|V|mV|A|mA|W|kW|MW|J|kJ|mol|mmol|s|ms|min|h|d)(?!\w)"),
)
TOKEN = "⟦X%s⟧"
SCHEMA = "struct<text:string,placeholders:array<struct<token:string,original:string,kind:string>>>"


def token(task: str, segment: str, kind: str, index: int, original: str) -> str:
    return TOKEN % hashlib.sha256(f"{task}|{segment}|{kind}|{index}|{original}".encode()).hexdigest()[:10].upper()


def select_spans(text: str, terms: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans to mask: by start, then priority (terms first), then length; overlaps lose."""
    found = []
    for term in terms:
        found += [(m.start(), -1, -len(m[0]), m.end(), "protected_term") for m in re.finditer(re.escape(term), text, re.I)] if term else []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        found += [(m.start(), rank, -len(m[0]), m.end(), kind) for m in re.finditer(pattern, text)]
    out, end = [], 0
    for start, _, _, stop, kind in sorted(found):
        if start >= end:
            out.append((start, stop, kind))
            end = stop
    return out


def mask(text: str | None, task: str, segment: str, terms: tuple[str, ...] = ()) -> tuple[str, list[tuple[str, str, str]]]:
    text = text or ""
    parts, held, at = [], [], 0
    for i, (start, stop, kind) in enumerate(select_spans(text, terms)):
        held.append((token(task, segment, kind, i, text[start:stop]), text[start:stop], kind))
        parts += [text[at:start], held[-1][0]]
        at = stop
    return "".join([*parts, text[at:]]), held


def may_match(text: Column, terms: tuple[str, ...] = ()) -> Column:
    """False only where no pattern can match, so that such rows need no Python."""
    some = text.rlike(r"(?iU)[`$@\[/=\\\d]|www\.")
    for term in terms:
        some = some | F.contains(F.lower(text), F.lit(term.lower()))
    return some


def protect(df: DataFrame, task: str, id_col: str, text_col: str, terms: tuple[str, ...] = ()) -> DataFrame:
    """df with protected_text and placeholders. Rows in which nothing can match stay inside the JVM."""

    @F.pandas_udf(SCHEMA)
    def masked(text: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = [mask(t, task, str(i), terms) for t, i in zip(text, ids)]
        return pd.DataFrame({"text": [r[0] for r in rows], "placeholders": [[dict(zip(("token", "original", "kind"), p)) for p in r[1]] for r in rows]})

    hit = F.coalesce(may_match(F.col(text_col), terms), F.lit(False))
    plain = df.where(~hit).withColumns({"protected_text": F.coalesce(F.col(text_col), F.lit("")), "placeholders": F.array().cast("array<struct<token:string,original:string,kind:string>>")})
    rest = df.where(hit).withColumn("m__", masked(F.col(text_col), F.col(id_col).cast("string"))).withColumns({"protected_text": F.col("m__.text"), "placeholders": F.col("m__.placeholders")}).drop("m__")
    return plain.unionByName(rest)


def tolerant(tok: str) -> str:
    """Matches a token in either case, with blanks between its signs and any brackets (a fixed set)."""
    bracket = r"[\[\]【】〔〕⟦⟧{}()（）]?"
    return rf"(?i){bracket}\s*" + r"\s*".join(map(re.escape, tok.strip("⟦⟧"))) + rf"\s*{bracket}"


def restore(text: str, placeholders: list[tuple[str, str, str]]) -> tuple[str, list[str], list[str], list[str]]:
    """(text, missing, duplicated, unknown): each token that stands there once is put back. One that stands there more
    often is left; one that is lost is fine if its original stands there once."""
    missing, duplicated, own = [], [], {tok.strip("⟦⟧").upper() for tok, _, _ in placeholders}
    for tok, original, _ in placeholders:
        found = len(re.findall(tolerant(tok), text))
        if found == 1:
            text = re.sub(tolerant(tok), lambda _, o=original: o, text)
        elif found or text.count(original) > 1:
            duplicated.append(tok)
        elif original not in text:
            missing.append(tok)
    unknown = sorted({x.upper() for x in re.findall(r"(?i)X[0-9A-F]{10}", text)} - own)
    return text, missing, duplicated, unknown


def restored(df: DataFrame, text_col: str, placeholders_col: str) -> DataFrame:
    """df with restored_text, missing, duplicated and unknown (arrays of tokens)."""

    @F.pandas_udf("struct<text:string,missing:array<string>,duplicated:array<string>,unknown:array<string>>")
    def back(text: pd.Series, held: pd.Series) -> pd.DataFrame:
        rows = [restore(t or "", [(p["token"], p["original"], p["kind"]) for p in (h if h is not None else [])]) for t, h in zip(text, held)]
        return pd.DataFrame(rows, columns=["text", "missing", "duplicated", "unknown"])

    return df.withColumn("r__", back(F.col(text_col), F.col(placeholders_col))).withColumns({"restored_text": F.col("r__.text"), "missing": F.col("r__.missing"), "duplicated": F.col("r__.duplicated"), "unknown": F.col("r__.unknown")}).drop("r__")


def _may_be_lost(p: Column, allow_units: bool) -> Column:
    return (F.lit(allow_units) & (p["kind"] == "number_unit")) | ((p["kind"] == "file_path") & ~p["original"].rlike(r"\p{L}"))


def allowed_missing(placeholders: Column, missing: Column, allow_units: bool = True) -> Column:
    """Missing tokens that may be lost: units if allowed, paths without a letter always."""
    return F.transform(F.filter(placeholders, lambda p: F.array_contains(missing, p["token"]) & _may_be_lost(p, allow_units)), lambda p: p["token"])


def blocking_missing(placeholders: Column, missing: Column, allow_units: bool = True) -> Column:
    """Missing tokens that may not be lost; tokens that no placeholder has may not either."""
    return F.array_except(missing, allowed_missing(placeholders, missing, allow_units))


def restore_ok(placeholders: Column, missing: Column, duplicated: Column, unknown: Column, allow_units: bool = True) -> Column:
    """Nothing blocks: no token is lost that may not be, none repeated or unknown."""
    return (F.size(blocking_missing(placeholders, missing, allow_units)) == 0) & (F.size(duplicated) == 0) & (F.size(unknown) == 0)


def kind_counts(df: DataFrame, text_col: str, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, n): how often each of the kinds occurs, without Python; for kinds whose pattern looks around nothing."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(text_col), F.lit(dict(PATTERNS)[k])).alias("n")) for k in kinds])
    return df.select(F.inline(each)).groupBy("kind").agg(F.sum("n").cast("bigint").alias("n"))
