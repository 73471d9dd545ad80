"""Stored documents and recognized lines as JSON: strict typed reading, what is wrong with a document and where, rows of its
parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text as X
from pagemill.operators import layout


SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _kind(t: str | T.DataType) -> T.DataType:
    """A type by its name; known before there is a session, which could read names itself."""
    if isinstance(t, T.DataType):
        return t
    return T.ArrayType(_kind(t[6:-1])) if t.startswith("array<") else SIMPLE[t]


def record(needed: dict[str, str | T.DataType], optional: dict[str, tuple[str | T.DataType, object]]) -> T.StructType:
    """A struct of fields that must be there and of fields with a default."""
    fields = [T.StructField(name, _kind(t), False) for name, t in needed.items()]
    return T.StructType(fields + [T.StructField(name, _kind(t), True, {"default": value}) for name, (t, value) in optional.items()])


# Names, needs and defaults of the fields of stored documents.
BOXES = "array<array<double>>"
PLACEHOLDER = record({"token": "string", "original": "string", "kind": "string"}, {})
ANCHOR = record(
    {"anchor_id": "string", "page_number": "int", "reading_order": "int", "bbox": "array<double>"},
    {
        "erase_bboxes": (BOXES, []), "source_text": ("string", ""), "column_id": ("int", 0), "layout_label": ("string", "paragraph"),
        "rotation_degrees": ("double", 0.0), "source_kind": ("string", "legacy"),
    },
)
SEGMENT = record(
    {
        "segment_id": "string", "row_key": "string", "page_number": "int", "reading_order": "int", "block_type": "string",
        "source_text": "string", "protected_text": "string", "source_text_hash": "string", "bbox": "array<double>",
    },
    {
        "erase_bboxes": (BOXES, []), "font_name": ("string", ""), "font_size": ("double", 0.0), "should_translate": ("boolean", True),
        "translated_text": ("string", ""), "placeholders": (T.ArrayType(PLACEHOLDER), []), "status": ("string", "pending"),
        "warnings": ("array<string>", []), "fallback_reason": ("string", None), "paragraph_id": ("string", ""),
        "anchors": (T.ArrayType(ANCHOR), []), "layout_label": ("string", ""), "column_id": ("int", 0), "continuation": ("string", None),
        "rotation_degrees": ("double", 0.0), "source_kind": ("string", "legacy"),
    },
)
PAGE = record(
    {"page_number": "int", "width": "double", "height": "double"},
    {"rotation": ("int", 0), "mediabox": ("array<double>", []), "cropbox": ("array<double>", [])},
)
PACKAGE = record({"package_id": "string", "filename": "string", "package_index": "int", "package_total": "int", "row_keys": "array<string>", "created_at": "string"}, {})
SETTINGS = record(
    {},
    {
        "translate_headers": ("boolean", False), "translate_footers": ("boolean", False), "ignore_page_numbers": ("boolean", True),
        "ignore_number_warnings": ("boolean", True), "page_start": ("int", 1), "page_end": ("int", None),
        "protected_terms": ("array<string>", []), "ocr_mode": ("string", "off"), "ocr_dpi": ("int", 200),
    },
)
DOCUMENT = record({}, {"version": ("int", 2), "pages": (T.ArrayType(PAGE), [])})
#: Recognized lines: parts of the page's width and height, from its lower left corner.
RECOGNIZED = record({}, {"text": ("string", "")} | {n: ("double", 0.0) for n in ("confidence", "x", "y", "width", "height")})

PROBLEMS = "array<struct<path:string,problem:string>>"


def _nested(kind: T.DataType) -> T.StructType | None:
    own = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return own if isinstance(own, T.StructType) else None


def problems(text: Column, schema: T.StructType, at: Column | None = None) -> Column:
    """(path, problem) of all that keeps a JSON text from being an object of this schema, outer problems first: no object or
    no list, an unknown key, a missing one, a value of another type. Paths are those of a reader, `anchors[0].bbox`, that of
    the whole text is `$`.

    Each level is read as a map of texts, whose keys are compared with the schema's names, and its plain fields once by
    their types. A null text is no object; null is a value of every optional field; a text field takes any value.
    """
    read = F.struct(
        F.from_json(text, "map<string,string>").alias("members"),
        F.from_json(text, T.StructType([T.StructField(f.name, f.dataType) for f in _plain(schema)] or [T.StructField("none", T.StringType())])).alias("typed"),
    )
    return _once(read, lambda level: _of_level(level["members"], level["typed"], schema, at))


def _once(value: Column, of) -> Column:
    """What `of` makes of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), of)[0]


def _plain(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema if _nested(f.dataType) is None and f.dataType != T.StringType()]


def _of_level(members: Column, typed: Column, schema: T.StructType, at: Column | None) -> Column:
    name = (lambda key: key) if at is None else (lambda key: F.concat(at, F.lit("."), key))
    said = lambda path, problem: F.struct(path.alias("path"), problem.alias("problem"))
    names = lambda own: F.array(*[F.lit(f.name) for f in own]).cast("array<string>")
    none = F.array().cast(PROBLEMS)
    unknown = F.array_sort(F.array_except(F.map_keys(members), names(schema)))
    missing = F.filter(names([f for f in schema if not f.nullable]), lambda k: members[k].isNull())
    found = [F.transform(unknown, lambda k: said(name(k), F.lit("unknown key"))), F.transform(missing, lambda k: said(name(k), F.lit("missing")))]
    if plain := _plain(schema):
        odd = lambda f: F.when(members[f.name].isNotNull() & typed[f.name].isNull(), said(name(F.lit(f.name)), F.lit(f"no {f.dataType.simpleString()}")))
        found.append(F.filter(F.array(*[odd(f) for f in plain]), lambda x: x.isNotNull()))
    for f in schema:
        if (inner := _nested(f.dataType)) is None:
            continue
        own, path = members[f.name], name(F.lit(f.name))
        if isinstance(f.dataType, T.ArrayType):
            of = lambda items, inner=inner, path=path: _of_items(items, inner, path)
            found.append(F.when(own.isNull(), none).otherwise(_listed(own, path, of)))
        else:
            found.append(F.when(own.isNull(), none).otherwise(problems(own, inner, path)))
    whole = F.lit("$") if at is None else at
    return F.when(members.isNull(), F.array(said(whole, F.lit("no object")))).otherwise(F.concat(*found))


def _listed(text: Column, path: Column, of) -> Column:
    lost = F.array(F.struct(path.alias("path"), F.lit("no list").alias("problem")))
    return _once(F.from_json(text, "array<string>"), lambda items: F.when(items.isNull(), lost).otherwise(of(items)))


def _of_items(items: Column, schema: T.StructType, path: Column) -> Column:
    place = lambda i: F.concat(path, F.lit("["), i, F.lit("]"))
    return F.flatten(F.transform(items, lambda x, i: problems(F.coalesce(x, F.lit("")), schema, place(i))))


def _literal(value, kind: T.DataType) -> Column:
    return F.array().cast(kind) if value == [] else F.lit(value).cast(kind)


def _filled(c: Column, schema: T.StructType) -> Column:
    """c with the defaults of optional fields in place of nulls, at every depth."""

    def own(f: T.StructField) -> Column:
        v, inner = c[f.name], _nested(f.dataType)
        if inner is not None:
            v = F.transform(v, lambda x: _filled(x, inner)) if isinstance(f.dataType, T.ArrayType) else _filled(v, inner)
        default = (f.metadata or {}).get("default")
        return (v if default is None else F.coalesce(v, _literal(default, bare(f.dataType)))).alias(f.name)

    return F.when(c.isNotNull(), F.struct(*[own(f) for f in schema]))


def bare(kind: T.DataType) -> T.DataType:
    """The type without needs and defaults, which values do not carry."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(bare(kind.elementType))
    return T.StructType([T.StructField(f.name, bare(f.dataType)) for f in kind]) if isinstance(kind, T.StructType) else kind


def read_strict(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """rows with `document`, the typed object with defaults for what is not stated, null where `problems` is not empty.

    `column` gives way to both. Expressions alone; a document's text is held by one task.
    """
    text = F.col(f"`{column}`")
    typed = _once(F.from_json(text, bare(schema)), lambda c: _filled(c, schema))
    judged = _once(problems(text, schema), lambda found: F.struct(found.alias("problems"), F.when(F.size(found) == 0, typed).alias("document")))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != column]
    return rows.select(*kept, F.explode(F.array(judged)).alias("judged__")).select(*kept, "judged__.*")


def faults(checked: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, problem): a row for each problem of the documents that `read_strict` refused."""
    return checked.select(*keys, F.inline("problems"))


def visual_anchors(segment: str) -> Column:
    """A segment's anchors, or without any the one that its own box makes."""
    return _once(F.col(segment), _own_anchors)


def _own_anchors(s: Column) -> Column:
    erased = F.when(F.size(s["erase_bboxes"]) > 0, s["erase_bboxes"]).otherwise(F.array(s["bbox"]))
    label = F.when(s["layout_label"] != "", s["layout_label"]).otherwise(s["block_type"])
    own = {
        "anchor_id": F.concat(s["segment_id"], F.lit("-A001")), "page_number": s["page_number"], "reading_order": s["reading_order"],
        "bbox": s["bbox"], "erase_bboxes": erased, "source_text": s["source_text"], "column_id": s["column_id"],
        "layout_label": label, "rotation_degrees": s["rotation_degrees"], "source_kind": s["source_kind"],
    }
    made = F.array(F.struct(*[own[f.name].alias(f.name) for f in ANCHOR])).cast(bare(T.ArrayType(ANCHOR)))
    return F.when(F.size(s["anchors"]) > 0, s["anchors"]).otherwise(made)


def anchor_rows(checked: DataFrame, *keys: str) -> DataFrame:
    """(keys, segment_id, position, the fields of an anchor) of valid segments: what is drawn, piece by piece."""
    own = checked.where("document is not null").withColumn("anchors__", visual_anchors("document"))
    each = own.select(*keys, F.col("document.segment_id").alias("segment_id"), F.posexplode("anchors__").alias("position", "a"))
    return each.select(*keys, "segment_id", "position", "a.*")


def recognized_lines(pages: DataFrame, payload: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(lines, broken): lines (keys, line_no, text, confidence, x0, y0, x1, y1) of pages (keys, payload, rx0, ry0, rx1, ry1),
    and the keys of payloads that are no list of objects or hold a number that is none.

    Texts are squeezed, empty ones and those of a confidence below .35 go; what is not stated is 0, keys that nobody knows
    are left alone; boxes are those of `layout.ocr_lines` in the placed rectangle. A null payload is broken, an empty list
    has no lines.
    """
    text, kind = F.col(f"`{payload}`"), T.ArrayType(bare(RECOGNIZED))
    wrong = F.filter(_listed(text, F.lit("$"), lambda items: _of_items(items, RECOGNIZED, F.lit("$"))), lambda p: p["problem"] != "unknown key")
    read = pages.withColumn("lines__", F.when(F.size(wrong) == 0, F.from_json(text, kind)))
    each = read.select(*keys, "rx0", "ry0", "rx1", "ry1", F.posexplode("lines__").alias("line_no", "l")).withColumn("l", _filled(F.col("l"), RECOGNIZED))
    words = each.select(*keys, "line_no", "rx0", "ry0", "rx1", "ry1", "l.*").withColumn("text", X.squeeze(F.col("text")))
    lines = layout.ocr_lines(words).select(*keys, "line_no", "text", "confidence", "x0", "y0", "x1", "y1")
    return lines, read.where("lines__ is null").select(*keys)
