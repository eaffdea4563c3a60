"""Typed values out of JSON text.

``json_fields`` parses a document once for any number of fields (one ``from_json`` with a schema
pruned to the wanted paths), where a path call per field would parse it once per field.  Leaves are
read as text, so empty texts, ``|`` lists and badly written numbers can be treated afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborbook.functions.scalars import as_col, blank_to_null, first_part


@dataclass(frozen=True)
class JsonField:
    """One number at ``path`` in a JSON text column, exposed as column ``name``.

    The last ``inner`` keys of the path are read inside a sub-document, which may lie in the document as an object or as
    the text of one.
    """

    name: str
    source: str
    path: tuple[str, ...]
    dtype: str = "decimal(18,0)"
    default: str | None = None
    split: bool = False
    inner: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.inner < len(self.path):
            raise ValueError(f"{self.name}: a path of {len(self.path)} keys can't have {self.inner} in a sub-document")

    @property
    def outer(self) -> tuple[str, ...]:
        """Path in the document itself."""
        return self.path[: len(self.path) - self.inner]

    @property
    def rest(self) -> tuple[str, ...]:
        """Path in the sub-document, if there is one."""
        return self.path[len(self.path) - self.inner :]


def _bracket_path(keys: Iterable[str]) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def json_text(doc: Column | str, *keys: str, missing: str = "empty") -> Column:
    """Text at a path.

    With ``missing="empty"`` a valid document without the key gives the empty text and only an
    invalid or NULL document gives NULL; with ``missing="null"`` both give NULL.
    """
    doc = as_col(doc)
    found = F.get_json_object(doc, _bracket_path(keys))
    if missing == "null":
        return found
    if missing != "empty":
        raise ValueError(f"missing must be 'empty' or 'null', not {missing!r}")
    return F.when(F.get_json_object(doc, "$").isNotNull(), F.coalesce(found, F.lit("")))


def decimal_field(text: Column | str, dtype: str, default: str | None = None, split: bool = False, strict: bool = False) -> Column:
    """Text to number: empty is NULL, ``split`` keeps what precedes the first bar, ``default`` fills NULL.

    A text that is no number gives NULL, or an error with ``strict``.
    """
    text = as_col(text)
    if split:
        text = first_part(text)
    text = blank_to_null(text)
    number = text.cast(dtype) if strict else text.try_cast(dtype)
    if default is None:
        return number
    # The type of the result is the field's, widened where the default needs more decimals.
    return F.coalesce(number, F.lit(default).cast(dtype)).cast(dtype)


def guarded_number(text: Column | str, dtype: str = "decimal(18,0)", strict: bool = False) -> Column:
    """Number only where the text is made of digits and dots; ``1.2.3`` passes the guard and gives NULL, or an error with ``strict``."""
    text = as_col(text)
    return F.when(text.rlike(r"^[0-9.]+$"), text.cast(dtype) if strict else text.try_cast(dtype))


def _schema(paths: Iterable[tuple[str, ...]]) -> T.StructType:
    tree: dict = {}
    for path in paths:
        node = tree
        for key in path[:-1]:
            node = node.setdefault(key, {})
            if node is None:
                raise ValueError(f"{path}: {key!r} is read as a text too")
        if node.setdefault(path[-1], None) is not None:
            raise ValueError(f"{path}: {path[-1]!r} is read as an object too")

    def build(node: dict) -> T.StructType:
        return T.StructType([T.StructField(k, T.StringType() if v is None else build(v)) for k, v in node.items()])

    return build(tree)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _leaf(parsed: str, path: tuple[str, ...]) -> str:
    return ".".join(_quote(part) for part in (parsed, *path))


def _invalid(text: str) -> str:
    """Whether a text is there and no JSON, as SQL; the empty text is no document."""
    return f"(nullif({text}, '') IS NOT NULL AND get_json_object({text}, '$') IS NULL)"


def json_paths(df: DataFrame, source: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Add text columns ``wanted = {column: path}`` read from the JSON column ``source`` in one parse."""
    parsed = f"_parsed_{source}"
    out = df.withColumn(parsed, F.from_json(F.col(source), _schema(wanted.values())))
    texts = [f"{_leaf(parsed, path)} AS {_quote(name)}" for name, path in wanted.items()]
    return out.selectExpr("*", *texts).drop(parsed)


def checked_json(df: DataFrame, sources: Iterable[str], row: str) -> DataFrame:
    """The rows with documents that end the query where they are no JSON; the error names the column and the value of ``row``.

    NULL and the empty text are no document and pass.
    """
    raised = {s: f"CASE WHEN {_invalid(_quote(s))} THEN raise_error(concat({_literal(s + ' is no JSON, ' + row + ' ')}, {_shown(row)})) ELSE {_quote(s)} END" for s in sources}
    return df.withColumns({s: F.expr(e) for s, e in raised.items()})


def _shown(row: str) -> str:
    return f"coalesce(CAST({_quote(row)} AS STRING), 'NULL')"


@dataclass(frozen=True)
class _Parsed:
    """Rows with parsed documents: the texts of the fields in them, and the sub-documents, as SQL."""

    rows: DataFrame
    texts: dict[str, str]
    inside: dict[tuple[str, tuple[str, ...]], str]
    added: list[str]


def _parse(df: DataFrame, fields: list[JsonField]) -> _Parsed:
    """One parse per source column and one per sub-document, for any number of fields."""
    out, added, inside = df, [], {}
    for source in dict.fromkeys(f.source for f in fields):
        added.append(f"_parsed_{source}")
        out = out.withColumn(added[-1], F.from_json(F.col(source), _schema(dict.fromkeys(f.outer for f in fields if f.source == source))))
    parsed = {}
    for source, outer in dict.fromkeys((f.source, f.outer) for f in fields if f.inner):
        inside[source, outer] = text = _leaf(f"_parsed_{source}", outer)
        parsed[source, outer] = f"_parsed_{source}_{len(parsed)}"
        out = out.withColumn(parsed[source, outer], F.from_json(F.expr(text), _schema(dict.fromkeys(f.rest for f in fields if f.inner and (f.source, f.outer) == (source, outer)))))
    added += parsed.values()

    def text(f: JsonField) -> str:
        at = _leaf(parsed[f.source, f.outer], f.rest) if f.inner else _leaf(f"_parsed_{f.source}", f.path)
        return f"nullif(split_part({at}, '|', 1), '')" if f.split else f"nullif({at}, '')"

    return _Parsed(out, {f.name: text(f) for f in fields}, inside, added)


def json_fields(df: DataFrame, fields: Iterable[JsonField], defaults: bool = True, strict: bool = False, row: str | None = None) -> DataFrame:
    """Add every field of the list as a typed column, parsing each source column and each sub-document once.

    A text that is no number, and a sub-document that is no JSON, give NULL; with ``strict`` they end the query with an
    error that names the field, the text and the value of the column ``row``.  ``checked_json`` does so for whole documents.
    A hundred strict fields are too many for one generated method, so Spark evaluates them in several.

    The columns are written as SQL text (the same steps as ``decimal_field``): a hundred of them would
    take seconds to put together call by call.
    """
    fields = list(fields)
    if strict and row is None:
        raise ValueError("strict needs the name of a column that tells the rows apart")
    parsed = _parse(df, fields)

    def typed(f: JsonField) -> str:
        text = parsed.texts[f.name]
        value = f"TRY_CAST({text} AS {f.dtype})"
        if strict:
            where = f"{_literal(', ' + str(row) + ' ')}, {_shown(str(row))}"
            cases = f"WHEN {text} IS NOT NULL AND {value} IS NULL THEN raise_error(concat({_literal(f.name + ' is no number: ')}, {text}, {where}))"
            if f.inner:
                bad = _invalid(parsed.inside[f.source, f.outer])
                cases = f"WHEN {bad} THEN raise_error(concat({_literal(f.name + ' lies in no JSON')}, {where})) {cases}"
            value = f"CASE {cases} ELSE {value} END"
        return f"{value} AS {_quote(f.name)}"

    out = parsed.rows.selectExpr("*", *[typed(f) for f in fields]).drop(*parsed.added)
    return fill_defaults(out, fields) if defaults else out


def json_problems(df: DataFrame, fields: Iterable[JsonField], keys: Iterable[str]) -> DataFrame:
    """(keys, source, field, problem, found) of all that ``strict`` would stop at, in one pass without a shuffle.

    ``problem`` is ``document`` (the column is no JSON; no field), ``sub-document`` (what the path leads to is no JSON;
    ``field`` is the first one read in it) or ``number``.  Rows without a problem give none, a row may give several, and
    of NULL and empty texts nothing is reported.
    """
    fields, keys = list(fields), list(keys)
    parsed = _parse(df, fields)
    first = {(f.source, f.outer): f.name for f in reversed(fields) if f.inner}

    def entry(source: str, field: str | None, problem: str, found: str, wrong: str) -> str:
        name = "CAST(NULL AS STRING)" if field is None else _literal(field)
        return f"CASE WHEN {wrong} THEN named_struct('source', {_literal(source)}, 'field', {name}, 'problem', '{problem}', 'found', {found}) END"

    entries = [entry(s, None, "document", _quote(s), _invalid(_quote(s))) for s in dict.fromkeys(f.source for f in fields)]
    entries += [entry(source, first[source, outer], "sub-document", text, _invalid(text)) for (source, outer), text in parsed.inside.items()]
    for f in fields:
        text = parsed.texts[f.name]
        entries.append(entry(f.source, f.name, "number", text, f"{text} IS NOT NULL AND TRY_CAST({text} AS {f.dtype}) IS NULL"))
    found = parsed.rows.select(*keys, F.expr(f"filter(array({', '.join(entries)}), p -> p IS NOT NULL)").alias("_found"))
    # Not ``inline``: from that Spark derives a filter on the list below the parse, which then runs again for every use.
    listed = found.select(*keys, F.explode_outer("_found").alias("_problem")).where(F.col("_problem").isNotNull())
    return listed.select(*keys, "_problem.source", "_problem.field", "_problem.problem", "_problem.found")


def fill_defaults(df: DataFrame, fields: Iterable[JsonField]) -> DataFrame:
    """Defaults of the fields, for rows whose document, or whose number in it, is missing."""
    default = {f.name: f for f in fields if f.default is not None}

    def filled(c: str) -> str:
        f = default.get(c)
        if f is None:
            return _quote(c)
        return f"coalesce({_quote(c)}, CAST({f.default} AS {f.dtype})) AS {_quote(c)}"

    return df.selectExpr(*[filled(c) for c in df.columns])
