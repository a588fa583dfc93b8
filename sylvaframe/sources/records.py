"""Delivered text records: typed rows for those that can be read, a reason for the rest.

One anchored pattern per schema decides for a whole row. Only rows that fail it are matched
against the prefix patterns of one, two, ... fields, which stand in each other: where the longest
one ends, the first broken field begins, and the reason is sought from there on. All patterns are possessive: the JVM's matcher then runs through a row in one pass and
without recursion, however long the row is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaframe.schema import require

#: The grammar of a field and of its values.
ANY_FIELD = r'(?>"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
NUMBER = r"[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?"
INTEGER = r"[+-]?[0-9]++"
LIMIT = 10_000_000
LEAST_ID, MOST_ID = -1, 9223372036854775807


@dataclass(frozen=True)
class Field:
    """kind: number, integer (may be empty) or any."""

    name: str
    kind: str = "any"

    @property
    def pattern(self) -> str:
        if self.kind == "any":
            return f"({ANY_FIELD})"
        value = NUMBER if self.kind == "number" else f"(?:{INTEGER})?"
        # a closing quote is only right before the next comma or the end
        return f'((?>" *+{value} *+"| *+{value} *+)(?=,|\\z))'


POINT_RECORD = (
    Field("x", "number"),
    Field("y", "number"),
    Field("z", "number"),
    Field("instance_id", "integer"),
    Field("semclassid"),
    Field("specificclassid"),
    Field("intensity"),
    Field("note"),
)


def row_pattern(fields: tuple[Field, ...]) -> str:
    return r"\A" + ",".join(f.pattern for f in fields) + r"\z"


def prefix_pattern(fields: tuple[Field, ...]) -> str:
    """The longest run of good fields from the start on, each followed by a comma or the end.

    The patterns of one, two, .. fields stand in each other, so the matcher goes on from where
    the shorter one ended instead of starting anew, and gives up nothing it has matched.
    """
    out = ""
    for i in range(len(fields) - 1, -1, -1):
        out = rf"(?:{',' if i else ''}{fields[i].pattern}(?=,|\z){out})?+"
    return r"\A" + out


#: what may follow a good prefix: sound fields, each after a comma
SOUND_REST = rf"\A(?:,{ANY_FIELD})*+\z"


def _bare(raw: Column) -> Column:
    """A value without quotes and surrounding blanks."""
    return F.btrim(F.btrim(raw, F.lit(' "')), F.lit(" "))


def _number(raw: Column) -> Column:
    """(value, ok) of a field that matches NUMBER."""
    text = _bare(raw)
    value = text.try_cast("double")
    # a double can round down to the limit itself; there the decimal decides
    exact = F.coalesce(F.abs(text.try_cast("decimal(38,28)")) <= F.lit(LIMIT), F.lit(False))
    return F.struct(value.alias("value"), F.coalesce((F.abs(value) < LIMIT) | ((F.abs(value) == LIMIT) & exact), F.lit(False)).alias("ok"))


def _integer(raw: Column) -> Column:
    """(value, ok) of a field that matches INTEGER or is empty."""
    text = _bare(raw)
    value = text.try_cast("bigint")
    return F.struct(value.alias("value"), F.coalesce((text == "") | (value >= LEAST_ID), F.lit(False)).alias("ok"))


def _unquoted(raw: Column) -> Column:
    return F.when(raw.startswith('"'), F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, whatever is filtered or read from them later.

    An ordinary projection would be repeated in every filter pushed through it.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_records(raw: DataFrame, line: str = "raw_line", fields: tuple[Field, ...] = POINT_RECORD) -> DataFrame:
    """Each row of ``raw`` with ``reason`` (null: readable), ``broken_field`` and ``record``.

    ``record`` is a struct of the typed fields, null for a record that can't be read. Reasons:
    'quoting', else 'columns', else 'value'. A null line has no fields ('columns'); an empty
    one has a single empty field ('columns'). The whole-row pattern is tried once. Rows that fail
    it keep the longest prefix of good fields: the field after it is ``broken_field``, and only
    what follows is looked at for the reason. ``broken_field`` is null when the fields are good
    but too many. Columns of ``raw`` stay; the three new ones replace any of the same name. No shuffle.
    """
    require(raw, line)
    own = [c for c in raw.columns if c not in ("reason", "broken_field", "record")]
    text = F.col(line)
    of = {k: [i for i, f in enumerate(fields) if f.kind == k] for k in ("number", "integer", "any")}
    names = F.array(*[F.lit(f.name) for f in fields])
    split = F.regexp_extract_all(text, F.lit(rf"(?:\A|,)({ANY_FIELD})"), F.lit(1))
    out = _once(raw.select(*own), __cells=F.when(F.rlike(text, F.lit(row_pattern(fields))), split))
    # the values of good rows, the good prefix of the others
    pick = lambda k, f: F.transform(F.transform(F.array(*[F.lit(i) for i in of[k]]), lambda i: F.col("__cells")[i]), f)
    parsed = F.struct(pick("number", _number).alias("number"), pick("integer", _integer).alias("integer"), pick("any", _unquoted).alias("any"))
    failed = F.col("__cells").isNull()
    out = _once(out, __parsed=F.when(~failed, parsed), __good=F.when(failed, F.regexp_extract(text, prefix_pattern(fields), 0)))
    good = F.col("__good")
    n_good = F.when(good == "", 0).otherwise(F.regexp_count(F.concat(F.lit(","), good), F.lit("," + ANY_FIELD)))
    rest = F.when(good == "", F.concat(F.lit(","), text)).otherwise(text.substr(F.length(good) + 1, F.length(text)))
    out = _once(out, __n_good=n_good, __rest=rest)
    left = F.lit(len(fields)) - F.col("__n_good")
    numbers, integers = F.col("__parsed.number"), F.col("__parsed.integer")
    right = F.forall(numbers, lambda v: v["ok"]) & F.forall(integers, lambda v: v["ok"])
    order = F.array(*[F.lit(fields[i].name) for i in of["number"] + of["integer"]])
    wrong = F.element_at(order, F.array_position(F.concat(numbers["ok"], integers["ok"]), F.lit(False)).cast("int"))
    reason = (
        F.when(text.isNull(), "columns")
        .when(~failed, F.when(right, F.lit(None)).otherwise("value"))
        .when(~F.rlike("__rest", F.lit(SOUND_REST)), "quoting")
        .when(F.regexp_count("__rest", F.lit("," + ANY_FIELD)) != left, "columns")
        .otherwise("value")
    )
    broken = F.when(text.isNull(), F.lit(fields[0].name)).when(~failed, F.when(~right, wrong)).otherwise(F.get(names, F.col("__n_good")))
    typed = []
    for i, f in enumerate(fields):
        value = F.col("__parsed")[f.kind][of[f.kind].index(i)]
        typed.append((value if f.kind == "any" else value["value"]).alias(f.name))
    out = _once(out, reason=reason, broken_field=broken, record=F.when(right, F.struct(*typed)))
    return out.drop("__cells", "__parsed", "__good", "__n_good", "__rest")


def read_points(raw: DataFrame, line: str = "raw_line") -> DataFrame:
    """The readable records as typed columns next to the columns of ``raw``."""
    good = parse_records(raw, line).where(F.col("reason").isNull())
    own = [c for c in raw.columns if c not in {f.name for f in POINT_RECORD}]
    return good.select(*own, "record.*")


def rejected(raw: DataFrame, line: str = "raw_line") -> DataFrame:
    return parse_records(raw, line).where(F.col("reason").isNotNull()).drop("record")
