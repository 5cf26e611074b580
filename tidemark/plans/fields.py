"""User schemas as StructType, with the stable field id and comment in each field's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_NUMBERS = (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)
_OWN_NAMES = ("_added_in", "_row_id", "_gone_in", "_gone_word", "_gone_mask", "_bit", "_file", "_removed_in", "_prev_in",
              "_prev_id", "_found", "_keep", "_n")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_id(field: T.StructField) -> int:
    return field.metadata["field_id"]


def stored_name(field: T.StructField) -> str:
    """Name of the field in data files; renames never touch it."""
    return f"f{field_id(field)}"


def make_field(fid: int, name: str, dtype: T.DataType, nullable: bool = True, comment: str | None = None):
    meta = {"field_id": fid}
    if comment is not None:
        meta["comment"] = comment
    return T.StructField(name, dtype, nullable, meta)


def check_name(name: str) -> None:
    """Names that the library's own columns have cannot be user columns."""
    if name.lower() in _OWN_NAMES or name.lower().startswith("_old_"):
        raise ValueError(f"column name {name!r} is reserved")


def number_fields(schema: T.StructType, first_id: int = 1, keep_required: bool = True) -> T.StructType:
    """Give every field of an outside schema its id."""
    names = [f.name for f in schema]
    for n in names:
        check_name(n)
    if len({n.lower() for n in names}) != len(names):
        raise ValueError(f"column names are not unique: {names}")
    return T.StructType([
        make_field(i, f.name, f.dataType, f.nullable or not keep_required, f.metadata.get("comment"))
        for i, f in enumerate(schema, first_id)
    ])


def find(schema: T.StructType, name: str) -> T.StructField:
    for field in schema:
        if field.name == name:
            return field
    raise ValueError(f"no column {name!r}; columns are {schema.names}")


def can_widen(src: T.DataType, dst: T.DataType) -> bool:
    """Type changes that keep every stored value: integer to wider integer, float to double."""
    if src == dst:
        return True
    if type(src) in _INTEGERS and type(dst) in _INTEGERS:
        return _INTEGERS.index(type(src)) <= _INTEGERS.index(type(dst))
    return isinstance(src, T.FloatType) and isinstance(dst, T.DoubleType)


def _shape(dtype: T.DataType) -> str:
    # simpleString leaves out nullability, which files do not carry either
    return dtype.simpleString()


def can_store(src: T.DataType, dst: T.DataType) -> bool:
    """May a value of `src` be written to a `dst` column unchanged? Integers are range-checked at run time."""
    if _shape(src) == _shape(dst) or isinstance(src, T.NullType) or can_widen(src, dst):
        return True
    return type(src) in _INTEGERS and isinstance(dst, _NUMBERS)


def store_value(value: Column, field: T.StructField) -> Column:
    """Cast to the column's type; a NULL in a required column fails the write."""
    out = value.cast(field.dataType)
    if not field.nullable:
        message = F.lit(f"NULL in required column {field.name}")
        out = F.when(out.isNull(), F.raise_error(message).cast(field.dataType)).otherwise(out)
    return out


def check_incoming(schema: T.StructType, df: DataFrame) -> None:
    """Reject columns the schema lacks, missing required columns and types that do not fit."""
    incoming = {f.name: f.dataType for f in df.schema}
    unknown = [n for n in incoming if n not in schema.names]
    missing = [f.name for f in schema if f.name not in incoming and not f.nullable]
    if unknown or missing or len(incoming) != len(df.columns):
        raise ValueError(
            f"columns do not match the table: not in the schema {unknown}, required but missing {missing}, "
            f"incoming {df.columns}"
        )
    for field in schema:
        src = incoming.get(field.name, T.NullType())
        if not can_store(src, field.dataType):
            raise ValueError(
                f"column {field.name}: cannot write {src.simpleString()} to {field.dataType.simpleString()}"
            )


def parse_type(dtype: str | T.DataType) -> T.DataType:
    return dtype if isinstance(dtype, T.DataType) else T.StructType.fromDDL(f"x {dtype}")["x"].dataType
