"""Schemas of dynamic records: the Spark type of a kind of field, and rules that map field names as they come to normal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

# Other names of normal fields.
ALIASES = {
    "name": ["name", "contact_name", "display_name", "full_name", "displayName"], "phone": ["phone", "phone_number", "phoneNumber", "mobile", "cell"], "email": ["email", "email_address", "emailAddress", "e_mail"],
    "sender": ["sender", "from", "from_user", "fromUser"], "receiver": ["receiver", "to", "to_user", "toUser", "recipient"], "timestamp": ["timestamp", "date", "datetime", "time", "created_at", "createdAt"],
    "message_text": ["message", "text", "body", "content", "message_text"], "caller": ["caller", "from", "calling_number"], "callee": ["callee", "to", "called_number", "receiver"], "duration": ["duration", "duration_seconds", "call_duration"],
}
#: What is done to, and asked of, values of a kind.
TREATMENT = {"phone": ("normalize_phone", "is_valid_phone"), "email": ("normalize_email", "is_valid_email"), "datetime": ("parse_datetime", "is_valid_datetime")}


def spark_type(kind: str) -> DataType:
    return {"datetime": TimestampType(), "integer": LongType(), "float": DoubleType(), "boolean": BooleanType()}.get(kind, StringType())


def struct_of(kinds: dict[str, str]) -> StructType:
    """Schema of fields by their kinds."""
    return StructType([StructField(k, spark_type(v)) for k, v in kinds.items()])


def mapping_rules(kinds: dict[str, str], original: list[str]) -> list[tuple[str, str, str | None, str | None]]:
    """(original name, normal name, transformation, validation): a field's own name first, else the first, by name, that is an alias of it."""
    out = []
    for normal, kind in kinds.items():
        known = {a.lower() for a in ALIASES.get(normal, [])}
        name = normal if normal in original else next((o for o in sorted(original) if o.lower() in known), None)
        if name is not None:
            out.append((name, normal, *TREATMENT.get(kind, (None, None))))
    return out


def apply_rules(rows: DataFrame, rules: list[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """Rows under their normal names, with values treated as the rules say."""
    from casegrid.functions.phones import e164

    treat = {"normalize_phone": e164, "normalize_email": lambda c: F.lower(F.trim(c)), "parse_datetime": lambda c: F.try_to_timestamp(c)}
    return rows.select(*[(treat[t](F.col(o)) if t else F.col(o)).alias(n) for o, n, t, _ in rules])
