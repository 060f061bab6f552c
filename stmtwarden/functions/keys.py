"""Identity keys of statements and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json_string(c: Column) -> Column:
    """Quoted JSON string; the characters that HTML-safe encoders escape are
    escaped here too, so ids agree with those computed elsewhere."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def json_md5(**fields: Column) -> Column:
    """md5 of a flat JSON object with string values, keys in the given order."""
    parts: list[Column] = []
    for n, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("," if n else "{") + f'"{name}":'), _json_string(value)]
    return F.md5(F.concat(*parts, F.lit("}")))


def sql_id(project: Column, fingerprint: Column, schema: Column, instance: Column, source: Column, plan: Column) -> Column:
    """Key of a governed statement."""
    return json_md5(ProjectId=project, Fingerprint=fingerprint, Schema=schema, InstID=instance, Source=source, AuditPlanID=plan)


def record_key(fingerprint: Column, schema: Column) -> Column:
    """Older key of fingerprint and schema."""
    return json_md5(Fingerprint=fingerprint, Schema=schema)


def schema_meta_id(project: Column, schema: Column, instance: Column, source: Column, plan: Column, name: Column, kind: Column) -> Column:
    """Key of a schema object's DDL."""
    return json_md5(
        ProjectId=project, Schema=schema, InstName=instance, Source=source, AuditPlanId=plan, MetaName=name, MetaType=kind
    )


def audit_fingerprint(message: Column, fingerprint: Column) -> Column:
    """md5 of message and fingerprint, for duplicates within a task."""
    return F.md5(F.concat(F.coalesce(message, F.lit("")), F.coalesce(fingerprint, F.lit(""))))
