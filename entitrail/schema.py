"""Schemas and the fixed field catalog of the known-entity engine."""

from __future__ import annotations

from dataclasses import dataclass

#: Entity types in the order that a catalog names them: (type, catalog group).
GROUPS = {"person": "people", "car": "cars", "document": "documents", "legal_entity": "legal_entities", "sender": "senders", "misc": "miscellaneous"}

CATALOG = (
    "people array<struct<id:string,first_name:string,last_name:string,middle_name:string,birth_date:date,previous_last_name:string>>, "
    "cars array<struct<id:string,vin:string,license_plate:string,body_number:string,chassis_number:string>>, "
    "documents array<struct<id:string,document_type:string,series:string,number:string,issue_date:date>>, "
    "legal_entities array<struct<id:string,inn:string,name:string>>, "
    "senders array<struct<id:string,full_name:string,position:string,organization_name:string,return_address:string,email:string,inn:string>>, "
    "miscellaneous array<struct<id:string,incoming_letter_number:string,case_number:string,incoming_letter_date:date,preliminary_response_due_date:date,reply_email:string,reply_address:string>>"
)

ALIAS = "entity_type string, entity_id string, field_name string, value string, weight double, profile string"


@dataclass(frozen=True)
class Field:
    """How a field's values are matched: ``budget`` is a rule's name, see ``entitrail.config``."""

    type: str
    name: str
    profile: str
    weight: float
    budget: str = "none"

    @property
    def label(self) -> str:
        return f"{self.type}_{self.name}".upper()


# Weights and profiles that results depend on.
FIELDS = (
    Field("person", "first_name", "name", 0.50, "four"),
    Field("person", "last_name", "name", 0.65, "surname"),
    Field("person", "middle_name", "name", 0.50, "four"),
    Field("person", "previous_last_name", "name", 0.65, "surname"),
    Field("person", "birth_date", "date", 0.70, "eight"),
    Field("car", "vin", "vin", 1.0, "four"),
    Field("car", "license_plate", "plate", 0.95, "four"),
    Field("car", "body_number", "identifier", 0.95, "four"),
    Field("car", "chassis_number", "identifier", 0.95, "four"),
    Field("document", "series", "identifier", 0.40),
    Field("document", "number", "identifier", 0.90, "six"),
    Field("document", "series_number", "identifier", 0.98, "six"),
    Field("document", "document_type", "text", 0.40),
    Field("document", "issue_date", "date", 0.60),
    Field("legal_entity", "inn", "tax_id", 1.0),
    Field("legal_entity", "name", "text", 0.90, "six"),
    Field("sender", "full_name", "name", 0.95, "surname"),
    Field("sender", "position", "text", 0.45, "six"),
    Field("sender", "organization_name", "text", 0.90, "six"),
    Field("sender", "return_address", "text", 0.85),
    Field("sender", "email", "email", 0.95),
    Field("sender", "inn", "tax_id", 1.0),
    Field("misc", "incoming_letter_number", "reference", 0.90),
    Field("misc", "case_number", "reference", 0.90, "six"),
    Field("misc", "incoming_letter_date", "date", 0.65),
    Field("misc", "preliminary_response_due_date", "date", 0.65),
    Field("misc", "reply_email", "email", 0.95),
    Field("misc", "reply_address", "text", 0.85),
)

#: By field name; names that several types share have the same weight and profile.
BY_NAME = {f.name: f for f in FIELDS}
#: A weight that may be overridden although no alias carries the field.
EXTRA_WEIGHTS = {"previous_full_name": 0.95}
#: Rules by (type, field).
BUDGETS = {(f.type, f.name): f.budget for f in FIELDS}


def field(entity_type: str, name: str) -> Field:
    return next(f for f in FIELDS if f.type == entity_type and f.name == name)


def labels() -> list[str]:
    return [f.label for f in FIELDS]
