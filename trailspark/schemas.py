"""Schemas of the files the sources read."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)

# One exported evidence envelope per JSON file. ``raw`` and ``summary`` are free-form
# objects and stay variants until ingest renders their canonical text.
EVIDENCE_ENVELOPE = T.StructType([
    T.StructField("source_system", _TEXT),
    T.StructField("export_command", _TEXT),
    T.StructField("collected_at", _TEXT),
    T.StructField("collector_version", _TEXT),
    T.StructField("controls", _TEXTS),
    T.StructField("evidentiary_status", _TEXT),
    T.StructField("raw", T.VariantType()),
    T.StructField("summary", T.VariantType()),
])

# One sign-off per line of an attestation log.
ATTESTATION_RECORD = T.StructType([
    T.StructField("id", _TEXT),
    T.StructField("signer", _TEXT),
    T.StructField("signer_role", _TEXT),
    T.StructField("signed_at", _TEXT),
    T.StructField("covers", _TEXTS),
    T.StructField("controls_attested", _TEXTS),
    T.StructField("outcome", _TEXT),
    T.StructField("adequacy", _TEXT),
    T.StructField("sufficiency", _TEXT),
    T.StructField("sig", _TEXT),
    T.StructField("sig_algo", _TEXT),
    T.StructField("notes", _TEXT),
    T.StructField("override_justification", _TEXT),
    T.StructField("override_evidence", _TEXT),
])

# One provisioning plan document; ``values`` differs per resource type.
PLAN_DOCUMENT = T.StructType([
    T.StructField("contract_id", _TEXT),
    T.StructField("planned_values", T.StructType([
        T.StructField("root_module", T.StructType([
            T.StructField("resources", T.ArrayType(T.StructType([
                T.StructField("address", _TEXT),
                T.StructField("type", _TEXT),
                T.StructField("values", T.VariantType()),
            ]))),
        ])),
    ])),
])
