"""Labels of the external detector and the entity types they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label -> entity type.
LABEL_TYPES = {
    "person": "PERSON",
    "email": "EMAIL_ADDRESS",
    "phone number": "PHONE_NUMBER",
    "social security number": "US_SSN",
    "credit card": "CREDIT_CARD",
    "bitcoin address": "BITCOIN_ADDRESS",
    "ethereum address": "ETHEREUM_ADDRESS",
    "IBAN": "IBAN_CODE",
    "AWS key": "AWS_ACCESS_KEY_ID",
    "API key": "API_KEY",
    "password": "PASSWORD",
    "JWT token": "JWT_TOKEN",
    "address": "LOCATION",
    "IP address": "IP_ADDRESS",
    "medical license": "MEDICAL_LICENSE",
}
# End of fixed values.


def entity_type_of(label: Column) -> Column:
    """Entity type of a label; an unknown label is upper-cased with spaces as underscores."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    return F.coalesce(known[label], F.replace(F.upper(label), F.lit(" "), F.lit("_")))
