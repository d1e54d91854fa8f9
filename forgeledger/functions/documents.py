"""Column functions for JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(text: Column) -> Column:
    """The text as a VARIANT if it is one JSON object and nothing else, otherwise null.

    Inside brackets, what follows the first value makes the text unreadable or a second element.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.try_variant_get(listed, "$[0]", "variant")
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.schema_of_variant(first).startswith("OBJECT")
    return F.when(alone, first)
