"""A fitted plan on a stream. The row rules hold no state, so a plan fitted on a batch applies to
a streaming table as it is; steps that look across rows stay with the batch."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import validate
from ..operators.tables import col
from ..plans.clean import CleaningPlan


def clean_stream(stream: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Normalised, converted and validated rows of a stream."""
    rules = {"email": validate.valid_email, "phone": validate.valid_phone}
    rows = plan.apply(stream)
    return rows.select(*[
        rules[plan.kinds[c]](col(c)).alias(c) if plan.kinds[c] in rules else col(c) for c in rows.columns])
