"""Helpers of these tests."""


def clashing(df):
    """The same rows with columns more, whose names clash with those that operators make or read."""
    from pyspark.sql import functions as F

    more = ["fp", "node", "component_id", "score", "size", "taken", "ids", "spans", "c0", "k0", "TEXT", "Doc_ID", "component", "key", "v", "target", "copies"]
    return df.select("*", *[F.lit("x").alias(c) for c in more])
