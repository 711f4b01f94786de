"""Order of dependent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_stages(tables: DataFrame) -> DataFrame:
    """Add ``stage`` (1, 2 ... by ``seqnumber``) and ``dependent`` to the tables of each ``job``.

    A job is dependent if its tables have more than one order number. Ranking
    works on the distinct numbers, so a job with very many tables costs no more.
    """
    numbers = tables.select("job", "seqnumber").distinct()
    rank = F.row_number().over(Window.partitionBy("job").orderBy("seqnumber"))
    size = F.count(F.lit(1)).over(Window.partitionBy("job"))
    ranked = numbers.withColumn("stage", rank.cast("long")).withColumn("dependent", size > 1)
    return tables.join(ranked, ["job", "seqnumber"]).select(*tables.columns, "stage", "dependent")
