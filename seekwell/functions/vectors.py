"""Vector expressions on `array<float>` / `array<double>` columns.

They run row by row and suit checks and small results; scoring a corpus goes
through `operators.scoring`, which multiplies blocks.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SHOWN_DECIMALS


def norm(vector: Column) -> Column:
    total = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(total)


def normalize(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    length = norm(vector)
    return F.when(
        length > 0, F.transform(vector, lambda x: x.cast("double") / length)
    ).otherwise(vector.cast("array<double>"))


def to_float(vector: Column) -> Column:
    return vector.cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def similarity_from_distance(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def shown(score: Column) -> Column:
    """A score rounded for output with plain double arithmetic, so that any
    engine gives the same digits."""
    scale = float(10**SHOWN_DECIMALS)
    return F.floor(score * scale + 0.5) / F.lit(scale)
