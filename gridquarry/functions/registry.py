"""Functions for SQL, by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.scores import erf
from .physics import RADIUS_KM, SIGMA2

C1, C2, C3, C4, C5, C6, C7 = SIGMA2
#: SQL functions are inlined by the optimizer: name, arguments, body.
INLINED = {
    "sigma2": ("t DOUBLE, s DOUBLE", f"{C1}D + {C3}D * s + t * ({C2}D + {C5}D * s + t * ({C4}D + {C7}D * s + {C6}D * t))"),
    "cell_km": ("lat DOUBLE, degrees DOUBLE", f"{RADIUS_KM}D * radians(degrees) * cos(radians(lat))"),
    "safe_std": ("std DOUBLE", "CASE WHEN std > 0 THEN std ELSE 1D END"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session; returns their names."""
    for name, (arguments, body) in INLINED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    spark.udf.register("erf", erf)
    return [*INLINED, "erf"]
